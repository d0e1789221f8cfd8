"""Operator 1: every frame of a long payload is decoded."""

import numpy as np

from skeinlog.llm import progressive_jpeg as J


def test_long_payloads_give_a_row_a_frame(spark):
    long = np.random.default_rng(7).integers(32, 127, 1_600_000).astype(np.uint8).tobytes().decode()
    media = J.encode_media(spark.createDataFrame([(1, long), (2, "short"), (3, None)], "doc_id long, text string").coalesce(1), "text")
    images = J.parse({r.doc_id: r.media for r in media.collect()}[1])
    J.decode(images)
    got = {(r.doc_id, r.frame): r for r in J.decode_media(media).collect()}
    assert len(images) == 2 and set(got) == {(1, 0), (1, 1), (2, 0), (3, None)} and got[3, None].rgb is None
    for k, im in enumerate(images):
        tensor = J.to_rgb(im)
        assert (got[1, k].height, got[1, k].width) == tensor.shape[:2] and got[1, k].rgb == tensor.tobytes()
