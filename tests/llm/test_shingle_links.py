"""The pipeline's near duplicates against brute force over 5-word shingles."""

import random

import pytest

import corpus_pipeline
from skeinlog.llm import hamming_tree, shingle_links
from tests.llm.test_rows import WORD


def brute(rows):
    """{id: smallest id linked, directly or not, by a Jaccard similarity of 0.8 or more}."""
    sets = []
    for _, text in rows:
        words = [w.lower() for w in WORD.findall(text or "")]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    low = [r[0] for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while True:
        before = list(low)
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
        if low == before:
            return dict(zip((r[0] for r in rows), low, strict=True))


def make_rows():
    rnd = random.Random(3)
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    passage, rows = prose(40), []
    for _ in range(40):
        base = prose(rnd.randint(60, 160))
        rows.append(base)
        for _ in range(3):
            copy = list(base)
            for _ in range(rnd.randint(1, 6)):
                copy[rnd.randrange(len(copy))] = "edited" + str(rnd.random())
            rows.append(copy)
    rows += [prose(80) + passage for _ in range(20)] + [prose(15) + passage for _ in range(20)]
    rows += [["few", "words"], ["FEW", "words"], [], [], rows[0]]
    rnd.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("broadcast", [shingle_links.BROADCAST_ROWS, 0])
def test_stage_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(shingle_links, "BROADCAST_ROWS", broadcast)
    rows = make_rows()
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), rows[5]], "doc_id long, text string").repartition(3)
    want = brute(rows)
    found = shingle_links.components(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == want and len(found) == len(rows) + 1
    stays = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert None in stays and len(stays) == len(set(stays)) and set(stays) - {None} == set(want.values())
    # links that lie beyond the radius of the fingerprints
    assert len(stays) < hamming_tree.one_of_each(docs).count()


@pytest.mark.parametrize("bits", [10, 61])
def test_packed_shingles_lose_no_link(spark, monkeypatch, bits):
    # 10 bits: most shingles meet strangers; 61: places beyond 7 are cut off
    monkeypatch.setattr(shingle_links, "S_BITS", bits)
    rows = make_rows()
    found = shingle_links.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in found} == brute(rows)


def shuffled_bytes(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_what_is_shuffled_stays_small(spark, tmp_path, monkeypatch):
    """Texts that share passages but aren't near copies: their shingles are dealt, and few of them are needed again."""
    rnd = random.Random(7)
    prose = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    passages = [prose(100) for _ in range(400)]
    rows = [(i, " ".join(prose(100) + passages[i % 400])) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(shingle_links, "SAMPLE_ROWS", 1)
    before = shuffled_bytes(spark)
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == len(rows)
    share = (shuffled_bytes(spark) - before) / sum(len(t) for _, t in rows)
    print(f"shuffled {share:.2f} x input")
    assert share < 1.5
