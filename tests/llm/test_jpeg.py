"""Operator 1: lossless payloads, and decoding of frames that another (scalar) coder wrote."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from skeinlog.llm import progressive_jpeg as J


def test_zigzag_and_transform():
    z = J.zigzag()
    assert sorted(z) == list(range(64)) and z[:6].tolist() == [0, 1, 8, 16, 9, 2] and z[-3:].tolist() == [55, 62, 63]
    flat = np.zeros((1, 64), np.int64)
    flat[0, 0] = 80
    assert (J.samples(flat, np.ones(64, np.int64)) == 138).all()


def test_payloads_come_back():
    rnd = random.Random(1)
    raw = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 1, 575, 576, 577, 1152, 3000)] + [bytes(range(256)) * 9000]
    payloads = [J.padded_payload(r) for r in raw]
    assert all(len(p) % 576 == 0 and p for p in payloads)
    stored = J.encode_payloads(payloads)
    parsed = [J.parse(s) for s in stored]
    J.decode([i for images in parsed for i in images])
    assert [J.payload_of(images) for images in parsed] == payloads
    assert len(parsed[-1]) == -(-len(payloads[-1]) // (J.FRAME_MCUS * J.MCU_BYTES))


def test_equal_texts_equal_values_whatever_stands_beside():
    texts = ["alpha beta", "x" * 5000, None, "été"]
    together = list(zip(*J.media_rows(texts), strict=True))
    alone = [list(zip(*J.media_rows([t]), strict=True))[0] for t in texts]
    assert together == alone


class Bits:
    def __init__(self):
        self.s = []

    def put(self, value, n):
        self.s += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def bytes(self):
        s = self.s + [1] * (-len(self.s) % 8)
        out = bytes(int("".join(map(str, s[i : i + 8])), 2) for i in range(0, len(s), 8))
        return out.replace(b"\xff", b"\xff\x00")


def scalar_progressive(coefs, width, height, sampling, quant, restart):
    """A plain progressive coder: runs, EOB runs, refinement with new coefficients, non-interleaved AC scans."""
    flat8 = {s: 8 for s in range(255)}
    spec = J.huffman_spec(flat8)
    codes, sizes = J.huffman_codes(spec)
    hs, vs = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * hs)), -(-height // (8 * vs))
    out = [b"\xff\xd8", J._segment(0xDB, b"\x00" + bytes(quant))]
    out.append(J._segment(0xC2, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))))
    out += [J._segment(0xC4, b"\x00" + spec), J._segment(0xC4, b"\x10" + spec), J._segment(0xDD, struct.pack(">H", restart))]

    def head(comps, low, high, before, shift):
        out.append(J._segment(0xDA, bytes([len(comps)]) + b"".join(bytes([c + 1, 0]) for c in comps) + bytes([low, high, before << 4 | shift])))

    def emit(units, write, flush):
        step = restart or len(units)
        for k, at in enumerate(range(0, len(units), step)):
            if k:
                out.append(bytes([0xFF, 0xD0 + (k - 1) % 8]))
            bits = Bits()
            state = {}
            for u in units[at : at + step]:
                write(bits, u, state)
            flush(bits, state)
            out.append(bits.bytes())

    def symbol(bits, s):
        bits.put(int(codes[s]), int(sizes[s]))

    def signed(bits, v, n):
        bits.put(v if v > 0 else v + (1 << n) - 1, n)

    mcus = []
    for my in range(down):
        for mx in range(across):
            mcus.append([(c, (my * v + y) * across * h + mx * h + x) for c, (h, v) in enumerate(sampling) for y in range(v) for x in range(h)])
    everyone = list(range(len(sampling)))
    head(everyone, 0, 0, 0, 1)

    def dc(bits, mcu, state):
        for c, b in mcu:
            v = int(coefs[c][b][0]) >> 1
            d = v - state.get(c, 0)
            state[c] = v
            n = abs(d).bit_length()
            symbol(bits, n)
            if n:
                signed(bits, d, n)

    emit(mcus, dc, lambda *_: None)

    def blocks(c):
        h, v = sampling[c]
        wide, tall = -(-(-(-width * h // hs)) // 8), -(-(-(-height * v // vs)) // 8)
        return [y * across * h + x for y in range(tall) for x in range(wide)]

    def end_run(bits, state):
        n = state.pop("run", 0)
        if n:
            k = n.bit_length() - 1
            symbol(bits, k << 4)
            bits.put(n - (1 << k), k)
            for b in state.pop("later", []):
                bits.put(b, 1)

    for c in everyone:
        for low, high in ((1, 9), (10, 63)):
            head([c], low, high, 0, 2)

            def first(bits, b, state, c=c, low=low, high=high):
                zeros = 0
                for k in range(low, high + 1):
                    v = int(coefs[c][b][k])
                    v = (abs(v) >> 2) * (1 if v > 0 else -1)
                    if not v:
                        zeros += 1
                        continue
                    end_run(bits, state)
                    while zeros > 15:
                        symbol(bits, 0xF0)
                        zeros -= 16
                    n = abs(v).bit_length()
                    symbol(bits, zeros << 4 | n)
                    signed(bits, v, n)
                    zeros = 0
                if zeros:
                    state["run"] = state.get("run", 0) + 1

            emit(blocks(c), first, end_run)
    for c in everyone:
        for shift in (1, 0):
            head([c], 1, 63, shift + 1, shift)

            def refine(bits, b, state, c=c, shift=shift):
                values = [abs(int(v)) >> shift for v in coefs[c][b]]
                last = max((k for k in range(1, 64) if values[k] == 1), default=0)
                zeros, later = 0, []
                for k in range(1, 64):
                    if values[k] > 1:
                        later.append(values[k] & 1)
                        continue
                    if values[k] == 0:
                        zeros += 1
                        if zeros == 16 and k <= last:
                            end_run(bits, state)
                            symbol(bits, 0xF0)
                            for x in later:
                                bits.put(x, 1)
                            zeros, later = 0, []
                        continue
                    end_run(bits, state)
                    symbol(bits, zeros << 4 | 1)
                    bits.put(1 if coefs[c][b][k] > 0 else 0, 1)
                    for x in later:
                        bits.put(x, 1)
                    zeros, later = 0, []
                if zeros or later:
                    state["run"] = state.get("run", 0) + 1
                    state.setdefault("later", []).extend(later)

            emit(blocks(c), refine, end_run)
    head(everyone, 0, 0, 1, 0)
    emit(mcus, lambda bits, mcu, _: [bits.put(int(coefs[c][b][0]) & 1, 1) for c, b in mcu], lambda *_: None)
    out.append(b"\xff\xd9")
    return b"".join(out)


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("restart", [0, 1, 3])
def test_decodes_what_a_scalar_coder_wrote(sampling, restart):
    rnd = np.random.default_rng(len(sampling) * 10 + restart)
    width, height = 37, 21
    hs, vs = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * hs)), -(-height // (8 * vs))
    coefs = []
    for h, v in sampling:
        x = np.rint(rnd.laplace(0, 3, (across * down * h * v, 64))).astype(int)
        x[rnd.random(x.shape) < 0.6] = 0
        x[:, 0] = rnd.integers(-200, 200, len(x))
        coefs.append(x)
    # blocks outside the image's own block grid are written by no AC scan
    for c, (h, v) in enumerate(sampling):
        wide, tall = -(-(-(-width * h // hs)) // 8), -(-(-(-height * v // vs)) // 8)
        if len(sampling) > 1 or True:
            place = np.arange(len(coefs[c]))
            outside = (place % (across * h) >= wide) | (place // (across * h) >= tall)
            coefs[c][outside, 1:] = 0
    data = scalar_progressive(coefs, width, height, sampling, [3] * 64, restart)
    image = J.parse(data)[0]
    J.decode([image])
    for c in range(len(sampling)):
        assert (image.coefs[c] == coefs[c]).all()
    tensor = J.to_rgb(image)
    assert tensor.shape == (height, width, 3)
    # against a transform in floating point, by its formula
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    block = np.zeros(64)
    block[J.zigzag()] = coefs[0][0] * 3
    plane = np.clip(basis @ block.reshape(8, 8) @ basis.T + 128, 0, 255)
    assert np.abs(image.blocks[0][0].reshape(8, 8) - plane).max() <= 1


def test_damaged_files_are_refused():
    good = J.encode_payloads([J.padded_payload(b"x" * 700)])[0]
    for bad in (b"", b"no jpeg", good[:50], good[:-2], b"\xff\xd8\xff\xd9", good.replace(b"\xff\xc2", b"\xff\xc0", 1)):
        with pytest.raises((ValueError, IndexError)):
            images = J.parse(bad)
            images[0]


def test_query_and_media_columns(docs, rows, empty, spark):
    made = J.media_features(docs).collect()
    assert Counter(r.doc_id for r in made) == Counter(r[0] for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r[0], (r[1] or "").encode())
    for r in made:
        payload = J.padded_payload(by_text[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(by_text[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert J.media_features(empty).collect() == []
    media = J.encode_media(docs, "text")
    decoded = {r.doc_id: r for r in J.decode_media(media).collect()}
    assert decoded[60].rgb is None and len(decoded[64].rgb) == decoded[64].height * decoded[64].width * 3
    junk = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "doc_id long, media binary")
    assert [r.rgb for r in J.decode_media(junk).collect()] == [None, None]
