"""Operator 1: progressive JPEG as a media column.

A frame's coefficients are arrays that its scans fill in: DC and AC bands by
spectral selection, bits by successive approximation.  Entropy-coded segments
between restart markers are independent, so all segments of a scan, over all
images of a batch that share one scan script, are decoded side by side: a step
reads one symbol in every segment with a handful of numpy operations.  An image
without restart markers is one segment and decodes by the same code.  After the
last scan the coefficients are inverse-transformed, chroma is upsampled, and the
image is a full-resolution RGB tensor.

``encode_payload`` stores bytes losslessly: every byte is one quantised
coefficient, which JPEG keeps exactly, in 4:2:0 frames one MCU (384 bytes) wide
with a restart at every MCU and nine scans.  Long payloads take several frames
of at most 4,095 MCUs, one behind the other.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.llm.common import cuts, map_text

UNIT = 576
MCU_BYTES = 384
FRAME_MCUS = 4095


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((r + c, (r if (r + c) & 1 else c), r, c) for r in range(8) for c in range(8)))
    return np.array([8 * r + c for _, _, r, c in cells])


@functools.lru_cache(maxsize=1)
def transform_matrix() -> np.ndarray:
    """Zigzag coefficients to samples, times 2**13, in whole numbers: sums of them are exact in float64."""
    x = np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.5), 1.0)[:, None] / 2
    return np.rint(np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)[zigzag()] * 8192)


# Huffman tables


@functools.lru_cache(maxsize=256)
def huffman_lookup(spec: bytes) -> np.ndarray:
    """For every 16-bit window: code length * 256 + symbol; length 0 where no code fits."""
    counts, symbols = spec[:16], spec[16:]
    out, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            width = 1 << (16 - length)
            out[code << (16 - length) : (code << (16 - length)) + width] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def huffman_spec(lengths: dict[int, int]) -> bytes:
    """DHT counts and symbols for symbols of the given code lengths."""
    ordered = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(v == n for v in lengths.values()) for n in range(1, 17)) + bytes(ordered)


def huffman_codes(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol."""
    codes, sizes, code, k = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            codes[spec[16 + k]], sizes[spec[16 + k]] = code, length
            code, k = code + 1, k + 1
        code <<= 1
    return codes, sizes


#: Code lengths of our frames' tables (DC categories; AC categories 1 to 7 without runs; end of block).
DC_SPEC = huffman_spec({0: 3, 1: 4, 2: 4, 3: 3, 4: 3, 5: 3, 6: 3, 7: 4, 8: 4})
AC_SPEC = huffman_spec({4: 2, 3: 2, 5: 2, 6: 3, 1: 5, 2: 5, 7: 5})
END_SPEC = huffman_spec({0: 1})

#: Components, band, and high and low bit of our scans.
SCRIPT = [
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 5, 0, 1),
    ((0,), 6, 63, 0, 1),
    ((1,), 1, 63, 0, 1),
    ((2,), 1, 63, 0, 1),
    ((0, 1, 2), 0, 0, 1, 0),
    ((0,), 1, 63, 1, 0),
    ((1,), 1, 63, 1, 0),
    ((2,), 1, 63, 1, 0),
]


# encoder


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _bits_of(values: np.ndarray, sizes: np.ndarray, width: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``width`` bits, left-aligned, and which of them count."""
    aligned = (values << (width - sizes)).astype(">u2")
    bits = np.unpackbits(np.ascontiguousarray(aligned).view(np.uint8).reshape(*values.shape, 2), axis=-1)
    return bits, np.arange(width, dtype=np.int64) < sizes[..., None]


def _category(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Category of each value and its extra bits."""
    size = np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)
    return size, np.where(v < 0, v + (1 << size) - 1, v).astype(np.int64)


def _lanes(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all lanes (rows), each padded with ones to whole bytes, and each lane's number of bytes."""
    used = sizes.sum(axis=1)
    pad = -used % 8
    codes = np.concatenate((codes, ((1 << pad) - 1)[:, None]), axis=1)
    sizes = np.concatenate((sizes, pad[:, None]), axis=1)
    out, rows = [], max(1, (1 << 19) // codes.shape[1])
    for i in range(0, len(codes), rows):
        bits, real = _bits_of(codes[i : i + rows], sizes[i : i + rows])
        out.append(np.packbits(bits[real]))
    return np.concatenate(out), (used + pad) // 8


def _with_markers(data: np.ndarray, lane_bytes: np.ndarray, place: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuffed bytes with restart markers between a frame's lanes, and each lane's number of bytes then.

    ``place`` is a lane's number in its frame, ``last`` tells a frame's last lane.
    """
    ends = np.cumsum(lane_bytes) - 1
    full = data == 255
    room = 1 + full.astype(np.int64)
    room[ends] += np.where(last, 0, 2)
    at = np.cumsum(room) - room
    out = np.zeros(int(at[-1] + room[-1]), np.uint8)
    out[at] = data
    marked = ends[~last]
    where = at[marked] + 1 + full[marked]
    out[where] = 255
    out[where + 1] = 0xD0 + (place[~last] & 7)
    return out, np.add.reduceat(room, np.concatenate(([0], ends[:-1] + 1)))


def encode_frames(payloads: list[bytes]) -> list[bytes]:
    """One JPEG file for each payload of 1 to 4,095 MCUs."""
    mcus = np.array([-(-len(p) // MCU_BYTES) for p in payloads], np.int64)
    padded = b"".join(p.ljust(m * MCU_BYTES, b"\xff") for p, m in zip(payloads, mcus.tolist(), strict=True))
    b = np.frombuffer(padded, np.uint8).astype(np.int64).reshape(-1, 6, 64)
    v = np.where(b < 128, b - 130, b - 126)
    n = len(v)
    first = np.cumsum(mcus) - mcus
    place = np.arange(n) - np.repeat(first, mcus)
    last = np.zeros(n, bool)
    last[np.cumsum(mcus) - 1] = True
    parts = {0: v[:, :4], 1: v[:, 4:5], 2: v[:, 5:6]}
    dc_codes, dc_sizes = huffman_codes(DC_SPEC)
    ac_codes, ac_sizes = huffman_codes(AC_SPEC)
    made = []
    for comps, low, high, before, shift in SCRIPT:
        if low == 0 and not before:
            dc = v[:, :, 0] >> shift
            diff = dc.copy()
            diff[:, 1:4] -= dc[:, :3]
            size, extra = _category(diff)
            data, lane = _lanes(dc_codes[size] << size | extra, dc_sizes[size] + size)
        elif low == 0:
            bits = np.ones((n, 8), np.uint8)
            bits[:, :6] = v[:, :, 0] & 1
            data, lane = np.packbits(bits, axis=1).reshape(-1), np.ones(n, np.int64)
        elif not before:
            band = parts[comps[0]][:, :, low : high + 1].reshape(n, -1)
            size, extra = _category(np.sign(band) * (np.abs(band) >> shift))
            data, lane = _lanes(ac_codes[size] << size | extra, ac_sizes[size] + size)
        else:
            band = parts[comps[0]]
            bits = np.zeros((n, band.shape[1], 64), np.uint8)
            bits[:, :, 1:] = np.abs(band[:, :, 1:]) & 1
            data, lane = np.packbits(bits.reshape(n, -1), axis=1).reshape(-1), np.full(n, 8 * band.shape[1], np.int64)
        out, lane_bytes = _with_markers(data, lane, place, last)
        ends = np.cumsum(np.add.reduceat(lane_bytes, first)).tolist()
        flat = out.tobytes()
        made.append([flat[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)])
    # tables of the AC scans stand before the first of each kind; the interval counts the blocks of an MCU
    heads = []
    for k, (comps, low, high, before, shift) in enumerate(SCRIPT):
        spec = b""
        if k == 0:
            spec = _segment(0xC4, b"\x00" + DC_SPEC) + _segment(0xC4, b"\x10" + AC_SPEC)
        elif k == 6:
            spec = _segment(0xC4, b"\x10" + END_SPEC)
        interval = _segment(0xDD, struct.pack(">H", 4 if comps == (0,) else 1))
        body = bytes([len(comps)]) + b"".join(bytes([c + 1, 0]) for c in comps) + bytes([low, high, before << 4 | shift])
        heads.append(spec + interval + _segment(0xDA, body))
    quant = _segment(0xDB, b"\x00" + b"\x01" * 64)
    files = []
    for i, (p, m) in enumerate(zip(payloads, mcus.tolist(), strict=True)):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * m, 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        note = _segment(0xFE, b"payload" + struct.pack(">Q", len(p)))
        files.append(b"".join([b"\xff\xd8", note, quant, frame, *[x for h, scan in zip(heads, made, strict=True) for x in (h, scan[i])], b"\xff\xd9"]))
    return files


def padded_payload(text: bytes) -> bytes:
    """The bytes, then bytes 255 up to a positive multiple of ``UNIT``."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b"\xff")


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload: its frames, one behind the other."""
    step = FRAME_MCUS * MCU_BYTES
    cut = [[p[i : i + step] for i in range(0, len(p), step)] for p in payloads]
    frames = iter(encode_frames([x for xs in cut for x in xs]))
    return [b"".join(next(frames) for _ in xs) for xs in cut]


# decoder


@dataclass
class Image:
    """A parsed file: frame, scans and notes; ``coefs`` after decoding, by component, blocks of 64 in zigzag order."""

    width: int = 0
    height: int = 0
    comps: list = field(default_factory=list)  # (id, h, v, quantiser)
    scans: list = field(default_factory=list)  # (components, low, high, before, shift, specs, interval, data)
    notes: list = field(default_factory=list)
    coefs: list = field(default_factory=list)
    blocks: list = field(default_factory=list)  # the same blocks as samples, after decoding

    def grid(self) -> tuple[int, int]:
        """MCUs across and down."""
        h, v = max(c[1] for c in self.comps), max(c[2] for c in self.comps)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def script(self) -> tuple:
        return tuple((c[1], c[2]) for c in self.comps), tuple(s[:7] for s in self.scans)


_NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)


def parse(data: bytes) -> list[Image]:
    """The images in ``data``, not yet decoded; ValueError for what is no progressive JPEG of Huffman type."""
    images, at = [], 0
    image, quant, tables, interval = None, {}, {}, 0
    try:
        while at < len(data):
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            at += 2
            if marker == 0xFF:
                at -= 1
                continue
            if marker == 0xD8:
                image, quant, tables, interval = Image(), {}, {}, 0
                continue
            if image is None:
                raise ValueError("no start of image")
            if marker == 0xD9:
                if not image.comps or not image.scans:
                    raise ValueError("no frame")
                image.comps = [(i, h, v, quant[q]) for i, h, v, q in image.comps]
                images.append(image)
                image = None
                continue
            size = struct.unpack_from(">H", data, at)[0]
            body = data[at + 2 : at + size]
            at += size
            if marker == 0xDB:
                while body:
                    wide, q = body[0] >> 4, body[0] & 15
                    n = 128 if wide else 64
                    quant[q] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == 0xC2:
                depth, image.height, image.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8 or n not in (1, 3) or not image.width or not image.height:
                    raise ValueError("this kind of frame isn't read")
                image.comps = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("no progressive frame of Huffman type")
            elif marker == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                image.notes.append(body)
            elif marker == 0xDA:
                n = body[0]
                ids = [c[0] for c in image.comps]
                comps = tuple(ids.index(body[1 + 2 * k]) for k in range(n))
                low, high, bits = body[1 + 2 * n : 4 + 2 * n]
                specs = tuple(tables.get((body[2 + 2 * k] >> 4) if low == 0 else 0x10 | body[2 + 2 * k] & 15, b"") for k in range(n))
                found = _NEXT.search(data, at)
                end = found.start() if found else len(data)
                image.scans.append((comps, low, high, bits >> 4, bits & 15, specs, interval, data[at:end]))
                at = end
    except (IndexError, KeyError, struct.error) as wrong:
        raise ValueError("the file is cut or damaged") from wrong
    if image is not None:
        raise ValueError("no end of image")
    return images


class _Lanes:
    """Bit readers of all segments of one scan over a group of images."""

    def __init__(self, pieces: list[bytes]):
        b = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        starts = np.cumsum(sizes) - sizes
        after = np.concatenate((b[1:], [0])).astype(np.uint8)
        restart = (b == 255) & (after >= 0xD0) & (after <= 0xD7)
        keep = ~restart
        at = np.flatnonzero(restart)
        keep[at + 1] = False
        stuffed = np.flatnonzero((b == 255) & (after == 0)) + 1
        keep[stuffed[stuffed < len(b)]] = False
        keep[starts[(sizes > 0)]] |= b[starts[sizes > 0]] == 0  # a zero that opens an image follows no 255 of its own
        clean = np.concatenate((b[keep], np.full(8, 255, np.uint8))).astype(np.uint32)
        self.window = (clean[:-3] << 24) | (clean[1:-2] << 16) | (clean[2:-1] << 8) | clean[3:]
        kept = np.concatenate(([0], np.cumsum(keep)))
        begin = np.sort(np.concatenate((starts, at + 2)), kind="stable")
        self.pos = kept[begin] * 8
        self.per_image = np.array([1] * len(pieces)) + np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(pieces))

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """32 bits, at least the first 25 of them good."""
        return self.window[pos >> 3] << (pos & 7).astype(np.uint32)


def _extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


def _decode_scan(images: list[Image], k: int, coefs: list[np.ndarray], bases: list[np.ndarray]) -> None:
    """Scan ``k`` of every image of a group into ``coefs`` (blocks of all images by component)."""
    comps, low, high, before, shift, specs, interval, _ = images[0].scans[k]
    lanes = _Lanes([im.scans[k][7] for im in images])
    order, counts, owner = [], [], []
    for i, im in enumerate(images):
        across, down = im.grid()
        hs, vs = max(c[1] for c in im.comps), max(c[2] for c in im.comps)
        if len(comps) > 1:
            units = []
            for c in comps:
                h, v = im.comps[c][1:3]
                if across == 1:
                    units.append(np.arange(bases[c][i], bases[c][i] + down * v * h).reshape(down, v * h))
                    continue
                my, mx, y, x = np.ix_(range(down), range(across), range(v), range(h))
                units.append((bases[c][i] + (my * v + y) * across * h + mx * h + x).reshape(down * across, v * h))
            blocks = np.concatenate(units, axis=1)
            owner = np.concatenate([np.full(u.shape[1], c) for u, c in zip(units, comps, strict=True)])
        else:
            c = comps[0]
            h, v = im.comps[c][1:3]
            wide, tall = -(-(-(-im.width * h // hs)) // 8), -(-(-(-im.height * v // vs)) // 8)
            if wide == across * h:
                blocks = np.arange(bases[c][i], bases[c][i] + wide * tall).reshape(-1, 1)
            else:
                rows, cols = np.ix_(range(tall), range(wide))
                blocks = (bases[c][i] + rows * across * h + cols).reshape(-1, 1)
            owner = np.array([c])
        n = len(blocks)
        step = interval or n
        if lanes.per_image[i] != -(-n // step):
            raise ValueError("restart markers are missing")
        order.append(blocks.reshape(-1))
        full, rest = divmod(n, step)
        counts += [step * blocks.shape[1]] * full + [rest * blocks.shape[1]] * (rest > 0)
    order, counts = np.concatenate(order), np.array(counts, np.int64)
    begin = np.cumsum(counts) - counts
    pos, width = lanes.pos, len(owner)
    everyone = np.arange(len(counts))
    even = (counts == counts[0]).all()
    if low == 0:
        lookups = {c: huffman_lookup(s) for c, s in zip(comps, specs, strict=True)} if not before else {}
        last = {c: np.zeros(len(counts), np.int64) for c in comps}
        for j in range(int(counts.max())):
            on = everyone if even else np.flatnonzero(counts > j)
            c = int(owner[j % width])
            block, p = order[begin[on] + j], pos[on]
            if before:
                coefs[c][block, 0] |= ((lanes.peek(p) >> 31).astype(np.int16)) << shift
                pos[on] = p + 1
                continue
            code = lookups[c][lanes.peek(p) >> 16]
            if not (code >> 8).all():
                raise ValueError("a code is unknown")
            p += code >> 8
            size = (code & 255).astype(np.int64)
            bits = (lanes.peek(p).astype(np.int64) >> (32 - size)) * (size > 0)
            pos[on] = p + size
            last[c][on] += _extended(bits, size)
            coefs[c][block, 0] = last[c][on] << shift
        return
    c = comps[0]
    flat = coefs[c].reshape(-1)
    lookup, run = huffman_lookup(specs[0]), np.zeros(len(counts), np.int64)
    for j in range(int(counts.max())):
        on = everyone if even else np.flatnonzero(counts > j)
        block = order[begin[on] + j]
        if before:
            _refine_block(lanes, lookup, on, coefs[c], block, low, high, shift, run)
            continue
        waiting = run[on] > 0
        if waiting.any():
            run[on[waiting]] -= 1
            on, block = on[~waiting], block[~waiting]
        p, place, top = pos[on], block * 64 + low, block * 64 + high
        while len(on):
            window = lanes.peek(p)
            code = lookup[window >> 16]
            length, symbol = code >> 8, code & 255
            if not length.all():
                raise ValueError("a code is unknown")
            size = symbol & 15
            zeros = symbol >> 4
            p = p + length
            window = lanes.peek(p) if int(length.max()) + 15 > 25 else window << length.astype(np.uint32)
            if size.all():
                bits = (window >> (32 - size).astype(np.uint32)).astype(np.int32)
                p += size
                place = place + zeros
                if (place > top).any():
                    raise ValueError("a run leaves the band")
                half = 1 << (size - 1)
                flat[place] = np.where(bits < half, bits - 2 * half + 1, bits) << shift
                place += 1
            else:
                ends = (size == 0) & (zeros < 15)
                some = size > 0
                take = np.where(some, size, np.where(ends, zeros, 0)).astype(np.int64)
                bits = (window.astype(np.int64) & 0xFFFFFFFF) >> (32 - take)
                bits *= take > 0
                p += take
                place = place + np.where(ends, 0, zeros)
                if (place[some] > top[some]).any():
                    raise ValueError("a run leaves the band")
                flat[place[some]] = _extended(bits[some], take[some]) << shift
                place = np.where(ends, top + 1, place + 1)
                run[on[ends]] = (1 << zeros[ends].astype(np.int64)) + bits[ends] - 1
            done = place > top
            if done.all():
                pos[on] = p
                break
            if done.any():
                pos[on[done]] = p[done]
                on, p, place, top = on[~done], p[~done], place[~done], top[~done]


def _refine_block(lanes: _Lanes, lookup: np.ndarray, on: np.ndarray, coefs: np.ndarray, block: np.ndarray, low: int, high: int, shift: int, run: np.ndarray) -> None:
    """One block in every lane of ``on``: a further bit of the coefficients that are not zero yet and of new ones."""
    band = np.arange(high - low + 1)
    k = np.zeros(len(on), np.int64)
    p = lanes.pos[on]
    values = coefs[block, low : high + 1]
    while len(on):
        waiting = run[on] > 0
        code = lookup[lanes.peek(p) >> 16]
        if not (waiting | (code >> 8 > 0)).all():
            raise ValueError("a code is unknown")
        symbol = np.where(waiting, 0, code & 255)
        p = p + np.where(waiting, 0, code >> 8)
        size, zeros = symbol & 15, (symbol >> 4).astype(np.int64)
        ends = (size == 0) & (zeros < 15)
        window = lanes.peek(p).astype(np.int64)
        take = np.where(size > 0, 1, np.where(ends & ~waiting, zeros, 0))
        bits = (window >> (32 - take)) * (take > 0)
        p += take
        fresh = ends & ~waiting
        run[on[fresh]] = (1 << zeros[fresh]) + bits[fresh]
        known = values != 0
        ahead = band >= k[:, None]
        if ends.all():
            stop = np.full(len(on), len(band))
        else:
            open_ = np.cumsum(~known & ahead, axis=1)
            hit = open_ == (zeros + 1)[:, None]
            stop = np.where(ends | ~hit.any(axis=1), len(band), hit.argmax(axis=1))
        fix = known & ahead & (band < stop[:, None])
        rank = np.cumsum(fix, axis=1)
        at = p[:, None] + rank - 1
        bit = (lanes.window[at >> 3] >> (31 - (at & 7)).astype(np.uint32)) & 1
        values += (np.sign(values) * (bit.astype(np.int16) << shift) * fix).astype(values.dtype)
        p += rank[:, -1]
        new = np.flatnonzero((size > 0) & (stop < len(band)))
        values[new, stop[new]] = np.where(bits[new] > 0, 1, -1) << shift
        run[on[ends]] -= 1
        k = stop + 1
        done = k > len(band) - 1
        coefs[block[done], low : high + 1] = values[done]
        lanes.pos[on[done]] = p[done]
        if done.all():
            break
        on, block, p, k, values = on[~done], block[~done], p[~done], k[~done], values[~done]


def decode(images: list[Image]) -> None:
    """Fill ``coefs`` of all images; those that share a scan script are decoded together."""
    groups: dict = {}
    for im in images:
        groups.setdefault(im.script(), []).append(im)
    for group in groups.values():
        n = len(group[0].comps)
        sizes = [np.array([np.prod(im.grid()) * im.comps[c][1] * im.comps[c][2] for im in group], np.int64) for c in range(n)]
        bases = [np.cumsum(s) - s for s in sizes]
        coefs = [np.zeros((int(s.sum()), 64), np.int16) for s in sizes]
        for k in range(len(group[0].scans)):
            _decode_scan(group, k, coefs, bases)
        for i, im in enumerate(group):
            im.coefs = [coefs[c][bases[c][i] : bases[c][i] + sizes[c][i]] for c in range(n)]
        same = {tuple(c[3].tobytes() for c in im.comps) for im in group}
        if len(same) == 1:
            made = [samples(x, group[0].comps[c][3]) for c, x in enumerate(coefs)]
            for i, im in enumerate(group):
                im.blocks = [made[c][bases[c][i] : bases[c][i] + sizes[c][i]] for c in range(n)]
        else:
            for im in group:
                im.blocks = [samples(x, c[3]) for x, c in zip(im.coefs, im.comps, strict=True)]


def samples(blocks: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8 x 8 samples (0 to 255) of blocks of zigzag coefficients."""
    out = np.empty((len(blocks), 64), np.uint8)
    matrix = transform_matrix() * quant[:, None]
    for i in range(0, len(blocks), 1 << 12):
        made = blocks[i : i + (1 << 12)].astype(np.float64) @ matrix
        out[i : i + (1 << 12)] = np.clip(np.floor((made + 4096) / 8192) + 128, 0, 255)
    return out


def planes_to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """RGB of full-size planes in whole-number arithmetic."""
    y, cb, cr = y.astype(np.int32), cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    r = y + ((91881 * cr + 32768) >> 16)
    g = y - ((22554 * cb + 46802 * cr + 32768) >> 16)
    b = y + ((116130 * cb + 32768) >> 16)
    return np.clip(np.stack((r, g, b), axis=-1), 0, 255).astype(np.uint8)


def to_rgb(im: Image) -> np.ndarray:
    """The tensor (height, width, 3) of a decoded image; chroma is upsampled by repetition."""
    across, down = im.grid()
    hs, vs = max(c[1] for c in im.comps), max(c[2] for c in im.comps)
    planes = []
    for (_, h, v, _), blocks in zip(im.comps, im.blocks, strict=True):
        plane = blocks.reshape(down * v, across * h, 8, 8).transpose(0, 2, 1, 3).reshape(down * v * 8, across * h * 8)
        if (vs, hs) != (v, h):
            plane = np.repeat(np.repeat(plane, vs // v, axis=0), hs // h, axis=1)
        planes.append(plane[: im.height, : im.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    return planes_to_rgb(*planes)


def payload_of(images: list[Image]) -> bytes:
    """The bytes that ``encode_payloads`` stored, read from the coefficients."""
    out = []
    for im in images:
        v = np.concatenate((im.coefs[0].reshape(-1, 4, 64), im.coefs[1][:, None], im.coefs[2][:, None]), axis=1).reshape(-1)
        size = struct.unpack(">Q", next(x for x in im.notes if x[:7] == b"payload")[7:])[0]
        out.append(np.where(v < 0, v + 130, v + 126).astype(np.uint8)[:size].tobytes())
    return b"".join(out)


def feature(tensors: list[np.ndarray]) -> str:
    """Shape, mean colour, mean square of the green channel and mean step between rows, over the tensors of one file."""
    n = sum(t.shape[0] * t.shape[1] for t in tensors)
    sums, square, steps = np.zeros(3, np.int64), 0, 0
    for t in tensors:
        sums += t.reshape(-1, 3).sum(axis=0, dtype=np.int64)
        green = t[:, :, 1].astype(np.int64)
        square += int(np.vdot(green, green))
        steps += int(np.abs(green[1:] - green[:-1]).sum())
    shape = f"{sum(t.shape[0] for t in tensors)}x{tensors[0].shape[1]}x3"
    return ";".join([shape, *[f"{int(s) / n:.4f}" for s in sums], f"{square / n:.3f}", f"{steps / n:.4f}"])


#: Payload bytes decoded side by side.
STEP = 2 << 20


def media_rows(texts: list[str | None]) -> list[list]:
    """Columns of ``media_features`` for a list of texts."""
    raw = [(t or "").encode() for t in texts]
    stored = encode_payloads([padded_payload(r) for r in raw])
    parsed = [parse(s) for s in stored]
    decode([im for ims in parsed for im in ims])
    out: list[list] = [[] for _ in range(7)]
    for r, s, ims in zip(raw, stored, parsed, strict=True):
        back = payload_of(ims)
        row = (len(r), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(s), hashlib.sha256(s).hexdigest(), feature([to_rgb(im) for im in ims]))
        for column, value in zip(out, row, strict=True):
            column.append(value)
    return out


def media_features(df: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """Store each text as progressive JPEG, read the stored bytes back, and return digests and image features.

    Null and empty texts store one unit of bytes 255.  Equal texts give equal
    values, whatever stands beside them.  Repeated rows give repeated results;
    an empty table gives an empty one; other columns are not read.
    """
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_text(df, keys or ["doc_id"], text, schema, lambda: media_rows, STEP)


def encode_media(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """``keys`` and ``media`` (binary): the stored form of a binary or text column; null gives null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in cuts(batch.column(batch.num_columns - 1), STEP):
                part = batch.slice(a, b - a)
                held = part.column(part.num_columns - 1).to_pylist()
                made = iter(encode_payloads([padded_payload(h) for h in held if h is not None]))
                media = pa.array([None if h is None else next(made) for h in held], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], media], names=[*part.schema.names[:-1], "media"])

    kept = df.select(*[F.col(f"`{k}`") for k in keys or ["doc_id"]], F.col(f"`{column}`").cast("binary").alias("__bytes"))
    schema = kept.drop("__bytes").schema
    return kept.mapInArrow(work, schema.add("media", "binary"))


def decode_media(df: DataFrame, column: str = "media", keys: list[str] | None = None) -> DataFrame:
    """``keys``, ``frame`` (from 0), ``height``, ``width`` and ``rgb`` (row-major bytes) of every image in a binary column.

    Long payloads are stored as several frames; each gives a row.  A null
    value, or bytes that are no progressive JPEG, give one row of nulls.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, held in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                try:
                    images = parse(held or b"")
                    decode(images)
                    tensors = [to_rgb(im) for im in images]
                    rows = [(k, *t.shape[:2], t.tobytes()) for k, t in enumerate(tensors)]
                except (ValueError, IndexError):
                    rows = []
                rows = rows or [(None, None, None, None)]
                keys_of = batch.slice(at, 1).take(pa.array([0] * len(rows)))
                more = [pa.array([r[i] for r in rows], pa.binary() if i == 3 else pa.int32()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*keys_of.columns[:-1], *more], names=[*batch.schema.names[:-1], "frame", "height", "width", "rgb"])

    kept = df.select(*[F.col(f"`{k}`") for k in keys or ["doc_id"]], F.col(f"`{column}`").alias("__bytes"))
    schema = kept.drop("__bytes").schema
    return kept.mapInArrow(work, schema.add("frame", "integer").add("height", "integer").add("width", "integer").add("rgb", "binary"))
