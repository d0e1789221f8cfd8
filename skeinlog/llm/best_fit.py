"""Operator 2: packing token ids into rows of one length by best-fit decreasing.

Documents become pieces: an overlong document is cut into whole rows and a
remainder, losing nothing.  Pieces are taken from long to short; each goes into
the open row whose free room is the smallest that holds it.  A segment tree over
free room (0 to the capacity) finds it in logarithmic time: a node tells whether
any row with room in its range is open.

A task packs its documents in blocks of bounded tokens as they stream by, so no
shuffle is needed and memory does not grow with the input; a block of a million
tokens fills its rows to well over 99 per cent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from skeinlog.llm.common import steps

CAPACITY = 2048
BLOCK_TOKENS = 1 << 21


class RoomTree:
    """Open rows by free room, with search for the least room that is enough."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.base + room
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the open row with the least room of ``need`` or more, removed from the tree."""
        seen = self.any
        i = self.base + need
        while not seen[i]:
            # up while this is a right child, then over to the right sibling
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
            if i & (i - 1) == 0:
                return None
        while i < self.base:
            i <<= 1
            if not seen[i]:
                i += 1
        room = i - self.base
        row = self.rows[room].pop()
        if not self.rows[room]:
            seen[i] = 0
            i >>= 1
            while i:
                seen[i] = seen[2 * i] | seen[2 * i + 1]
                if seen[i]:
                    break
                i >>= 1
        return room, row


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Numbers of the pieces in each row; ``sizes`` are 1 to ``capacity``; equal sizes keep their order."""
    tree, rows = RoomTree(capacity), []
    for piece in np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist():
        size = sizes[piece]
        found = tree.take(size)
        if found is None:
            rows.append([piece])
            room, row = capacity, len(rows) - 1
        else:
            room, row = found
            rows[row].append(piece)
        if room > size:
            tree.put(room - size, row)
    return rows


def pack_block(docs: list[tuple[int | None, np.ndarray]], capacity: int) -> Iterator[dict]:
    """Packed rows of (id, token ids) documents."""
    pieces = [(doc, at, ids[at : at + capacity]) for doc, ids in docs for at in range(0, len(ids), capacity)]
    for row in best_fit([len(p[2]) for p in pieces], capacity):
        own = [pieces[i] for i in row]
        ends = np.cumsum([len(p[2]) for p in own])
        yield {
            "doc_ids": [p[0] for p in own],
            "token_starts": [p[1] for p in own],
            "cu_seqlens": [0, *ends.tolist()],
            "position_resets": [0, *ends[:-1].tolist()],
            "n_tokens": int(ends[-1]),
            "ids": np.concatenate([p[2] for p in own]),
        }


#: Columns of a packed row after ``doc_ids``.
_REST = StructType().add("token_starts", ArrayType(LongType())).add("cu_seqlens", ArrayType(IntegerType())).add("position_resets", ArrayType(IntegerType())).add("n_tokens", IntegerType()).add("ids", BinaryType())


def packed(
    df: DataFrame,
    encode: Callable[[list[str]], list[np.ndarray]],
    text: str = "text",
    doc: str = "doc_id",
    capacity: int = CAPACITY,
    block_tokens: int = BLOCK_TOKENS,
    pad_id: int = 0,
    dtype: str = "<u2",
) -> DataFrame:
    """Rows of ``capacity`` ids as bytes of ``dtype``, padded with ``pad_id``; ``encode`` maps texts to id arrays.

    ``doc_ids`` and ``token_starts`` say which document, and from which of its
    tokens on, each segment holds; ``cu_seqlens`` are the cumulative segment
    lengths; at ``position_resets`` positions start at 0 again.  A piece of a
    cut document starts at position 0 too.  Null and empty texts have no tokens
    and take no segment.  An id that ``dtype`` can't hold is an error.  Repeated rows are packed as often as they stand there;
    an empty table gives an empty one; other columns are not read.
    """
    kept = df.select(F.col(f"`{doc}`").alias("__doc"), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = StructType([StructType().add("doc_ids", ArrayType(kept.schema["__doc"].dataType)).fields[0], *_REST.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    top = np.iinfo(np.dtype(dtype)).max
    if pad_id > top:
        raise ValueError(f"{dtype} holds no pad id {pad_id}")

    def emit(docs: list) -> Iterator[pa.RecordBatch]:
        rows = list(pack_block(docs, capacity))
        for at in range(0, len(rows), 1024):
            some = rows[at : at + 1024]
            for r in some:
                ids = r["ids"]
                r["ids"] = np.concatenate((ids, np.full(capacity - len(ids), pad_id, ids.dtype))).astype(dtype).tobytes()
            yield pa.RecordBatch.from_pylist(some, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, tokens = [], 0
        for ids, texts in steps(batches, 1):
            for i, coded in zip(ids, encode([t or "" for t in texts]), strict=True):
                if len(coded):
                    if coded.max() > top:
                        raise ValueError(f"{dtype} holds no id {coded.max()}; give a wider type")
                    waiting.append((i, coded))
                    tokens += len(coded)
            if tokens >= block_tokens:
                yield from emit(waiting)
                waiting, tokens = [], 0
        if waiting:
            yield from emit(waiting)

    return kept.mapInArrow(run, schema)


def encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids of texts under a byte-level BPE vocabulary, by rank-synchronous merging with a cache."""

    def encode(texts: list[str]) -> list[np.ndarray]:
        from skeinlog.llm.rank_merge import id_coder

        return [np.frombuffer(b"".join(codes), "<i4") for codes in id_coder(path).lists(texts)]

    return encode


def unpacked(rows: DataFrame, dtype: str = "<u2") -> DataFrame:
    """``doc_id``, ``token_start`` and ``ids`` (array of int) of every segment: what packing started from."""
    schema = StructType([StructType().add("doc_id", rows.schema["doc_ids"].dataType.elementType).fields[0]]).add("token_start", "long").add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                flat, ends = np.frombuffer(r["ids"], dtype), r["cu_seqlens"]
                out += [(d, s, flat[a:z].tolist()) for d, s, a, z in zip(r["doc_ids"], r["token_starts"], ends, ends[1:])]
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32()))], names=["doc_id", "token_start", "ids"])

    return rows.select("doc_ids", "token_starts", "cu_seqlens", "ids").mapInArrow(run, schema)


def write_matrices(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: id matrix rows, cumulative lengths and position resets."""
    rows.write.mode("overwrite").parquet(path)
