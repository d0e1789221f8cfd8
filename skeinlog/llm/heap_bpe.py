"""Operator 9: BPE by a priority queue of merge ranks, and its decoder.

A pre-token's bytes are a doubly linked list of symbols.  The queue holds
rank and place of adjacent pairs; an entry is stale, and skipped, if no pair of
that rank begins at its place any more.  A merge writes
the new symbol over the left one, unlinks the right one and queues the two new
pairs.  Decoding joins the vocabulary strings of the ids.
"""

from __future__ import annotations

import functools
import hashlib
import sys
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame

from skeinlog.llm.common import map_text
from skeinlog.llm.vocab import IdCoder, Vocabulary, load


def encode_piece(data: bytes, byte_ids: list[int], pairs: dict) -> list[int]:
    """Token ids of one pre-token."""
    symbols = [byte_ids[b] for b in data]
    n = len(symbols)
    if n < 2:
        return symbols
    get = pairs.get
    # (rank, merged id) of the pair that begins at each place, if it is one; the queue holds rank * n + place
    held = [get(pair) for pair in zip(symbols, symbols[1:], strict=False)]
    held.append(None)
    queue = [found[0] * n + i for i, found in enumerate(held) if found is not None]
    if not queue:
        return symbols
    heapify(queue)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while queue:
        rank, i = divmod(heappop(queue), n)
        found = held[i]
        if found is None or found[0] != rank:
            continue
        made, j = found[1], after[i]
        symbols[i], symbols[j], held[j] = made, -1, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = held[i] = get((made, symbols[k]))
            if found is not None:
                heappush(queue, found[0] * n + i)
        else:
            held[i] = None
        h = before[i]
        if h >= 0:
            found = held[h] = get((symbols[h], made))
            if found is not None:
                heappush(queue, found[0] * n + h)
    return [s for s in symbols if s >= 0]


def encode_pieces(vocabulary: Vocabulary, pieces: list[str]) -> list[bytes]:
    """Little-endian int32 ids of each pre-token, as bytes."""
    byte_ids, pairs = vocabulary.byte_ids.tolist(), vocabulary.pairs
    made = [array("i", encode_piece(p.encode(), byte_ids, pairs)) for p in pieces]
    if sys.byteorder == "big":
        for ids in made:
            ids.byteswap()
    return [ids.tobytes() for ids in made]


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of the ids: their vocabulary strings, joined and read as UTF-8 (U+FFFD for broken bytes)."""
    return b"".join(map(vocabulary.id_bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def coder(path: str, cache_bytes: int = IdCoder.CACHE_BYTES) -> IdCoder:
    """One coder a worker process, so that tasks share its cache."""
    vocabulary = load(path)
    made = IdCoder(vocabulary, lambda pieces: encode_pieces(vocabulary, pieces))
    made.CACHE_BYTES = cache_bytes
    return made


def encode_texts(path: str, texts: list[str], cache_bytes: int = IdCoder.CACHE_BYTES) -> list[np.ndarray]:
    """Ids of whole texts as int32 arrays."""
    return [np.frombuffer(b"".join(codes), "<i4") for codes in coder(path, cache_bytes).lists(texts)]


def encode_documents(df: DataFrame, path: str, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """``keys`` and ``ids`` (array of int) of every row; null and empty texts give an empty array."""

    def make():
        def work(texts):
            return [[ids.tolist() for ids in encode_texts(path, [t or "" for t in texts])]]

        return work

    return map_text(df, keys or ["doc_id"], text, "ids array<int>", make)


def decode_documents(df: DataFrame, path: str, ids: str = "ids", keys: list[str] | None = None) -> DataFrame:
    """``keys`` and ``decoded`` of every row of an ``ids`` table; null ids give an empty text."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def undo(column):
        vocabulary = load(path)
        return column.map(lambda row: decode(vocabulary, [] if row is None else list(row)))

    return df.select(*[F.col(f"`{k}`") for k in keys or ["doc_id"]], undo(F.col(f"`{ids}`")).alias("decoded"))


def round_trip(df: DataFrame, path: str, text: str = "text", keys: list[str] | None = None, cache_bytes: int = IdCoder.CACHE_BYTES) -> DataFrame:
    """``keys``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row.

    The ids are hashed as decimal numbers joined by commas; the decoded text is
    hashed as UTF-8.  Null and empty texts give no ids and an empty text.
    Repeated rows give repeated results; an empty table gives an empty one.
    """

    def make():
        vocabulary = load(path)
        decimal = [str(i) for i in range(vocabulary.size)]

        def work(texts):
            counts, ids_hash, text_hash = [], [], []
            for ids in encode_texts(path, [t or "" for t in texts], cache_bytes):
                ids = ids.tolist()
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(decode(vocabulary, ids).encode()).hexdigest())
            return [counts, ids_hash, text_hash]

        return work

    return map_text(df, keys or ["doc_id"], text, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
