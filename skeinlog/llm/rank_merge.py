"""Operator 7: token counts by rank-synchronous merging of ragged arrays.

A batch of pre-tokens is held as one flat array of symbol ids with the number
of its sequence beside every symbol.  A round looks up the rank of every
adjacent pair, takes each sequence's lowest rank, and merges all places of that
pair, left to right without overlap, in all sequences at once.  Sequences
without a mergeable pair leave the batch.  What survives is the token sequence.

Merging every place of the lowest pair at once equals merging the leftmost
lowest pair again and again, because a pair that holds a merged symbol always
ranks after the merge that makes the symbol.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame

from skeinlog.llm.common import map_text
from skeinlog.llm.vocab import CountCoder, IdCoder, Vocabulary, load

_NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressed table of (left, right) -> (rank, merged id) in arrays."""

    def __init__(self, vocabulary: Vocabulary):
        self.byte_ids, self.width = vocabulary.byte_ids, vocabulary.size
        items = vocabulary.pairs
        bits = max(8, (4 * len(items)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        keys = np.fromiter((a * self.width + b for a, b in items), np.int64, len(items))
        ranks = np.fromiter((r for r, _ in items.values()), np.int32, len(items))
        made = np.fromiter((m for _, m in items.values()), np.int32, len(items))
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, _NONE, np.int32)
        self.made = np.zeros(1 << bits, np.int32)
        todo, slot = np.arange(len(items)), self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.ranks[slot[put]], self.made[slot[put]] = keys[todo[put]], ranks[todo[put]], made[todo[put]]
            todo, slot = todo[~put], (slot[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; a slot of another key means that there is none."""
        keys = left.astype(np.int64) * self.width + right
        slot = self._slot(keys)
        held = self.keys[slot]
        miss = np.flatnonzero((held != keys) & (held != -1))
        for _ in range(self.probes):
            if not len(miss):
                break
            slot[miss] = (slot[miss] + 1) & self.mask
            held_now = self.keys[slot[miss]]
            miss = miss[(held_now != keys[miss]) & (held_now != -1)]
        return np.where(self.keys[slot] == keys, slot, -1)


@functools.lru_cache(maxsize=4)
def pair_table(path: str) -> PairTable:
    return PairTable(load(path))


def merge_ragged(table: PairTable, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces, flat, and the number of tokens of each piece."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbols = table.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), sizes)
    counts = sizes.copy()
    done_symbols, done_owner = [], []
    live, ids = symbols, owner
    ranks = None
    while len(live):
        n = len(live)
        same = ids[:-1] == ids[1:]
        slot = np.full(n, -1, np.int64)
        at = np.flatnonzero(same)
        slot[at] = table.find(live[at], live[at + 1])
        ranks = np.where(slot >= 0, table.ranks[slot], _NONE)
        starts = np.flatnonzero(np.concatenate(([True], ~same)))
        lowest = np.minimum.reduceat(ranks, starts)
        lengths = np.diff(np.append(starts, n))
        low = np.repeat(lowest, lengths)
        over = low == _NONE
        if over.any():
            done_symbols.append(live[over])
            done_owner.append(ids[over])
            keep = ~over
            live, ids, ranks, low, slot = live[keep], ids[keep], ranks[keep], low[keep], slot[keep]
            if not len(live):
                break
        hit = ranks == low
        # in a run of overlapping places (x x x x) every second one is taken, from the left
        if (hit[1:] & hit[:-1]).any():
            place = np.arange(len(hit))
            start = hit & ~np.concatenate(([False], hit[:-1]))
            run = np.maximum.accumulate(np.where(start, place, 0))
            hit &= ((place - run) & 1) == 0
        where = np.flatnonzero(hit)
        live[where] = table.made[slot[where]]
        gone = np.zeros(len(live), bool)
        gone[where + 1] = True
        live, ids = live[~gone], ids[~gone]
    if done_owner:
        all_owner, all_symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(all_owner, kind="stable")
        counts = np.bincount(all_owner, minlength=len(pieces))
        return all_symbols[order], counts
    return symbols[:0], counts * 0


def count_pieces(table: PairTable, pieces: list[str]) -> list[int]:
    return merge_ragged(table, [p.encode() for p in pieces])[1].tolist()


def id_pieces(table: PairTable, pieces: list[str]) -> list[bytes]:
    """Little-endian int32 ids of each piece, as bytes."""
    ids, counts = merge_ragged(table, [p.encode() for p in pieces])
    flat, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


@functools.lru_cache(maxsize=4)
def _counter(path: str) -> CountCoder:
    """One coder a worker process, so that tasks share its cache."""
    table = pair_table(path)
    return CountCoder(load(path), lambda pieces: count_pieces(table, pieces), keep_all=True)


@functools.lru_cache(maxsize=4)
def id_coder(path: str) -> IdCoder:
    """As ``_counter``, for ids."""
    table = pair_table(path)
    return IdCoder(load(path), lambda pieces: id_pieces(table, pieces), keep_all=True)


def token_counts(df: DataFrame, path: str, text: str = "text", keys: list[str] | None = None, limit: int = 1024) -> DataFrame:
    """``keys``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row.

    Null and empty texts count zero bytes and tokens.  Repeated rows give
    repeated results; an empty table gives an empty one; other columns are not
    read.  Special strings in a text count as one token each, as the library
    does by default.
    """

    def make():
        coder = _counter(path)

        def work(texts):
            texts = [t or "" for t in texts]
            counts = [sum(c) for c in coder.lists(texts)]
            return [[len(t.encode()) for t in texts], counts, [c > limit for c in counts]]

        return work

    return map_text(df, keys or ["doc_id"], text, "n_bytes long, n_tokens long, over_limit boolean", make)
