"""Operator 5: language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``order`` bytes long, with the
counts of the bytes that followed.  A byte seen in a context costs
-log2(count / (total + distinct)); one not seen pays the escape,
-log2(distinct / (total + distinct)), and is coded in the context one byte
shorter; below the empty context every byte costs 8 bits (escape method C,
without exclusion).  Statistics are frozen after fitting, so a text's exact code
length is a sum of table entries.  The language of the shortest code wins.

The trees of all languages are kept as tables over the n-grams that any of them
holds, each row with the cost under every language; a text is coded by numpy
for all languages at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.llm.common import map_text
from skeinlog.session import checkpointed

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes before a text; contexts at its start see them.
START = b"\n\n\n"


class GramTable:
    """Open-addressed map from 32-bit n-grams to row numbers; row 0 stands for grams that it lacks."""

    def __init__(self, grams: np.ndarray):
        bits = max(10, (4 * len(grams)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rows = np.zeros(1 << bits, np.int32)
        todo, slot, self.probes = np.arange(len(grams)), self._slot(grams), 0
        while len(todo):
            self.probes += 1
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = first & (self.keys[slot] == -1)
            self.keys[slot[put]], self.rows[slot[put]] = grams[todo[put]], todo[put] + 1
            todo, slot = todo[~put], (slot[~put] + 1) & self.mask

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        slot = self._slot(grams)
        held = self.keys[slot]
        rows = np.where(held == grams, self.rows[slot], 0)
        open_ = np.flatnonzero((held != grams) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            held = self.keys[slot[open_]]
            same = held == grams[open_]
            rows[open_[same]] = self.rows[slot[open_[same]]]
            open_ = open_[~same & (held != -1)]
        return rows


@dataclass
class Model:
    """Frozen trees: for each n-gram length the table and, by row, the costs under every language."""

    langs: list[str]
    order: int
    symbols: list[tuple[GramTable, np.ndarray]]  # by context length: cost of the last byte after the others
    escapes: list[tuple[GramTable, np.ndarray]]  # by context length: cost of leaving the context

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        if not texts:
            return out
        joined = np.frombuffer(b"".join(START + t for t in texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate(([0], np.cumsum(sizes + len(START))[:-1])) + len(START)
        for at in range(0, len(texts), 1 << 12):
            self._some(joined, starts[at : at + (1 << 12)], sizes[at : at + (1 << 12)], out[at : at + (1 << 12)])
        return out

    def _some(self, joined: np.ndarray, starts: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> None:
        piece = 1 << 18
        first, last = int(starts[0]), int(starts[-1] + sizes[-1])
        sums = np.zeros((len(starts), len(self.langs)))
        for a in range(first, last, piece):
            b = min(last, a + piece)
            costs = self._costs(joined[a - len(START) : b])
            lo, hi = np.searchsorted(starts + sizes, a, "right"), np.searchsorted(starts, b, "left")
            run = np.concatenate((np.zeros((1, len(self.langs))), np.cumsum(costs, axis=0, dtype=np.float64)))
            x = np.clip(starts[lo:hi] - a, 0, b - a)
            y = np.clip(starts[lo:hi] + sizes[lo:hi] - a, 0, b - a)
            sums[lo:hi] += run[y] - run[x]
        out += sums

    def _costs(self, window: np.ndarray) -> np.ndarray:
        """Cost of every byte after the first three, under each language."""
        n = len(window) - len(START)
        w = window.astype(np.int64)
        grams, context = [], []
        value = w[len(START) :].copy()
        for m in range(self.order + 1):
            grams.append(value.copy())
            if m < self.order:
                value += w[len(START) - m - 1 : len(START) - m - 1 + n] << (8 * (m + 1))
        for m in range(self.order + 1):
            context.append(grams[m] >> 8)
        table, costs = self.symbols[0]
        made = costs[table.find(grams[0])]
        # from short contexts to long ones: a byte seen there takes the entry, another pays the escape on top
        for m in range(1, self.order + 1):
            table, costs = self.symbols[m]
            rows = table.find(grams[m])
            leave_table, leave = self.escapes[m]
            made = made + leave[leave_table.find(context[m])]
            hit = np.flatnonzero(rows)
            entry = costs[rows[hit]]
            made[hit] = np.where(np.isnan(entry), made[hit], entry)
        return made


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(grams, return_counts=True)


def fit(samples: dict[str, list[bytes]], order: int = 3) -> Model:
    """Trees of each language over its sample texts; 1 to 3 bytes of context."""
    langs = sorted(samples)
    symbols, escapes = [], []
    seen: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
    for lang in langs:
        texts = samples[lang]
        joined = np.frombuffer(b"".join(START + t for t in texts), np.uint8).astype(np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        # places of the bytes of texts, without those of START
        own = np.concatenate([np.zeros(0, np.int64), *[np.arange(a, a + s) for a, s in zip(np.cumsum(sizes + len(START)) - sizes, sizes, strict=True)]])
        value = joined[own]
        for m in range(order + 1):
            seen[m].append(_counted(value))
            if m < order:
                value = value + (joined[own - m - 1] << (8 * (m + 1)))
    for m in range(order + 1):
        every = np.unique(np.concatenate([np.zeros(0, np.int64), *[g for g, _ in seen[m]]]))
        contexts = np.unique(every >> 8)
        cost = np.full((len(every) + 1, len(langs)), np.nan, np.float32)
        leave = np.zeros((len(contexts) + 1, len(langs)), np.float32)
        for k, (grams, counts) in enumerate(seen[m]):
            ctx, inverse = np.unique(grams >> 8, return_inverse=True)
            total, distinct = np.bincount(inverse, counts, len(ctx)), np.bincount(inverse, minlength=len(ctx))
            cost[np.searchsorted(every, grams) + 1, k] = -np.log2(counts / (total + distinct)[inverse])
            leave[np.searchsorted(contexts, ctx) + 1, k] = -np.log2(distinct / (total + distinct))
            if m == 0:
                # below the empty context all bytes cost 8 bits
                least = 8.0 + (-math.log2(distinct[0] / (total[0] + distinct[0])) if len(ctx) else 0.0)
                column = cost[:, k]
                column[np.isnan(column)] = least
        symbols.append((GramTable(every), cost))
        escapes.append((GramTable(contexts), leave))
    return Model(langs, order, symbols, escapes)


#: Bytes of training text that come to the driver, at most; a longer sample is an error.
SAMPLE_BYTES = 256 << 20


def training_rows(df: DataFrame, per_lang: int, text: str = "text", doc: str = "doc_id", lang: str = "lang", remainder: int = 2) -> DataFrame:
    """At most ``per_lang`` labelled rows of each language outside the held-out quarter, those with the lowest hashes of their ids.

    Rows are counted by language and range of hashes first (1,024 ranges); the counts say
    up to which range a language's rows are needed, so that hardly more than
    ``per_lang`` ids of a language meet in a task.  Only narrow columns are read for that,
    and only the chosen texts then.
    """
    held_out = F.crc32(F.col(f"`{doc}`").cast("string")) % 4 == remainder
    open_ = df.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{doc}`").isNotNull() & ~held_out)
    narrow = open_.select(F.col(f"`{doc}`").alias("__id"), F.col(f"`{lang}`").alias("__lang"), F.xxhash64(F.col(f"`{doc}`")).alias("__h")).withColumn("__range", F.shiftright("__h", 54))
    counted = narrow.groupBy("__lang", "__range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__lang").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = counted.withColumn("__before", before).where(F.col("__before") < per_lang).select("__lang", "__range")
    order = Window.partitionBy("__lang").orderBy("__h", "__id")
    chosen = narrow.join(needed, ["__lang", "__range"]).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_lang)
    ids = checkpointed(chosen.select("__id").distinct())
    # per_lang times the number of languages, which are few; checked all the same
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = open_.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc}`").alias("__doc"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.join(ids, F.col("__doc") == F.col("__id"), "left_semi").withColumnRenamed("__doc", "__id")


#: Ids up to this many are broadcast to the texts (16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def fit_on(df: DataFrame, per_lang: int = 400, order: int = 3, text: str = "text", doc: str = "doc_id", lang: str = "lang") -> Model:
    """A model over the bounded sample of ``training_rows``; whole texts of the sample are used."""
    samples: dict[str, list[bytes]] = {}
    size = 0
    for row in training_rows(df, per_lang, text, doc, lang).orderBy("lang", "__id", "text").toLocalIterator():
        samples.setdefault(row.lang, []).append(row.text.encode())
        size += len(samples[row.lang][-1])
        if size > SAMPLE_BYTES:
            raise ValueError(f"training texts hold more than {SAMPLE_BYTES} bytes: lower per_lang")
    return fit(samples, order)


def predict(df: DataFrame, model: Model, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """``keys``, ``lang_pred``, ``score``, ``bits`` and ``bits_next`` of every row.

    ``score`` is the posterior of the language under even priors.  A null text,
    one without a letter, and any text under a model without languages give
    ``und`` with score 0.  Ties go to the first language in order of name.
    Repeated rows give repeated results; an empty table gives an empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        trees, letter = shared.value, regex.compile(r"\p{L}").search

        def work(texts):
            pred, score, best_bits, next_bits = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [None] * len(texts)
            at = [i for i, t in enumerate(texts) if t and trees.langs and letter(t)]
            bits = trees.code_lengths([texts[i].encode() for i in at])
            for i, row in zip(at, bits, strict=True):
                best = int(row.argmin())
                pred[i] = trees.langs[best]
                score[i] = float(1.0 / np.exp2(np.clip(row[best] - row, -1000, 0)).sum())
                best_bits[i] = float(row[best])
                next_bits[i] = float(np.partition(row, 1)[1]) if len(row) > 1 else None
            return [pred, score, best_bits, next_bits]

        return work

    return map_text(df, keys or ["doc_id"], text, "lang_pred string, score double, bits double, bits_next double", make, 1 << 20)


def identified(df: DataFrame, per_lang: int = 400, order: int = 3, text: str = "text", doc: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Fit on three quarters of the labelled ids (bounded), then predict every row; ``held_out`` marks the other quarter.

    The label is read for fitting only.  Rows with a null id are never fitted on and not held out.
    """
    model = fit_on(df, per_lang, order, text, doc, lang)
    held_out = F.coalesce(F.crc32(F.col(f"`{doc}`").cast("string")) % 4 == 2, F.lit(False))
    return predict(df, model, text, [doc]).select(F.col(f"`{doc}`"), held_out.alias("held_out"), "lang_pred", "score", F.round("bits", 3).alias("code_bits"), F.round("bits_next", 3).alias("code_bits_next"))
