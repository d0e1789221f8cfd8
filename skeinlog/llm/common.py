"""Shared pieces: Arrow maps over whole tables and column defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of text that one step of an Arrow map holds; a longer text makes a step of its own.
STEP_BYTES = 1 << 20


def cuts(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose values in ``column`` hold about ``limit`` bytes together."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        size += n or 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(column):
        yield start, len(column)


def steps(batches: Iterator[pa.RecordBatch], text: int, limit: int = STEP_BYTES) -> Iterator[list[list]]:
    """Rows of Arrow batches as column lists, cut so that the column at index ``text`` holds about ``limit`` bytes.

    Only a step's rows become Python objects at a time.
    """
    for batch in batches:
        for a, b in cuts(batch.column(text), limit):
            yield [c.slice(a, b - a).to_pylist() for c in batch.columns]


def map_text(
    df: DataFrame,
    keys: list[str],
    text: str,
    schema: str,
    make: Callable[[], Callable[[list[list]], list[list]]],
    limit: int = STEP_BYTES,
) -> DataFrame:
    """Apply ``make()`` once a task, then its result to steps of ``[*keys, text]``; it returns columns for ``schema``.

    ``schema`` names the columns that follow the keys.  Only the keys and the
    text are read, so other columns of ``df`` never clash.
    """
    kept = df.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.col(f"`{text}`").cast("string").alias("__text"))
    more = _parse_datatype_string(schema)
    out = StructType([*[f for f in df.select(*[F.col(f"`{k}`") for k in keys]).schema.fields], *more.fields])
    arrow = to_arrow_schema(out)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for rows in steps(batches, n, limit):
            made = work(rows[n])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip([*rows[:n], *made], arrow, strict=True)], schema=arrow)

    return kept.mapInArrow(run, out)


def whole(text: str) -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
