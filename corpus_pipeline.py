"""Corpus pipeline: from raw documents to token ids, stage by stage.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), where
docs is what the stage before returned, and returns a DataFrame.  All stages but
the last return the columns of documents.

1. quality rules: documents that the second policy rejects go;
2. line dedup: boilerplate lines of ten sources or more keep one place;
3. SimHash near-dedup: of documents linked by 0.8 or more of their 5-word shingles one stays; operator 4's
   fingerprints and trees find the groups, an exact search adds the links that lie beyond its radius;
4. mixing: small sources are repeated towards even weights, none more than one
   and a half times, and every document is drawn at least once;
5. encoding: token ids of every drawn document and their decoding, as digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.llm.heap_bpe import round_trip
from skeinlog.llm.mixing import Mix, mixed
from skeinlog.llm.quality_ledger import POLICIES, keep_good
from skeinlog.llm.queries import SPREAD_SITES, vocabulary_path
from skeinlog.llm.shingle_links import one_of_each
from skeinlog.llm.site_spread import drop_boilerplate
from skeinlog.session import removed, shared_folder, written

#: Of codes that a worker keeps, less than op9 alone does: executors still hold the heap that earlier stages have grown.
CACHE_BYTES = 32 << 20

MIX = Mix(entropy=1.0, max_epochs=1.5, cover=True)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, POLICIES[2])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = drop_boilerplate(docs, SPREAD_SITES)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in kept.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs, MIX)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs, vocabulary_path(), cache_bytes=CACHE_BYTES)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", source_mixing),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Byte-level BPE and XXH64 fingerprints are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and reread.

    A stage's rows go as soon as the next one's are written, and all of them after a
    failure; the digests that the last stage returns stay there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    try:
        for k, (_, stage) in enumerate(STAGES):
            docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}")
            if k:
                removed(spark, f"{folder}/{k - 1}")
    except BaseException:
        removed(spark, folder)
        raise
    return docs
