"""Queries of the training-data operators and their SQL, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlog.llm.rank_merge import token_counts

    return token_counts(documents(spark, sf_dir), vocabulary_path())


def op8_template_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlog.llm.template_slots import extracted

    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlog.llm.heap_bpe import round_trip

    return round_trip(documents(spark, sf_dir), vocabulary_path())


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlog.llm.progressive_jpeg import media_features

    return media_features(documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlog.llm.best_fit import encoder, packed

    return packed(documents(spark, sf_dir), encoder(vocabulary_path()))


def op3_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlog.llm.site_spread import report

    return report(documents(spark, sf_dir), SPREAD_SITES)


def op4_hamming_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlog.llm.hamming_tree import components

    return components(documents(spark, sf_dir))


def op5_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlog.llm.context_trees import identified

    return identified(documents(spark, sf_dir))


def op6_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlog.llm.quality_ledger import POLICIES, judged

    return judged(documents(spark, sf_dir), POLICIES[2])


def op6_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlog.llm.quality_ledger import POLICIES, ablation, ledger

    return ablation(ledger(documents(spark, sf_dir)), POLICIES[2])


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlog.llm.mixing import Mix, schedule

    return schedule(documents(spark, sf_dir), Mix(entropy=0.95, max_epochs=3.0))


#: A line of three words or more on this many of the sources is boilerplate.
SPREAD_SITES = 10

_OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, text, coalesce('s' || source, '-') AS site FROM documents),
l AS (SELECT doc_id, t, site, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d),
w AS (SELECT * FROM l WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 3),
s AS (SELECT line, min((doc_id, pos)) AS first_place FROM w GROUP BY line HAVING count(DISTINCT site) >= {SPREAD_SITES}),
g AS (SELECT doc_id, t, pos FROM w JOIN s USING (line) WHERE (doc_id, pos) <> first_place),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
      coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS stays
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, length(stays) AS n_chars_kept, sha256(stays) AS kept_sha256 FROM k
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
      [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
v AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(t) - (length(t) - length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))) AS word_chars,
      length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
      coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines,
      length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (5 * n_symbols > n_words)::BIGINT
      + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT
      + 32 * (word_chars > 20 * n_words)::BIGINT + 64 * (2 * n_capitals > word_chars)::BIGINT AS failures FROM m)
SELECT *, (failures & 3) <> 0 AS base_failed, (failures & 127) = 0 AS kept, 2::INTEGER AS policy FROM f
"""


#: The ablation report over the same failure bits; policy 2 has all seven rules in force.
_ABLATION = f"""
WITH j AS ({_OP6}), r(rule, b) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8), ('short_words', 16), ('long_words', 32), ('shouting', 64))
SELECT rule, count(*) FILTER (WHERE (failures & b) <> 0) AS n_failed, count(*) FILTER (WHERE (failures & 127) = b) AS n_alone, count(*) FILTER (WHERE (failures & (127 - b)) = 0) AS n_kept_without
FROM j, r GROUP BY rule
"""


#: The pages' articles by tags alone: what template deduction must come to where a page marks its article.
_OP8 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(?:p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this subpackage."""
    found = (op1_progressive_jpeg, op2_best_fit_packing, op3_site_spread, op4_hamming_tree, op5_context_trees, op6_quality_ledger, op6_rule_ablation, op7_token_counts, op8_template_slots, op9_bpe_round_trip, op10_temperature_mix)
    from corpus_pipeline import run

    return {f.__name__: f for f in found} | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    """SQL twins of those queries that SQL can express."""
    from corpus_pipeline import ORACLE_SQL

    return {"op3_site_spread": _OP3, "op6_quality_ledger": _OP6, "op6_rule_ablation": _ABLATION, "op8_template_slots": _OP8} | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
