"""The pipeline against a plain version of its stages, and the guard of the entry module."""

import hashlib
import random
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from skeinlog.llm import mixing, quality_ledger
from skeinlog.llm.queries import SPREAD_SITES
from tests.llm.test_rows import WORD, brute_components, brute_fingerprint, brute_measures, brute_spread


def make_rows():
    rnd = random.Random(9)
    words = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ra", "se", "ti") for b in ("n", "r", "st", "la", "do", "mi")]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = []
    for i in range(60):
        text = "\n".join(prose(40) for _ in range(3))
        if i % 2:
            text += "\nshared notice at the end of pages"
        rows.append((i, text, "en", f"s{i % 12 if i % 3 else 0}", len(text)))
    rows.append((60, rows[5][1], "en", "s3", 1))  # an exact copy
    rows.append((61, rows[6][1].replace("ban", "BAN"), "en", "s4", 1))  # a copy but for case
    rows.append((62, "too short", "en", "s5", 1))
    rows.append((63, "### " * 60, "en", "s5", 1))
    rows.append((64, None, None, None, None))
    return rows


def plain_pipeline(rows):
    """Documents that reach the last stage, with how often each is drawn."""
    kept = []
    for r in rows:
        n, chars, symbols, dup, repeat = brute_measures(r[1])
        lines = [x for x in (r[1] or "").split("\n") if WORD.search(x)]
        capitals = sum("A" <= c <= "Z" for c in r[1] or "")
        bad = n < 50 or 100 * repeat > 50 * n or 5 * symbols > n or 2 * dup > len(lines) or chars < 2 * n or chars > 20 * n or 2 * capitals > chars
        if not bad:
            kept.append(r)
    texts = brute_spread(kept, SPREAD_SITES)
    kept = [(r[0], texts[r[0]], *r[2:4], len(texts[r[0]])) for r in kept if texts[r[0]].strip() or texts[r[0]] == r[1]]
    low = brute_components([(r[0], brute_fingerprint(r[1])) for r in kept])
    kept = [r for r, c in zip(kept, low, strict=True) if r[0] == c]
    tokens = Counter()
    for r in kept:
        tokens[r[3]] += max(1, len(WORD.findall(r[1])))
    names = sorted(tokens)
    budgets = mixing.solve([tokens[s] for s in names], corpus_pipeline.MIX)[2]
    return kept, tokens, dict(zip(names, budgets, strict=True))


def test_run_equals_the_plain_version(spark, tmp_path, vocabulary_file):
    assert [len(quality_ledger.RULES), len(corpus_pipeline.STAGES)] == [7, 5]
    rows = make_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    kept, tokens, budgets = plain_pipeline(rows)
    assert 0 < len(kept) < len(rows) and {60, 61, 62, 63, 64}.isdisjoint({r[0] for r in kept})
    made = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(vocabulary_file)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in kept:
        ids = library.encode(r[1], add_special_tokens=False).ids
        want[r[0]] = (len(ids), sha(",".join(map(str, ids))), sha(r[1]))
    assert {r.doc_id for r in made} == set(want)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id] for r in made)
    source, size = {r[0]: r[3] for r in kept}, {r[0]: max(1, len(WORD.findall(r[1]))) for r in kept}
    drawn = Counter()
    for r in made:
        drawn[source[r.doc_id]] += size[r.doc_id]
    for s, budget in budgets.items():
        assert budget <= drawn[s] < budget + max(size[d] for d in source if source[d] == s)
    assert max(Counter(r.doc_id for r in made).values()) <= 2


def test_stages_keep_columns_and_take_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").collect() == []
