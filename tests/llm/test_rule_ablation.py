"""Operator 6: the ablation report runs on the table."""

import __spark_entry__
from skeinlog.llm import quality_ledger


def test_ablation_report_agrees_with_the_ledger(spark):
    run, mask = __spark_entry__.queries(), quality_ledger.POLICIES[2].mask
    bits = [r.failures & mask for r in run["op6_quality_ledger"](spark, "/root/testdata/sf0.001").collect()]
    made = run["op6_rule_ablation"](spark, "/root/testdata/sf0.001").collect()
    assert len(made) == mask.bit_count()
    for r in made:
        bit = quality_ledger.bits(r.rule)
        assert (r.n_failed, r.n_alone, r.n_kept_without) == (sum(b & bit != 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))
