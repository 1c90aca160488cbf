from tests.conftest import DATA
from turnstone import registry
from turnstone.plans import full_queries as fq


def test_plan_constants_and_second_seed(spark):
    q = lambda name: registry.queries()[name](spark, f"{DATA}/sf0.001").collect()
    assert {r.replicates + r.excluded for r in q("B01_bootstrap_interval")} == {10_000}
    report = q("B24_precision_report")
    assert {r.stat for r in report} >= {"linear:full", "benefit:full|ALL"} and any(r.low != r.second_low or r.high != r.second_high for r in report)
    whole = {r.stat: r for r in q("B25_whole_analysis")}
    assert set(whole) >= {f"{c}|{x}" for c in ("none", "full") for x in fq.LEVELS} | set(fq.FAMILY)
    assert {s for s, r in whole.items() if r.adjusted is not None} == set(fq.FAMILY) and whole["linear:absent"].status == "not_run" and whole["linear:absent"].adjusted == 1
