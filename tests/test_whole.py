import pytest

from tests.conftest import DATA
from turnstone import registry

#: query, its key, and the whole table's keys
ROWS = [("F39_primary_category", "dialogue", "events", "event_id DIV 2"), ("P02_social_only", "dialogue", "events", "event_id DIV 2"), ("F71_act_domains", "dialogue", "events", "event_id DIV 2"), ("F40_gold_reference", "dialogue", "events", "event_id DIV 4"), ("F59_iso_date", "event_id", "events", "event_id"), ("K12_shuffled_sheet", "c_custkey", "customer", "c_custkey")]


@pytest.mark.parametrize("name,key,table,expr", ROWS)
def test_every_row_of_the_table_is_used(spark, name, key, table, expr):
    got = [r[0] for r in registry.queries()[name](spark, f"{DATA}/sf0.01").select(key).collect()]
    want = {r[0] for r in spark.read.parquet(f"{DATA}/sf0.01/{table}.parquet").selectExpr(expr).distinct().collect()}
    assert len(got) == len(want) and set(got) == want


def test_whole_tables_vary(spark):
    q = lambda name: registry.queries()[name](spark, f"{DATA}/sf0.01")
    assert {r.category for r in q("F38_act_categories").select("category").distinct().collect()} == {"info_seeking", "booking", "travel", "recommendation", "no_request"}
    assert q("P02_social_only").select("social").distinct().count() == q("F40_gold_reference").select("conflicting").distinct().count() == q("B18_holm_status").select("status").distinct().count() == 2
    assert q("F59_iso_date").where("valid AND event_id % 33 > 28").count() > 0 and q("U19_eligible_keys").count() > 0
