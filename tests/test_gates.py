import pytest
from pyspark.sql import functions as F

from turnstone.functions import prompts
from turnstone.operators import gates


def test_fill_refuses_what_it_can_not_place(spark):
    d = spark.createDataFrame([("x",), ("{{y}}",), (None,)], "v string")
    with pytest.raises(ValueError, match="lacks"):
        prompts.fill("{{a}}", {"b": F.col("v")})
    assert [r[0] for r in d.where("v = 'x' OR v IS NULL").select(prompts.fill("<{{a}}> {{b}}", {"a": F.col("v")})).collect()] == ["<x> {{b}}", None]
    with pytest.raises(Exception, match="placeholder braces"):
        d.select(prompts.fill("{{a}}", {"a": F.col("v")})).collect()


def test_closed_values(spark):
    d = spark.createDataFrame([(["a", "b"],), (["a", "<ambiguous>"],), (["a", "a"],), ([],), (None,)], "c array<string>")
    assert [r[0] for r in d.select(prompts.closed_values(F.col("c"))).collect()] == [["a", "b", "<ambiguous>"], ["a", "<ambiguous>"], None, None, None]


def test_gates_and_links(spark):
    d = spark.createDataFrame([(1, True, True), (2, None, False), (3, True, False)], "k int, a boolean, b boolean")
    checks = [("a", F.col("a")), ("b", F.col("b"))]
    assert [tuple(r) for r in d.select(gates.first_failed(checks), gates.all_failed(checks)).collect()] == [(None, []), ("a", ["a", "b"]), ("b", ["b"])]
    other = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert {r.k: r.missing for r in gates.linked(d, [("other", other, ["k"])]).collect()} == {1: [], 2: ["other"], 3: ["other"]}


def test_next_unlabeled_goes_around(spark):
    d = spark.createDataFrame([("s", 1, None), ("s", 2, "x"), ("s", 3, None), ("s", 4, "y"), ("t", 1, "x")], "sheet string, place int, label string")
    got = {(r.sheet, r.place): r.following for r in gates.next_unlabeled(d, "sheet", "place", "label").collect()}
    assert got == {("s", 1): 3, ("s", 2): 3, ("s", 3): 1, ("s", 4): 1, ("t", 1): None}


def test_hash_leaves_out_and_backoff_is_bounded(spark):
    d = spark.createDataFrame([(1, "a", 5.0), (1, "a", 6.0), (2, "a", 5.0)], "k int, v string, seconds double")
    h = [r[0] for r in d.select(prompts.content_hash(*d.columns, without=("seconds",))).collect()]
    assert h[0] == h[1] != h[2]
    delays = [r[0] for r in spark.range(1, 12).select(prompts.backoff(F.col("id"), F.lit("run"))).collect()]
    assert all(0 <= x <= min(60, 2**k) for k, x in enumerate(delays))
