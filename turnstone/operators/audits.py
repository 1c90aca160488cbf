"""Expectations that return problem rows, lookups with reject reasons, duplicates across splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(rules: list[tuple[str, str]]) -> Column:
    """Names of all rules that a row breaks, in order; a rule is (name, SQL condition of the fault)."""
    return F.filter(F.array(*[F.when(F.expr(c), n) for n, c in rules]), lambda x: x.isNotNull())


def failures(rows: DataFrame, rules: list[tuple[str, str]], key: str) -> DataFrame:
    """(rule, failures, first_offender) of the rules that any row breaks."""
    return rows.select(F.col(key), F.explode(problems(rules)).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("failures"), F.min(key).alias("first_offender"))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def match_rows(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, turn, outcome): why a row finds no turn, or how well its text matches; checks in a fixed order."""
    known = turns.select("conv_id").distinct().withColumn("_known", F.lit(1))
    t = turns.select("conv_id", "turn", "role", F.col("text").alias("_text"))
    j = rows.join(known, "conv_id", "left").join(t, ["conv_id", "turn"], "left")
    a, b = F.col("_text"), F.col("text")
    outcome = F.when(F.col("_known").isNull(), "dialogue_not_found").when(F.col("role").isNull(), "turn_index_out_of_range").when(F.col("role") != "user", "not_a_user_turn").when(a == b, "exact").when(F.trim(a) == F.trim(b), "stripped").when(F.lower(F.trim(a)) == F.lower(F.trim(b)), "normalized").otherwise("text_mismatch")
    return j.select("conv_id", "turn", outcome.alias("outcome"))


def cross_split_duplicates(docs: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, also_in): test rows whose key is also in train, or else in dev. One aggregate per key, then a join on the key."""
    keyed = docs.select(id_col, "split", key.alias("_k"))
    where = keyed.where("split <> 'test'").groupBy("_k").agg(F.bool_or(F.col("split") == "train").alias("tr"))
    return keyed.where("split = 'test'").join(where, "_k").select(id_col, F.when(F.col("tr"), "train").otherwise("dev").alias("also_in"))


def registry_flags(docs: DataFrame, inspected: DataFrame) -> DataFrame:
    """(doc_id, exclusion, dup_text) of test rows; an inspection outranks a duplicate."""
    d = docs.select("doc_id", "split", F.md5("text").alias("_k"))
    train = d.where("split = 'train'").select("_k").distinct().withColumn("dup_text", F.lit(True))
    seen = inspected.select("doc_id", "toxic")
    j = d.where("split = 'test'").join(seen, "doc_id", "left").join(train, "_k", "left").withColumn("dup_text", F.coalesce("dup_text", F.lit(False)))
    return j.select("doc_id", F.when(F.col("toxic") == 1, "inspected:toxic").when(F.col("dup_text"), "dup").alias("exclusion"), "dup_text")
