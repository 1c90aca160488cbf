"""Annotation passes: canonical row digests, hash chains, corrections, sealed passes, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSES = ("form", "context", "reveal")  #: in the order in which they are sealed (fixed values)


def row_hash(columns: list[str]) -> Column:
    """Digest of a row's named text columns, in the order of their names; null counts as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in sorted(columns)]), 256)


def broken_chain(rows: DataFrame, prior: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows whose prior_sha256 isn't the digest of the prior row with the same keys: (keys..., problem)."""
    p = prior.select(*keys, row_hash(columns).alias("_h"))
    j = rows.join(p, keys, "left")
    problem = F.when(F.col("_h").isNull(), "no_prior_row").when(~F.col("_h").eqNullSafe(F.col("prior_sha256")), "prior_differs")
    return j.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def unlogged_corrections(rows: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., superseded, logged) where the number of superseded rows isn't the number of logged corrections."""
    a = rows.where("status = 'superseded'").groupBy(*keys).agg(F.count(F.lit(1)).alias("superseded"))
    b = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("logged"))
    j = a.join(b, keys, "full_outer").na.fill(0, ["superseded", "logged"])
    return j.where("superseded <> logged")


def eligible(exported: DataFrame, this: str, keys: list[str]) -> DataFrame:
    """Keys whose earlier passes are all sealed and that this pass hasn't exported."""
    before = PASSES[: PASSES.index(this)]
    done = exported.groupBy(*keys).agg(F.collect_set("pass").alias("p"))
    ok = F.forall(F.array(*[F.lit(b) for b in before]).cast("array<string>"), lambda b: F.array_contains("p", b)) & ~F.array_contains("p", this)
    return done.where(ok).select(*keys)


def split_groups(registry: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """Groups that stand in more than one split."""
    return registry.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def lineage(rows: DataFrame, key: str = "sha256", prior: str = "prior_sha256") -> DataFrame:
    """rows with superseded: a later row names this one as its prior."""
    named = rows.select(F.col(prior).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("superseded", F.lit(True))
    return rows.join(named, key, "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))


def slot_gaps(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Labels (item_id, intent_id, slots) with missing and undefined slots under their intent, where there are any."""
    j = labels.join(taxonomy.select("intent_id", "required_slots", "optional_slots"), "intent_id", "left")
    missing = F.array_sort(F.array_except("required_slots", "slots"))
    undefined = F.array_sort(F.array_except("slots", F.concat("required_slots", "optional_slots")))
    out = j.select("item_id", "intent_id", F.col("required_slots").isNull().alias("unknown_intent"), missing.alias("missing"), undefined.alias("undefined"))
    return out.where("unknown_intent OR size(missing) > 0 OR size(undefined) > 0")


def request_status(function: Column) -> Column:
    return F.when(function == "request", "present").when(function == "uncertain", "uncertain").otherwise("absent")


def request_type(form: Column, status: Column) -> Column:
    """A form label never decides presence: on a present request an unknown form is form_unknown."""
    return F.when(status == "absent", "none").when(status == "uncertain", "uncertain").when(form == "L0", "direct").when(form.isin("L1", "L2", "L3"), "indirect").otherwise("form_unknown")
