"""Set operations, insert-only merges, corrections and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify_insert(base: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys..., outcome) of each new row: inserted, unchanged, or conflict where a committed row says otherwise."""
    b = base.select(*keys, F.struct(*values).alias("_old"))
    j = new.select(*keys, F.struct(*values).alias("_new")).join(b, keys, "left")
    return j.select(*keys, F.when(F.col("_old").isNull(), "inserted").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("conflict").alias("outcome"))


def insert_only(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base and those new rows whose key it lacks."""
    return base.unionByName(new.join(base.select(*keys), keys, "left_anti").select(base.columns))


def supersede(base: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Versions: a base row that a new row contradicts stays, marked superseded; the new row stands beside it, live."""
    n = new.select(*keys, *[F.col(v).alias(f"_{v}") for v in values]).withColumn("_there", F.lit(1))
    j = base.join(n, keys, "left")
    differs = F.col("_there").isNotNull() & ~F.struct(*values).eqNullSafe(F.struct(*[F.col(f"_{v}").alias(v) for v in values]))
    old = j.select(*keys, *values, F.when(differs, "superseded").otherwise("live").alias("status"))
    fresh = j.where(differs).select(*keys, *[F.col(f"_{v}").alias(v) for v in values], F.lit("live").alias("status"))
    added = new.join(base.select(*keys), keys, "left_anti").select(*keys, *values, F.lit("live").alias("status"))
    return old.unionByName(fresh).unionByName(added)


def diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): pins added, removed or changed from a to b."""
    j = a.select(key, F.col(value).alias("x"), F.lit(1).alias("l")).join(b.select(key, F.col(value).alias("y"), F.lit(1).alias("r")), key, "full_outer")
    change = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return j.select(key, change.alias("change")).where("change IS NOT NULL")


def first_reason(sources: DataFrame, key: str, precedence: list[str]) -> DataFrame:
    """(key, reason): of several sources' reasons the one of the source that comes first."""
    rank = F.array_position(F.array(*[F.lit(s) for s in precedence]), F.col("source"))
    return sources.groupBy(key).agg(F.min_by("reason", F.struct(rank, F.col("reason"))).alias("reason"))


def content_hash(rows: DataFrame, by: list[str], line: str) -> DataFrame:
    """(by..., n, hash): digest of a group's sorted lines."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("hash"))
