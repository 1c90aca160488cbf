"""Gates, expectations and draws over tables of runs, passes and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_failed(gates: list[tuple[str, Column]]) -> Column:
    """The first gate, in order, whose condition doesn't hold (null counts as not held); null if all hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in gates], F.lit(None).cast("string"))


def all_failed(rules: list[tuple[str, Column]]) -> Column:
    """Names of all rules that don't hold, in order."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]), lambda x: x.isNotNull())


def linked(rows: DataFrame, others: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """rows with missing: the names of those tables that lack the row's key; a chain of left joins with distinct keys."""
    for name, other, key in others:
        rows = rows.join(other.select(*key).distinct().withColumn(f"_has_{name}", F.lit(True)), key, "left")
    missing = F.filter(F.array(*[F.when(F.col(f"_has_{n}").isNull(), n) for n, _, _ in others]), lambda x: x.isNotNull())
    return rows.withColumn("missing", missing).drop(*[f"_has_{n}" for n, _, _ in others])


def shared_owners(owned: DataFrame, item: str, owner: str) -> DataFrame:
    """(item, owners) of items that more than one owner claims."""
    return owned.groupBy(item).agg(F.count_distinct(owner).alias("owners")).where("owners > 1")


def next_unlabeled(rows: DataFrame, sheet: str, place: str, label: str) -> DataFrame:
    """rows with following: the place of the next row of the sheet without a label, around the end; null if there is none."""
    open_place = F.when(F.col(label).isNull(), F.col(place))
    after = Window.partitionBy(sheet).orderBy(place).rowsBetween(1, Window.unboundedFollowing)
    first = rows.groupBy(sheet).agg(F.min(open_place).alias("_first"))
    return rows.withColumn("_next", F.min(open_place).over(after)).join(first, sheet, "left").withColumn("following", F.coalesce("_next", "_first")).drop("_next", "_first")


def draw_unassigned(pool: DataFrame, assigned: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n of the pool's keys that aren't assigned, by the md5 of seed and key."""
    rank = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return pool.select(key).distinct().join(assigned.select(key), key, "left_anti").orderBy(rank, key).limit(n)
