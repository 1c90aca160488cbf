"""Deterministic draws: rows are ranked by md5 of a seed and their key, so a draw repeats in any engine and at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw_key(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))


def sample(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows, or all; a top-n by key, so each partition keeps n at most."""
    return rows.orderBy(draw_key(seed, *keys), *keys).limit(n)


def per_group(rows: DataFrame, by: list[str], n: int, seed: int, *keys: str) -> DataFrame:
    """n rows of each group; short groups whole."""
    w = Window.partitionBy(*by).orderBy(draw_key(seed, *keys), *keys)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def clusters(rows: DataFrame, cluster: str, n: int, seed: int) -> DataFrame:
    """All rows of n drawn clusters."""
    return rows.join(sample(rows.select(cluster).distinct(), n, seed, cluster), cluster, "left_semi")


def two_stage(rows: DataFrame, cluster: str, n: int, seed: int, *keys: str) -> DataFrame:
    """One row from each of n drawn clusters."""
    return per_group(clusters(rows, cluster, n, seed), [cluster], 1, seed + 1, *keys)


def strided(rows: DataFrame, by: list[str], order: list[str], step: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w) - 1).where(F.col("_r") % step == 0).drop("_r")


def one_per(rows: DataFrame, by: list[str], cluster: str, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows of each group, at most one of a cluster."""
    return per_group(per_group(rows, [*by, cluster], 1, seed, *keys), by, n, seed, *keys)
