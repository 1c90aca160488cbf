"""Cluster bootstrap over dialogues, shared by all statistics, and what is made of its replicates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone.shipping import ship


def vectors(rows: DataFrame, stat: list[str], cluster: str, num: Column, den: Column) -> DataFrame:
    """(stat..., cluster, num, den): each statistic's sums per dialogue; what the bootstrap needs of the rows."""
    return rows.groupBy(*stat, cluster).agg(F.sum(num.cast("double")).alias("num"), F.sum(den.cast("double")).alias("den"))


def weights(clusters: DataFrame, cluster: str, samples: int, seed: int) -> DataFrame:
    """(replicate, cluster, w): how often each replicate draws each dialogue.

    Draw j of replicate r takes the dialogue with number md5(seed:r:j), first eight hexadecimal digits, modulo their count. The
    draws are made where they are counted: a replicate is a row, its draws an array.
    """
    spark = clusters.sparkSession
    ids = clusters.select(cluster).distinct()
    named = ids.withColumn("i", (F.row_number().over(Window.orderBy(cluster)) - 1).cast("long"))  # dialogues, not rows: bounded by the draws of one replicate
    n = ids.count()
    draws = spark.range(samples).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    i = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "replicate", "j")), 1, 8), 16, 10).cast("long") % n
    return draws.select("replicate", i.alias("i")).groupBy("replicate", "i").agg(F.count(F.lit(1)).alias("w")).join(named, "i").select("replicate", cluster, "w")


def replicates(stats: DataFrame, drawn: DataFrame, stat: list[str], cluster: str) -> DataFrame:
    """(stat..., replicate, value): ratio of weighted sums; null where the weighted denominator is 0."""
    j = stats.join(drawn, cluster).groupBy(*stat, "replicate").agg(F.sum(F.col("w") * F.col("num")).alias("n"), F.sum(F.col("w") * F.col("den")).alias("d"))
    return j.select(*stat, "replicate", F.when(F.col("d") != 0, F.col("n") / F.col("d")).alias("value"))


def derived(values: DataFrame, terms: DataFrame) -> DataFrame:
    """values (stat, replicate, value), terms (derived, stat, coef): linear combinations, null unless every term is defined."""
    j = values.join(F.broadcast(terms), "stat").groupBy("derived", "replicate").agg(F.sum(F.col("coef") * F.col("value")).alias("v"), F.count("value").alias("k"))  # the plan's terms are few
    want = terms.groupBy("derived").agg(F.count(F.lit(1)).alias("want"))
    return j.join(F.broadcast(want), "derived").select("derived", "replicate", F.when(F.col("k") == F.col("want"), F.col("v")).alias("value"))


def summary(values: DataFrame, stat: list[str], confidence: float = 0.95, most_excluded: float = 0.01) -> DataFrame:
    """(stat..., low, high, p, replicates, excluded, unstable): interval by order statistics, two-sided p floored at one replicate."""
    tail = round((1 - confidence) / 2, 12)
    v = values.where("value IS NOT NULL")
    w = Window.partitionBy(*stat).orderBy("value")
    ranked = v.select(*stat, "value", F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(Window.partitionBy(*stat)).alias("n"))
    at = lambda share: F.floor((F.col("n") - 1) * share) + 1
    cut = ranked.groupBy(*stat).agg(
        F.max(F.when(F.col("r") == at(tail), F.col("value"))).alias("low"),
        F.max(F.when(F.col("r") == at(1 - tail), F.col("value"))).alias("high"),
        F.max("n").alias("replicates"),
        F.sum((F.col("value") <= 0).cast("long")).alias("le"),
        F.sum((F.col("value") >= 0).cast("long")).alias("ge"),
    )
    all_ = values.groupBy(*stat).agg(F.count(F.lit(1)).alias("total"))
    j = all_.join(cut, stat, "left").withColumn("replicates", F.coalesce("replicates", F.lit(0)))
    excluded = F.col("total") - F.col("replicates")
    unstable = (F.col("replicates") == 0) | (excluded / F.col("total") > most_excluded)
    p = F.greatest(1 / F.col("replicates"), F.least(F.lit(1.0), 2 * F.least("le", "ge") / F.col("replicates")))
    return j.select(*stat, "low", "high", F.when(~unstable, p).alias("p"), F.col("replicates").cast("long"), excluded.cast("long").alias("excluded"), unstable.alias("unstable"))


def holm(members: DataFrame, p: str = "p", order: str = "member") -> DataFrame:
    """members with adjusted: Holm's step-down over the whole family; a member without a value keeps 1. The family is a plan's few rows."""
    q = F.coalesce(F.col(p), F.lit(1.0))
    ranked = members.withColumns({"_r": F.row_number().over(Window.orderBy(q, order)), "_m": F.count(F.lit(1)).over(Window.partitionBy())})
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * q)
    return ranked.withColumn("adjusted", F.max(step).over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))).drop("_r", "_m")


MATRIX_CELLS = 4_000_000  #: statistics times dialogues up to which their sums go to every task; beyond, ``replicates`` joins


def replicates_blocked(stats: DataFrame, stat: str, cluster: str, samples: int, seed: int) -> DataFrame:
    """The same rows as ``weights`` and ``replicates`` give, as products of matrices.

    The sums per statistic and dialogue, one table for the whole plan, are sent to the tasks if they have at most
    ``MATRIX_CELLS`` cells; each task draws its share of the replicates and multiplies. Larger plans take the join.
    """
    spark = stats.sparkSession
    size = stats.agg(F.countDistinct(stat).alias("s"), F.countDistinct(cluster).alias("d")).first()
    if size["s"] * size["d"] > MATRIX_CELLS or not size["s"]:
        return replicates(stats, weights(stats, cluster, samples, seed), [stat], cluster)
    ship(spark)
    table = stats.toPandas()
    names, dialogues = sorted(table[stat].unique()), sorted(table[cluster].unique())
    at = (np.searchsorted(dialogues, table[cluster]), np.searchsorted(names, table[stat]))
    num, den = np.zeros((len(dialogues), len(names))), np.zeros((len(dialogues), len(names)))
    num[at], den[at] = table["num"], table["den"]
    sent = spark.sparkContext.broadcast((num, den))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        num, den = sent.value
        n = len(num)
        for b in batches:
            for s in range(0, len(b), 64):
                ids = b["id"].to_numpy()[s : s + 64]
                w = np.stack([np.bincount([int.from_bytes(hashlib.md5(b"%d:%d:%d" % (seed, r, j)).digest()[:4], "big") % n for j in range(n)], minlength=n) for r in ids.tolist()]).astype(float)
                d = w @ den
                value = np.divide(w @ num, d, out=np.full_like(d, np.nan), where=d != 0)
                yield pd.DataFrame({"_s": np.tile(np.arange(d.shape[1], dtype=np.int32), len(ids)), "replicate": np.repeat(ids, d.shape[1]), "value": value.ravel()})

    made = spark.range(0, samples, 1, max(1, min(samples // 64, spark.sparkContext.defaultParallelism * 2))).mapInPandas(run, "_s int, replicate long, value double")
    called = spark.createDataFrame([(i, x.item() if hasattr(x, "item") else x) for i, x in enumerate(names)], f"_s int, `{stat}` {dict(stats.dtypes)[stat]}")
    return made.join(F.broadcast(called), "_s").select(stat, "replicate", F.when(~F.isnan("value"), F.col("value")).alias("value"))  # one row per statistic of the plan
