"""Scores of predictions: confusion, accuracy, macro-F1, kappa, paired contrasts, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(preds: DataFrame, by: list[str], labels: list[int]) -> DataFrame:
    """Dense counts (by..., gold, pred, n): every pair of labels in every group, absent ones 0."""
    some = preds.groupBy(*by, "gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    cells = F.explode(F.array(*[F.struct(F.lit(g).alias("gold"), F.lit(p).alias("pred")) for g in labels for p in labels])).alias("c")
    grid = some.select(*by).distinct().select(*by, cells).select(*by, "c.*")
    return grid.join(some, [*by, "gold", "pred"], "left").na.fill({"n": 0})


def report(preds: DataFrame, by: list[str], labels: list[int]) -> DataFrame:
    """(by..., n, accuracy, macro_f1) over fixed labels; a label that neither occurs nor is predicted has F1 0."""
    one = F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")
    per = preds.select(*by, "gold", "pred", one).groupBy(*by, "label").agg(
        F.sum(((F.col("gold") == F.col("label")) & (F.col("pred") == F.col("label"))).cast("long")).alias("hit"),
        F.sum((F.col("gold") == F.col("label")).cast("long")).alias("gold_n"),
        F.sum((F.col("pred") == F.col("label")).cast("long")).alias("pred_n"),
        F.count(F.lit(1)).alias("n"),
    )
    f1 = F.when(F.col("gold_n") + F.col("pred_n") > 0, 2.0 * F.col("hit") / (F.col("gold_n") + F.col("pred_n"))).otherwise(0.0)
    return per.groupBy(*by).agg(F.max("n").alias("n"), (F.sum("hit") / F.max("n")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def kappa(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Cohen's kappa (by..., n, observed, expected, kappa); 1 where the expected agreement is 1."""
    cells = rows.groupBy(*by, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(*by, F.col("x").alias("v")).agg(F.sum("n").alias("p"))
    right = cells.groupBy(*by, F.col("y").alias("v")).agg(F.sum("n").alias("q"))
    chance = left.join(right, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("p") * F.col("q")).alias("pq"))
    both = total.join(chance, by, "left") if by else total.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.coalesce("pq", F.lit(0)) / (F.col("n") * F.col("n"))
    return both.select(*by, "n", po.alias("observed"), pe.alias("expected"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def paired(preds: DataFrame, contrasts: list[tuple[str, str]], value: Column) -> DataFrame:
    """(first, second, n, diff, n_dialogues): mean of value under the first minus under the second condition, over items that both score."""
    wide = preds.groupBy("item_id", "conv_id").pivot("condition", sorted({c for pair in contrasts for c in pair})).agg(F.max(value.cast("double")))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), (F.col(a) - F.col(b)).alias("d")) for a, b in contrasts])).alias("c")
    long = wide.select("conv_id", each).select("conv_id", "c.*").where("d IS NOT NULL")
    return long.groupBy("first", "second").agg(F.count("d").alias("n"), F.avg("d").alias("diff"), F.countDistinct("conv_id").alias("n_dialogues"))


def coverage(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(problem, n): keys missing from actual, extra in it, or there more than once."""
    got = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    both = expected.select(*keys, F.lit(1).alias("want")).join(got, keys, "full_outer")
    problem = F.when(F.col("times").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("times") > 1, "duplicated")
    return both.select(problem.alias("problem")).where("problem IS NOT NULL").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def order_statistic(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """(by..., value): the sorted value at index int((n - 1) * share), without interpolation."""
    w = Window.partitionBy(*by).orderBy(value)
    at = rows.select(*by, value, F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("n"))
    return at.where(F.col("r") == F.floor((F.col("n") - 1) * share) + 1).select(*by, value)


def first_best(probs: list[Column], labels: list) -> Column:
    """The label with the largest probability, ties to the earliest."""
    p = F.array(*probs)
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(p, F.array_max(p)).cast("int"))


def majority_without_own(rows: DataFrame, group: str, label: str, order: list[str]) -> DataFrame:
    """(group, label): the class most common among all other groups' rows, ties in the given order. Counts move, rows don't."""
    own = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("own"))
    total = own.groupBy(label).agg(F.sum("own").alias("total"))  # one row per label
    ranks = rows.sparkSession.createDataFrame(list(enumerate(order)), f"rank int, {label} string")
    grid = rows.select(group).distinct().join(F.broadcast(total.join(ranks, label)))  # labels are few and fixed
    rest = grid.join(own, [group, label], "left").withColumn("rest", F.col("total") - F.coalesce("own", F.lit(0)))
    return rest.groupBy(group).agg(F.min_by(label, F.struct(-F.col("rest"), F.col("rank"))).alias("majority"))
