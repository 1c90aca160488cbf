"""Running scores over an append-only result log, and turns that arrive late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "item_id STRING, condition STRING, gold INT, pred INT, at TIMESTAMP"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """New files of a JSON result log as a stream."""
    return spark.readStream.schema(RESULT).json(path)


def running_scores(results: DataFrame) -> DataFrame:
    """(condition, n, accuracy) so far; for the complete or update mode. State is one row per condition."""
    return results.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gold") == F.col("pred")).cast("int")).alias("accuracy"))


def windowed_scores(results: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, condition, n, accuracy) of each closed window; repeated items of a window within the watermark count once."""
    once = results.withWatermark("at", late).dropDuplicatesWithinWatermark(["item_id", "condition"])
    g = once.groupBy(F.window("at", width).alias("w"), "condition").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gold") == F.col("pred")).cast("int")).alias("accuracy"))
    return g.select(F.col("w.start").alias("start"), "condition", "n", "accuracy")
