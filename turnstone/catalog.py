"""How dialogues, items, conditions, predictions and registries are read off the given tables, in Spark and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions.text import word_count

CONDITIONS = ("none", "one", "full", "mismatched", "mismatched_one")
LABELS = 3
SEEDS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(conv: Column) -> Column:
    """Grouped by dialogue, so no dialogue is in two splits."""
    k = conv % 10
    return F.when(k == 0, "test").when(k == 1, "dev").otherwise("train")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text, split, words, bit): a turn's words and its domain bit."""
    c = table(spark, sf_dir, "conversations")
    bit = F.expr("shiftleft(1, cast(length(text) % 7 as int))")
    return c.select("conv_id", "turn", "role", "text", split_of(F.col("conv_id")).alias("split"), word_count(F.col("text")).cast("long").alias("words"), bit.alias("bit"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with item_id = <dialogue>_t<NN>."""
    return turns(spark, sf_dir).where("role = 'user'").withColumn("item_id", F.format_string("%d_t%02d", "conv_id", "turn"))


def conditions(spark: SparkSession) -> DataFrame:
    """(k, condition): one row each, so a join with them is a bounded expansion."""
    return spark.createDataFrame(list(enumerate(CONDITIONS)), "k int, condition string")


def predictions(spark: SparkSession, sf_dir: str, seeds: int = 1) -> DataFrame:
    """Stand-in predictions of every item under every condition: (item_id, conv_id, turn, split, condition, k, seed, gold, pred)."""
    runs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("condition"), F.lit(s).alias("seed")) for k, c in enumerate(CONDITIONS) for s in range(seeds)])).alias("r")
    p = items(spark, sf_dir).select("item_id", "conv_id", "turn", "split", "text", runs).select("item_id", "conv_id", "turn", "split", "text", "r.*")
    return p.withColumns({"gold": ((F.col("conv_id") + F.col("turn")) % LABELS).cast("int"), "pred": ((F.col("conv_id") * 7 + F.col("turn") * 3 + 5 * F.col("k") + F.col("seed")) % LABELS).cast("int")})


#: DuckDB text of the same tables.
SQL = r"""
turns AS (SELECT conv_id, turn, role, text, CASE conv_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split,
  len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::BIGINT AS words, (1 << (length(text) % 7)::INT)::INT AS bit FROM conversations),
items AS (SELECT *, conv_id::VARCHAR || '_t' || lpad(turn::VARCHAR, 2, '0') AS item_id FROM turns WHERE role = 'user'),
conditions AS (SELECT * FROM (VALUES (0, 'none'), (1, 'one'), (2, 'full'), (3, 'mismatched'), (4, 'mismatched_one')) AS t(k, condition)),
preds AS (SELECT item_id, conv_id, turn, split, text, k, condition, seed, ((conv_id + turn) % 3)::INT AS gold, ((conv_id * 7 + turn * 3 + 5 * k + seed) % 3)::INT AS pred
  FROM items, conditions, (SELECT unnest([0, 1, 2]) AS seed)),
p0 AS (SELECT * FROM preds WHERE seed = 0)
"""


def with_sql(body: str) -> str:
    return f"WITH {SQL.strip()} {body}" if not body.lstrip().startswith(",") else f"WITH {SQL.strip()}{body}"
