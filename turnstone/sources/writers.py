"""Writers: ordered single files where bytes must repeat, append-only tables elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sorted_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One file in a fixed order; for manifests and audits, which people read."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").options(header=True, lineSep="\n").csv(path)


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """One object a line with its keys in order, rows in a fixed order."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.orderBy(*order).select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table lacks; returns how many. The first of repeated keys, by its contents' order, is taken."""
    spark = df.sparkSession
    one = df.groupBy(key).agg(F.min(F.struct(*[c for c in df.columns if c != key])).alias("r")).select(key, "r.*").select(df.columns)
    try:
        one = one.join(spark.read.schema(df.schema).parquet(path).select(key), key, "left_anti").select(df.columns)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    one = one.cache()
    n = one.count()
    one.write.mode("append").parquet(path)
    one.unpersist()
    return n
