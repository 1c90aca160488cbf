"""Tables written to the shared folder to cut lineage.

Every intermediate that a later stage reads more than once is written as Parquet below ``spark.checkpoint.dir``, the
folder that the driver and all executors share, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from turnstone.shipping import ship


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only where the session has none, and only in local mode, a temporary one is set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="turnstone-")
        sc.setCheckpointDir(folder)
    return folder


#: Settings that bound a batch of rows on its way to a Python worker: rows hold whole texts, so ten thousand are too many.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16777216b"))


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers, and lower the batch settings where the session has Spark's own defaults; a session's choice stays."""
    ship(spark)
    for key, default, value in BATCHES:
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def _remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


class Scratch:
    """Tables of one operator call. They stay until the application ends, as the caller's result still reads them; ``drop`` removes one earlier."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        prepare(spark)
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._clean)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return the table as read back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _remove(self.spark, f"{self.root}/{name}")

    def _clean(self) -> None:
        try:
            _remove(self.spark, self.root)
        except Exception:  # the session may have gone before
            pass
