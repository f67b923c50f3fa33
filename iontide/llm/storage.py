"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset and all runs on one machine (tests), a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="iontide-")
    return _own[key]


class Stored:
    """A DataFrame written as Parquet. ``frame`` reads it; ``discard`` deletes it.

    ``found``: how many rows the condition holds for, counted as they are written."""

    def __init__(self, frame: DataFrame, name: str, condition: Column | None = None):
        self.spark = frame.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        seen = Observation()
        counted = frame if condition is None else frame.observe(seen, F.count(F.when(condition, 1)).alias("found"))
        counted.write.parquet(self.path)
        self.found = None if condition is None else seen.get["found"]
        self.frame = self.spark.read.schema(frame.schema).parquet(self.path)

    def discard(self) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of a few megabytes: rows are long texts, of which the usual 10,000 may be any size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, str(most + 1)).rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
