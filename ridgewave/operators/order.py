"""Places of rows in an order, and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's folder in the cluster's shared checkpoint folder; in local mode one of our own where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR")))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def clear_shared(spark: SparkSession) -> None:
    """Remove what this session has written to the shared folder, checkpoints and tables; no DataFrame made so far may be used after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(path, True)
    store.mkdirs(path)


class Stored:
    """Tables in the shared folder for steps that build on each other.

    A table read back has neither lineage nor the size estimates of the plan that made it, which would grow by a
    product with each join of an iteration.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self._tables: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self._tables)}"
        df.write.parquet(path)
        self._tables.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self._tables[-1][0]

    def drop(self, df: DataFrame) -> None:
        """Remove the files of a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(next(p for t, p in self._tables if t is df))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def accumulated(df: DataFrame, key: str, weight: str, *order: str) -> DataFrame:
    """``df`` with ``place``, the sum of ``weight`` over its key's rows before each row in order.

    Rows are range-partitioned by key and order, so a key of any size is spread; a row's place comes from its partition and
    the sums of its key in the partitions before, a table of one row for each key and partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.repartitionByRange(n, key, *order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy(key, "__part").agg(F.sum(weight).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(key).alias("__start_key"), F.col("__part").alias("__at"), before.alias("__before"))
    inside = F.coalesce(F.sum(weight).over(Window.partitionBy("__part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = dealt.withColumn("__inside", inside).join(starts, F.col(key).eqNullSafe(F.col("__start_key")) & (F.col("__part") == F.col("__at")))
    return joined.withColumn("place", F.col("__before") + F.col("__inside")).drop("__part", "__inside", "__start_key", "__at", "__before")


#: Starts (a row for each key and range) that are broadcast at most.
FEW = 100_000


def numbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``df`` with ``place``, each row's number from 0 among its key's rows in order.

    Rows are dealt and sorted once, by ranges of key and order; a row's place is its place in its range, less the first one of
    its key there, plus the key's rows in the ranges before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(key).alias("__start_key"), F.col("__part").alias("__at"), (before - F.col("__first")).alias("__shift"))
    few = starts.limit(FEW + 1).count() <= FEW
    on = F.col(key).eqNullSafe(F.col("__start_key")) & (F.col("__part") == F.col("__at"))
    return dealt.join(F.broadcast(starts) if few else starts, on).withColumn("place", F.col("__id") + F.col("__shift")).drop("__id", "__part", "__start_key", "__at", "__shift")
