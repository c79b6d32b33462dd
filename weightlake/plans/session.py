"""Sessions, intermediate tables and ordered running sums."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        # only a local session may do without such a folder
        if not shared and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "weightlake-checkpoints"))
    return df.checkpoint(eager=True)


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def running_total(df: DataFrame, value: str, order: list[str], into: str, parts: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows in ``order``.

    A running sum over a whole table by one window would put all rows in one
    task. Here rows are range-partitioned, summed within partitions, and each
    partition's start comes from a window over one row for each partition.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = kept(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.sum(value).cast("long").alias("_size"))
    starts = totals.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    # one row for each partition
    joined = placed.join(F.broadcast(starts), "_part")
    return joined.withColumn(into, (F.col("_start") + F.coalesce(F.sum(value).over(w), F.lit(0))).cast("long")).drop("_part", "_start")


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is not positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
