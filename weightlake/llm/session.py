"""Where intermediate results are kept, and the load sizes that follow from the input."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if its measured size is below this.
BROADCAST_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see; only a local session may do without the setting."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not (context.master or "").startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "weightlake-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and kept in the shared checkpoint folder, so that a lost executor costs no recomputation and no read differs from another."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, columns: list[str], limit: int = BROADCAST_BYTES) -> bool:
    """Whether the text of ``columns`` is below ``limit`` bytes in all, by a count over the whole table."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in columns), F.lit(0))
    return (df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first().n) < limit
