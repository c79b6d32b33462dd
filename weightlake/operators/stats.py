"""Byte statistics: histograms, entropy, coding cost, buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels


def byte_counts(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """(keys, byte, cnt): how often each byte value occurs in the rows of a key. Counted within batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(len(keys))
            if isinstance(column, (pa.StringArray, pa.LargeStringArray)):
                column = column.cast(pa.binary())
            groups: dict[tuple, np.ndarray] = {}
            names = list(zip(*(b.column(i).to_pylist() for i in range(len(keys))))) if keys else [()] * b.num_rows
            for name, raw in zip(names, column):
                raw = raw.as_buffer()
                if raw is not None and raw.size:
                    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                    groups[name] = groups[name] + h if name in groups else h
            at = [(name, v, int(h[v])) for name, h in groups.items() for v in np.flatnonzero(h).tolist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([a[0][i] for a in at], b.schema.field(i).type) for i in range(len(keys))), pa.array([a[1] for a in at], pa.int32()), pa.array([a[2] for a in at], pa.int64())], names=[*keys, "byte", "cnt"])

    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("byte", T.IntegerType()), T.StructField("cnt", T.LongType())])
    return df.select(*keys, data).mapInArrow(run, schema).groupBy(*keys, "byte").agg(F.sum("cnt").alias("cnt"))


def entropy(counts: DataFrame, keys: list[str], count: str = "cnt") -> DataFrame:
    """(keys, total, bits): bits for each symbol, from counts in long form. log2(n) - sum(c log2 c) / n needs one pass."""
    c = F.col(count)
    out = counts.where(c > 0).groupBy(*keys).agg(F.sum(c).cast("long").alias("total"), F.sum(c * F.log2(c.cast("double"))).alias("_s"))
    return out.withColumn("bits", F.log2(F.col("total").cast("double")) - F.col("_s") / F.col("total")).drop("_s")


def stream_estimate(total: Column, bits: Column) -> Column:
    """Bytes of a coded stream by its entropy, with a coder's fixed cost; never above its length."""
    return F.when(total == 0, 0).otherwise(F.least(total, F.floor(total * bits / 8) + 548)).cast("long")


def min_gain(n: Column) -> Column:
    return F.greatest(F.lit(1024), F.shiftright(n, 8)).cast("long")


def gate(total: Column, bits: Column, noise_bits: float = 7.98) -> Column:
    """Whether a stream is coded, too noisy to try, or not worth its coder's cost."""
    return F.when(bits >= noise_bits, "noise").when(stream_estimate(total, bits) + min_gain(total) >= total, "no gain").otherwise("coded")


def code_frequencies(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, byte, cnt, freq, cost): coder frequencies, which add up to 4096, and the stream's least coded size."""

    def run(pdf):
        h = np.zeros(256, np.int64)
        h[pdf["byte"]] = pdf["cnt"]
        f = kernels.frequencies(h)
        return pdf.assign(freq=f[pdf["byte"]], cost=kernels.coded_cost(h))

    schema = T.StructType([counts.schema[k] for k in keys] + T._parse_datatype_string("byte int, cnt bigint, freq bigint, cost bigint").fields)
    return counts.select(*keys, "byte", "cnt").groupBy(*keys).applyInPandas(run, schema)


def mass_buckets(counts: DataFrame, keys: list[str], k: int, symbol: str = "byte", count: str = "cnt") -> DataFrame:
    """Adds ``bucket``: k buckets of about equal mass over the symbols in order."""
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum(count).over(w.orderBy(symbol).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(count).over(w)
    return counts.withColumn("bucket", F.least(F.lit(k - 1), F.floor(before * k / total)).cast("int"))


def bucket_counts(bucketed: DataFrame, keys: list[str], count: str = "cnt") -> DataFrame:
    return bucketed.groupBy(*keys, "bucket").agg(F.sum(count).cast("long").alias("cnt"))


def place_in_bucket(rows: DataFrame, buckets: DataFrame, keys: list[str], symbol: str, order: list[str]) -> DataFrame:
    """Each row's bucket by its symbol and its place there, in the given order: a stable partition."""
    joined = rows.join(buckets.select(*keys, F.col("byte").alias(symbol), "bucket"), [*keys, symbol])
    return joined.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*order)) - 1)


def conditional_entropy(pairs: DataFrame, keys: list[str], context: str, value: str, count: str = "cnt") -> DataFrame:
    """(keys, total, plain_bits, cond_bits): entropy of a value alone and given its context, from joint counts."""
    total = pairs.groupBy(*keys, context).agg(F.sum(count).alias("_n"), F.sum(F.col(count) * F.log2(F.col(count).cast("double"))).alias("_s"))
    cond = total.groupBy(*keys).agg(F.sum("_n").cast("long").alias("total"), (F.sum(F.col("_n") * F.log2(F.col("_n").cast("double")) - F.col("_s"))).alias("_b"))
    alone = entropy(pairs.groupBy(*keys, value).agg(F.sum(count).alias("cnt")), keys).select(*keys, F.col("bits").alias("plain_bits"))
    return cond.withColumn("cond_bits", F.col("_b") / F.col("total")).drop("_b").join(alone, keys)
