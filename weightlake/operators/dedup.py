"""Equal and nearly equal ranges: staged duplicate search and difference candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import digest_windows

#: Ranges below this are neither copied nor coded as differences.
LEAST_BYTES = 1 << 16
SAMPLE = 1 << 16


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur twice or more: counts are taken before the join, so a frequent key costs one row of it."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(groups, keys, "left_semi")


def duplicates(ranges: DataFrame, order: list[str], data: str = "data", least: int = LEAST_BYTES, sample: int = SAMPLE) -> DataFrame:
    """Ranges with (source columns src_*): the earliest range with equal bytes, for each range that is not the earliest.

    Three stages: equal sizes, equal digests of three windows, equal digests of
    all bytes; the whole bytes of a range are hashed only if it passed two.
    """
    keys = [c for c in ranges.columns if c != data]
    fit = ranges.withColumn("_size", F.octet_length(data).cast("long")).where(F.col("_size") >= least)
    first = repeated(fit, ["_size"])
    second = repeated(first.withColumn("_part", F.sha2(digest_windows(F.col(data), F.col("_size"), sample), 256)), ["_size", "_part"])
    hashed = second.select(*keys, "_size", F.sha2(F.col(data), 256).alias("_hash"))
    earliest = hashed.groupBy("_size", "_hash").agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    found = hashed.join(earliest, ["_size", "_hash"]).where(F.struct(*order) != F.col("_first"))
    return found.select(*keys, F.col("_size").alias("size"), *[F.col(f"_first.{c}").alias(f"src_{c}") for c in order])


def delta_candidates(tensors: DataFrame, match: list[str], order: list[str], taken: DataFrame | None = None, sources: DataFrame | None = None, latest: bool = False, bases: DataFrame | None = None) -> DataFrame:
    """Tensors with the base (base_*) of equal ``match`` columns that they may be coded against.

    The base is the earliest, or for appending the latest, of its group; for
    appending it is one of ``bases``, not of the tensors themselves.
    Ranges in ``taken`` are copies already; those in ``sources`` are sources of
    copies and must keep their own bytes.
    """
    rows = tensors
    for other in (taken, sources):
        if other is not None:
            rows = rows.join(other, order, "left_anti")
    pick = F.max if latest else F.min
    base = bases if bases is not None else tensors if taken is None else tensors.join(taken, order, "left_anti")
    base = base.groupBy(*match).agg(pick(F.struct(*order)).alias("_base"))
    found = rows.join(base, match).where(F.struct(*order) != F.col("_base"))
    return found.select(*tensors.columns, *[F.col(f"_base.{c}").alias(f"base_{c}") for c in order])


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
