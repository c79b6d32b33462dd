"""The catalog of archives, and growing an archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import share


def clashing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New members that are there already."""
    return new.join(old.select(*keys), keys, "left_semi")


def append_members(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new members; new ones take the offsets after the old total. A member that is there already is an error before anything else happens."""
    if not clashing(old, new, keys).isEmpty():
        raise ValueError("members are there already")
    total = old.agg(F.coalesce(F.max(F.col("dst") + F.col("size")), F.lit(0)).alias("n")).first().n
    return old.unionByName(new.withColumn("dst", F.col("dst") + total).select(*old.columns))


def upsert(catalog: DataFrame, entries: DataFrame, key: str = "name") -> DataFrame:
    """The catalog with entries added, in place of those of the same name."""
    return catalog.join(entries.select(key), key, "left_anti").select(*catalog.columns).unionByName(entries.select(*catalog.columns))


def remove(catalog: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    return catalog.join(names.select(key), key, "left_anti")


def missing(catalog: DataFrame, wanted: DataFrame, key: str = "name") -> DataFrame:
    """Wanted names that the catalog has not."""
    return wanted.select(key).distinct().join(catalog.select(key), key, "left_anti")


def totals(catalog: DataFrame) -> DataFrame:
    t = catalog.agg(F.count("*").alias("models"), F.coalesce(F.sum("original_size"), F.lit(0)).alias("original_size"), F.coalesce(F.sum("stored_size"), F.lit(0)).alias("stored_size"))
    return t.withColumn("saved", F.when(F.col("original_size") > 0, 1 - share(F.col("stored_size"), F.col("original_size"))).otherwise(0.0))


def report(catalog: DataFrame) -> DataFrame:
    """A row for each entry, by name, and one total row at the end."""
    rows = catalog.rollup("name").agg(F.grouping("name").alias("_all"), F.sum("original_size").alias("original_size"), F.sum("stored_size").alias("stored_size"), F.sum("files").alias("files"))
    return rows.withColumn("ratio", share(F.col("original_size"), F.col("stored_size"))).orderBy("_all", "name").withColumn("name", F.coalesce("name", F.lit("total"))).drop("_all")


def extents(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each archive of ``members`` its size when restored and its longest chunk, 0 where it has none."""
    size = members.groupBy("archive").agg(F.max(F.col("dst") + F.col("size")).alias("archive_size"))
    longest = chunks.groupBy("archive").agg(F.max("rlen").alias("block_bytes"))
    return size.join(longest, "archive", "left").select("archive", F.coalesce("archive_size", F.lit(0)).alias("archive_size"), F.coalesce("block_bytes", F.lit(0)).alias("block_bytes"))


def rebuild(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """The catalog from the archives themselves; where an entry came from, and when, is not known any more."""
    m = members.groupBy("archive").agg(F.sum("size").alias("original_size"), F.count("*").cast("int").alias("files"), F.sort_array(F.collect_list("path")).alias("members"))
    c = chunks.groupBy("archive").agg(F.sum("clen").alias("stored_size"))
    return m.join(c, "archive", "left").select(F.col("archive").alias("name"), "archive", "original_size", F.coalesce("stored_size", F.lit(0)).alias("stored_size"), "files", F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("added"), "members")


def prefer_raw(size, stored):
    """Whether a file is kept as it is: it is small, or coding saves less than a fiftieth."""
    return (size < 4096) | (stored * 50 > size * 49)
