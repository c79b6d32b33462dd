"""A store of archives by name, and the catalog that it keeps.

Each saving of the catalog is a version of its own, and readers see whole
versions only.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as entries
from . import archive
from .session import hadoop_path

VERSION = "version="


def versions(root: str, spark: SparkSession) -> list[int]:
    """The versions below a root, oldest first."""
    fs, top = hadoop_path(spark, root)
    names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
    return sorted(int(n.removeprefix(VERSION)) for n in names if n.startswith(VERSION))


def save(catalog: DataFrame, root: str) -> int:
    """Writes a catalog as the next version and returns its number; it may be made from the version that it follows. One writer at a time."""
    spark = catalog.sparkSession
    beside = f"{root}/_part-{uuid.uuid4().hex}"
    fs, part = hadoop_path(spark, beside)
    try:
        catalog.write.parquet(beside)
        number = max(versions(root, spark), default=0) + 1
        _, place = hadoop_path(spark, f"{root}/{VERSION}{number}")
        if fs.exists(place) or not fs.rename(part, place):
            raise FileExistsError(str(place))
    finally:
        fs.delete(part, True)
    return number


def load(root: str, spark: SparkSession, version: int | None = None) -> DataFrame:
    """The catalog of a version, the last one if none is named; FileNotFoundError if there is none."""
    there = versions(root, spark)
    if not there or version not in (None, *there):
        raise FileNotFoundError(root)
    return spark.read.parquet(f"{root}/{VERSION}{there[-1] if version is None else version}")


ENTRY = "name string, place string, original_size bigint, stored_size bigint, files int, source string, added double"


class Store:
    """Archives below a root, each in a folder of its own, found by the catalog. One writer at a time."""

    def __init__(self, root: str, spark: SparkSession, options: archive.Options = archive.Options()) -> None:
        self.root, self.spark, self.options = root.rstrip("/"), spark, options

    def catalog(self) -> DataFrame:
        """(name, place, original_size, stored_size, files, source, added) of all entries."""
        place = f"{self.root}/catalog"
        return load(place, self.spark) if versions(place, self.spark) else self.spark.createDataFrame([], ENTRY)

    def _save(self, rows: DataFrame) -> None:
        save(rows, f"{self.root}/catalog")

    def _place(self, name: str) -> str | None:
        row = self.catalog().where(F.col("name") == name).select("place").first()
        return row and row.place

    def _drop(self, place: str) -> None:
        fs, path = hadoop_path(self.spark, f"{self.root}/{place}")
        fs.delete(path, True)

    def open(self, name: str) -> str:
        """The root of an entry's archive; KeyError if there is none."""
        place = self._place(name)
        if place is None:
            raise KeyError(name)
        return f"{self.root}/{place}"

    def add(self, name: str, files: DataFrame, source: str | None = None, replace: bool = False) -> None:
        """Compresses files (path, content) as an entry. An entry of that name stays unless it may be replaced, and until the new one is whole."""
        old = self._place(name)
        if old is not None and not replace:
            raise ValueError(f"{name} is there already")
        place = f"archives/{uuid.uuid4().hex}"
        root = f"{self.root}/{place}"
        try:
            archive.compress(files.select(F.lit(name).alias("archive"), "path", "content"), root, self.options)
            self._save(entries.upsert(self.catalog(), self._entry(name, place, source)))
        except BaseException:
            self._drop(place)
            raise
        if old is not None:
            self._drop(old)

    def _entry(self, name: str, place: str, source: str | None) -> DataFrame:
        root = f"{self.root}/{place}"
        row = entries.rebuild(archive.stored(root, "members", self.spark), archive.stored(root, "chunks", self.spark))
        made = row.withColumn("name", F.lit(name)).withColumn("place", F.lit(place)).withColumn("source", F.lit(source).cast("string")).withColumn("added", F.lit(time.time()))
        return made.select(*[x.split()[0] for x in ENTRY.split(", ")])

    def grow(self, name: str, files: DataFrame) -> None:
        """Appends files (path, content) to an entry."""
        root = self.open(name)
        archive.append(files.select(F.lit(name).alias("archive"), "path", "content"), root, self.options)
        old = self.catalog().where(F.col("name") == name).first()
        self._save(entries.upsert(self.catalog(), self._entry(name, old.place, old.source)))

    def remove(self, name: str) -> None:
        """Takes an entry from the catalog, then its files away."""
        place = self._place(name)
        if place is None:
            raise KeyError(name)
        self._save(entries.remove(self.catalog(), self.spark.createDataFrame([(name,)], "name string")))
        self._drop(place)

    def rebuild(self) -> None:
        """A catalog made again from the archives that are there; where they came from, and when, is not known any more. Folders without members go unlisted."""
        fs, top = hadoop_path(self.spark, f"{self.root}/archives")
        rows = self.spark.createDataFrame([], ENTRY)
        for x in fs.listStatus(top) if fs.exists(top) else []:
            place = f"archives/{x.getPath().getName()}"
            if ".part-" in place:
                continue
            members = archive.stored(f"{self.root}/{place}", "members", self.spark)
            name = members.select("archive").first()
            if name is not None:
                rows = rows.unionByName(self._entry(name.archive, place, None).withColumn("added", F.lit(None).cast("double")))
        self._save(rows)

    def models(self) -> DataFrame:
        """A row for each entry, by name, and one total row at the end."""
        return entries.report(self.catalog())

    def restore(self, name: str, path: str | None = None) -> DataFrame:
        return archive.restore(self.open(name), self.spark, path, self.options)

    def read_tensor(self, name: str, tensor: str) -> DataFrame:
        return archive.read_tensor(self.open(name), self.spark, tensor, self.options)

    def extract(self, name: str, dest: str, path: str | None = None) -> DataFrame:
        return archive.extract(self.open(name), dest, self.spark, name, path, self.options)
