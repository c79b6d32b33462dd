"""Files: listing them, and reading byte ranges of files too large for one row."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.session import hadoop_path


def open_store(place: str):
    """The file system of a path, any that pyarrow knows and local paths with or without a scheme, and the path as it takes it."""
    from pyarrow import fs

    if "://" in place and not place.startswith("file:"):
        return fs.FileSystem.from_uri(place)
    plain = "/" + place.removeprefix("file:").lstrip("/") if place.startswith("file:") else os.path.abspath(place)
    return fs.LocalFileSystem(), plain


def _listing(spark: SparkSession, root: str) -> tuple[DataFrame, str]:
    """(place, path, size) of all files below a folder, or of the one that is named, by the file system's own listing; and the folder's name there."""
    fs, top = hadoop_path(spark, root)
    base = fs.makeQualified(top).toString().rstrip("/") + "/"
    rows, files = [], fs.listFiles(top, True)
    while files.hasNext():
        status = files.next()
        place = status.getPath().toString()
        path = place.removeprefix(base) if place.startswith(base) else place.rpartition("/")[2]
        if path.rpartition("/")[2] != ".DS_Store":
            rows.append((place, path, status.getLen()))
    return spark.createDataFrame(rows, "place string, path string, size bigint"), base


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of all files below a folder, paths relative; contents are not read."""
    return _listing(spark, root)[0].select("path", "size")


def read_files(spark: SparkSession, root: str, archive: str) -> DataFrame:
    """(archive, path, content) of all files below a folder, or of one file.

    Spark's file source passes over empty files and names that begin with a
    dot or an underscore; these are read by their listed places.
    """
    listed, base = _listing(spark, root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("place"), "content")
    name = F.when(F.startswith("place", F.lit(base)), F.substr("place", F.lit(len(base) + 1))).otherwise(F.element_at(F.split("place", "/"), -1))
    seen = found.select(name.alias("path"), "content").where(F.element_at(F.split("path", "/"), -1) != ".DS_Store")
    rest = listed.join(found.select("place"), "place", "left_anti").select("place", "path", "size")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                content = b""
                if row["size"]:
                    store, place = open_store(row["place"])
                    with store.open_input_file(place) as f:
                        content = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]], pa.string()), pa.array([content], pa.binary())], names=["path", "content"])

    both = seen.unionByName(rest.mapInArrow(read, "path string, content binary"))
    return both.select(F.lit(archive).alias("archive"), "path", "content")


class _Slice(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class _SliceReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size, self.step = options["path"], int(options["size"]), int(options.get("step", 8 << 20))

    def partitions(self) -> list[_Slice]:
        return [_Slice(self.path, a, min(a + self.step, self.size)) for a in range(0, self.size, self.step)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        store, path = open_store(partition.path)
        with store.open_input_file(path) as f:
            yield partition.path, partition.start, partition.end, f.read_at(partition.end - partition.start, partition.start)


class ByteRanges(DataSource):
    """``spark.read.format("byte_ranges").option("path", p).option("size", n).option("step", k)``: a row for each range, read by a task of its own."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, start bigint, end bigint, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _SliceReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ByteRanges)
