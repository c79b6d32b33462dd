"""Streams: sequential readers, and archives that grow by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import archive
from ..plans.session import hadoop_path

#: How far ahead of a continuing reader is fetched.
AHEAD = 4 << 20


def sequential_runs(reads: DataFrame, keys: list[str], order: str, offset: str = "offset", size: str = "size") -> DataFrame:
    """Adds ``goes_on`` (the read begins where the key's last one ended) and ``run`` (runs of such reads, from 1)."""
    w = Window.partitionBy(*keys).orderBy(order)
    goes_on = F.coalesce(F.lag(F.col(offset) + F.col(size)).over(w) == F.col(offset), F.lit(False))
    marked = reads.withColumn("goes_on", goes_on)
    return marked.withColumn("run", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def fetch_ahead(stream: DataFrame, ahead: int = AHEAD) -> DataFrame:
    """For a stream (key, seq, offset, size): each read with what to fetch ahead of it, [ahead_start, ahead_end), empty where it does not continue.

    State for each key: where the next read is expected, and up to where was
    fetched; a seek resets both.
    """

    def step(key, batches, state):
        expected, frontier = state.get if state.exists else (-1, -1)
        for pdf in batches:
            out = []
            for r in pdf.sort_values("seq").itertuples():
                end = r.offset + r.size
                start = stop = end
                if r.offset == expected:
                    start = max(frontier, end)
                    stop = max(end + ahead, start)
                    frontier = stop
                else:
                    frontier = end
                expected = end
                out.append((key[0], r.seq, r.offset, r.size, start, stop))
            state.update((expected, frontier))
            yield pd.DataFrame(out, columns=["key", "seq", "offset", "size", "ahead_start", "ahead_end"])

    return stream.groupBy("key").applyInPandasWithState(step, "key string, seq long, offset long, size long, ahead_start long, ahead_end long", "expected long, frontier long", "append", "NoTimeout")


def append_stream(stream: DataFrame, append: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that appends every micro-batch of new files to an archive."""
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grow_archive(stream: DataFrame, root: str, checkpoint: str, options: archive.Options = archive.Options()):
    """Starts a query that keeps a stream of files (archive, path, content) as archives below a root; a micro-batch that is run again is kept once."""

    def append(files: DataFrame, epoch: int) -> None:
        if files.isEmpty():
            return
        fs, top = hadoop_path(files.sparkSession, root)
        write = archive.append if fs.exists(top) and len(fs.listStatus(top)) else archive.compress
        write(files, root, options, label=f"batch-{epoch}")

    return append_stream(stream, append, checkpoint)
