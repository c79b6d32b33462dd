"""Reading ranges: which chunk holds an offset, cutting and joining bytes, following copies, checking digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _grains(start, end, grain: int):
    """The grid cells that [start, end) touches; an equi-join on cells stands in for a join on overlap."""
    return F.explode(F.sequence(F.floor(start / grain), F.floor(F.greatest(end - 1, start) / grain)))


def overlaps(requests: DataFrame, chunks: DataFrame, keys: list[str], grain: int) -> DataFrame:
    """Requests (pos, len) with each chunk (dst, rlen) that they touch, once."""
    r = requests.withColumn("_cell", _grains(F.col("pos"), F.col("pos") + F.col("len"), grain))
    c = chunks.where("rlen > 0").withColumn("_cell", _grains(F.col("dst"), F.col("dst") + F.col("rlen"), grain))
    both = r.join(c, [*keys, "_cell"])
    meet = (F.col("dst") < F.col("pos") + F.col("len")) & (F.col("dst") + F.col("rlen") > F.col("pos"))
    # a pair that shares several cells counts in the first
    return both.where(meet & (F.col("_cell") == F.floor(F.greatest("dst", "pos") / grain))).drop("_cell")


def locate(requests: DataFrame, chunks: DataFrame, keys: list[str], grain: int) -> DataFrame:
    """Requests (pos) with the chunk that holds the position; positions that none holds are left out."""
    return overlaps(requests.withColumn("len", F.lit(1)), chunks, keys, grain).drop("len").withColumn("within", F.col("pos") - F.col("dst"))


def read_ranges(requests: DataFrame, chunks: DataFrame, keys: list[str], request: list[str], grain: int, data: str = "data") -> DataFrame:
    """(request, bytes): each request's bytes, cut at the end of what exists. Chunks hold decoded bytes."""
    parts = overlaps(requests, chunks, keys, grain)
    begin = F.greatest(F.col("pos") - F.col("dst"), F.lit(0)).cast("int")
    stop = F.least(F.col("pos") + F.col("len") - F.col("dst"), F.col("rlen")).cast("int")
    parts = parts.select(*request, "dst", F.substring(F.col(data), begin + 1, stop - begin).alias("_bytes"))
    joined = parts.groupBy(*request).agg(F.sort_array(F.collect_list(F.struct("dst", "_bytes"))).alias("_parts"))
    empty = F.unhex(F.lit(""))
    return joined.select(*request, F.aggregate("_parts", empty, lambda a, p: F.concat(a, p["_bytes"])).alias("bytes"))


def tensor_requests(tensors: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Tensors as requests on the output space: a member's offset and the tensor's range in it."""
    t = tensors.join(members.select(*keys, "member_id", "dst"), [*keys, "member_id"])
    return t.withColumn("pos", F.col("dst") + F.col("start")).withColumn("len", F.col("end") - F.col("start")).drop("dst")


def resolve_sources(chunks: DataFrame, keys: list[str], ref: int, delta: int, grain: int, holders: DataFrame | None = None) -> DataFrame:
    """For each copy or difference, the chunks, of ``holders`` if given, that hold its source bytes; which must have bytes of their own."""
    wants = chunks.where(F.col("codec").isin(ref, delta)).select(*keys, F.col("chunk_id").alias("for_chunk"), F.col("src").alias("pos"), F.col("rlen").alias("len"))
    holds = (chunks if holders is None else holders).select(*keys, "chunk_id", "dst", "rlen", "codec")
    found = overlaps(wants, holds, keys, grain)
    begin, stop = F.greatest("pos", "dst"), F.least(F.col("pos") + F.col("len"), F.col("dst") + F.col("rlen"))
    return found.select(*keys, "for_chunk", F.col("chunk_id").alias("source_chunk"), F.col("codec").alias("source_codec"), (begin - F.col("dst")).alias("begin"), (stop - F.col("dst")).alias("stop"), (begin - F.col("pos")).alias("at"))


def chained(resolved: DataFrame, ref: int, delta: int) -> DataFrame:
    """Sources that are copies or differences themselves."""
    return resolved.where(F.col("source_codec").isin(ref, delta))


def touched(requests: DataFrame, chunks: DataFrame, keys: list[str], ref: int, delta: int, grain: int) -> DataFrame:
    """(keys, chunk_id) of the chunks that requests (pos, len) touch, and of those that these take bytes from."""
    hit = overlaps(requests.select(*keys, "pos", "len"), chunks.select(*keys, "chunk_id", "dst", "rlen"), keys, grain).select(*keys, "chunk_id").distinct()
    asked = chunks.join(hit, [*keys, "chunk_id"], "left_semi")
    more = resolve_sources(asked, keys, ref, delta, grain, chunks).select(*keys, F.col("source_chunk").alias("chunk_id"))
    return hit.unionByName(more).distinct()


def unresolved(chunks: DataFrame, resolved: DataFrame, keys: list[str], ref: int, delta: int) -> DataFrame:
    """Copies and differences whose source is not wholly there."""
    have = resolved.groupBy(*keys, F.col("for_chunk").alias("chunk_id")).agg(F.sum(F.col("stop") - F.col("begin")).alias("_have"))
    wants = chunks.where(F.col("codec").isin(ref, delta)).select(*keys, "chunk_id", "rlen")
    return wants.join(have, [*keys, "chunk_id"], "left").where(F.coalesce("_have", F.lit(0)) != F.col("rlen")).select(*keys, "chunk_id")


def greedy_batches(items: DataFrame, keys: list[str], order: str, size: str, target: int) -> DataFrame:
    """(keys, order, batch): batches that close as soon as they reach the target, in order. A batch depends on all before it in its key, so each key is one fold."""
    rows = items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("_items"))
    start = F.struct(F.lit(0).cast("long").alias("acc"), F.lit(0).alias("batch"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        full = a.acc + x.s >= target
        return F.struct(F.when(full, F.lit(0).cast("long")).otherwise(a.acc + x.s).alias("acc"), F.when(full, a.batch + 1).otherwise(a.batch).alias("batch"), F.concat(a.out, F.array(a.batch)).alias("out"))

    folded = rows.select(*keys, "_items", F.aggregate("_items", start, step).out.alias("_out"))
    return folded.select(*keys, F.explode(F.arrays_zip("_items", "_out")).alias("z")).select(*keys, F.col("z._items.o").alias(order), F.col("z._out").alias("batch"))
