"""Archives as tables: writing, growing, reading, checking and describing them.

An archive is three Parquet tables below a root (members, tensors, chunks),
partitioned by archive. Chunk bytes are encoded; copies and differences name
their source by its offset in the archive's output space. Rows that are
appended carry a batch, and are seen once a marker for it lies in ``_commits``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec as c
from ..functions.scalars import safe_path
from ..functions.tables import BYTES, DELTA, REF
from ..operators import catalog, codecs, dedup, planning, reads
from ..sources.containers import regions_of, tensor_index
from ..sources.ranges import open_store
from .session import hadoop_path, kept

KEYS = ["archive", "path"]


@dataclass(frozen=True)
class Options:
    chunk_size: int = 8 << 20
    least: int = dedup.LEAST_BYTES
    settings: c.Settings = c.Settings()
    dedup: bool = True
    delta: bool = True
    delta_gain: float = 0.05
    delta_sample: int = 1 << 20

    def __post_init__(self) -> None:
        if self.chunk_size < 1 << 10:
            raise ValueError("chunks of less than 1 KiB cost more than they hold")


def plan_members(files: DataFrame, start: int = 0) -> DataFrame:
    """(archive, path, size, dst): members in the order of their paths, end to end; unsafe paths fail the query."""
    from pyspark.sql import Window

    ok = F.when(safe_path(F.col("path")), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("unsafe path: "), F.col("path"))))
    w = Window.partitionBy("archive").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    sized = files.select("archive", ok.alias("path"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size"))
    return sized.withColumn("dst", (F.coalesce(F.sum("size").over(w), F.lit(0)) + start).cast("long"))


def _tensor_bytes(tensors: DataFrame, files: DataFrame) -> DataFrame:
    both = tensors.join(files.select(*KEYS, "content"), KEYS)
    return both.withColumn("data", F.substring("content", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))).drop("content")


def find_refs(tensors: DataFrame, files: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """(archive, path, start, end, src): tensors equal to an earlier one, and where that starts in the output space."""
    dst = members.select("archive", "path", "dst")
    ranges = _tensor_bytes(tensors.select(*KEYS, "start", "end").where(F.col("end") > F.col("start")).distinct(), files)
    found = dedup.duplicates(ranges, ["archive", "path", "start"], least=least).where("archive = src_archive")
    return found.join(dst.withColumnsRenamed({"path": "src_path"}), ["archive", "src_path"]).select(*KEYS, "start", "end", (F.col("dst") + F.col("src_start")).alias("src"), "src_path", "src_start")


PLACE = ["archive", "path", "start"]


def _delta_rows(tensors: DataFrame, options: Options) -> DataFrame:
    return tensors.where(F.col("end") - F.col("start") >= options.least).select(*KEYS, "name", "dtype", (F.col("end") - F.col("start")).alias("size"), "start", "end", "esize", "kind", "btype")


def _sample_of(options: Options) -> tuple[Column, Column]:
    """Where the sample of a tensor (size, esize) begins, and its length."""
    half = F.greatest(F.col("size") - options.delta_sample, F.lit(0)) / 2
    first = (F.floor(half / F.col("esize")) * F.col("esize")).cast("int")
    return first, F.least(F.col("size"), F.lit(options.delta_sample) - F.lit(options.delta_sample) % F.col("esize")).cast("int")


def _worthwhile(both: DataFrame, options: Options) -> DataFrame:
    """The rows whose sample ``own`` codes clearly smaller as a difference from ``base``."""
    keep = [x for x in both.columns if x not in ("own", "base")]
    plain = codecs.encode_chunks(both.withColumn("ikind", F.lit(BYTES)).withColumnRenamed("own", "data"), options.settings, base="base").select(*keep, F.col("clen").alias("plain_size"))
    diff = codecs.encode_chunks(both.withColumn("ikind", F.col("kind")).withColumn("kind", F.lit(DELTA)).withColumnRenamed("own", "data"), options.settings, base="base").select(*PLACE, F.col("clen").alias("delta_size"))
    return plain.join(diff, PLACE).where(F.col("delta_size") < F.col("plain_size") * (1 - options.delta_gain))


def find_deltas(tensors: DataFrame, files: DataFrame, members: DataFrame, refs: DataFrame, options: Options, taken: DataFrame | None = None) -> DataFrame:
    """(archive, path, start, end, src): tensors that code clearly smaller against an equally named, typed and sized earlier one, by a sample coded both ways; those in ``taken`` are differences already."""
    sources = refs.select("archive", F.col("src_path").alias("path"), F.col("src_start").alias("start")).distinct()
    coded = refs.select(*PLACE) if taken is None else refs.select(*PLACE).unionByName(taken.select(*PLACE))
    cand = dedup.delta_candidates(_delta_rows(tensors, options), ["archive", "name", "dtype", "size"], PLACE, taken=coded, sources=sources)
    cand = cand.where("path != base_path").drop("base_archive")
    first, length = _sample_of(options)
    part = lambda data: F.substring(data, first + 1, length)
    own = _tensor_bytes(cand, files).withColumn("own", part(F.col("data"))).drop("data")
    base = files.select("archive", F.col("path").alias("base_path"), F.col("content").alias("base_content"))
    both = own.join(base, ["archive", "base_path"])
    both = both.withColumn("base", part(F.substring("base_content", (F.col("base_start") + 1).cast("int"), F.col("size").cast("int")))).drop("base_content")
    dst = members.select("archive", F.col("path").alias("base_path"), "dst")
    return _worthwhile(both, options).join(dst, ["archive", "base_path"]).select(*KEYS, "start", "end", (F.col("dst") + F.col("base_start")).alias("src"))


COMMITS = "_commits"
#: The tables' columns; one without rows has no files to take them from.
TABLES = {
    "members": "path string, size bigint, dst bigint, kind string, batch string, archive string",
    "tensors": "path string, name string, dtype string, shape array<bigint>, start bigint, end bigint, esize int, kind int, btype int, batch string, archive string",
    "chunks": f"dst bigint, path string, start bigint, end bigint, esize int, kind int, src bigint, btype int, ikind int, rlen bigint, clen bigint, crc bigint, codec int, inner_codec int, layout array<int>, streams {codecs.STREAMS}, chunk_id bigint, batch string, archive string",
}


def commits(root: str, spark: SparkSession) -> list[str]:
    """The markers of what was appended whole: a label, ``@`` and the batch."""
    fs, place = hadoop_path(spark, f"{root}/{COMMITS}")
    return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []


def _committed(root: str, spark: SparkSession, label: str) -> bool:
    return any(x.rpartition("@")[0] == label for x in commits(root, spark))


def _commit(root: str, spark: SparkSession, label: str, batch: str) -> None:
    fs, place = hadoop_path(spark, f"{root}/{COMMITS}/{label}@{batch}")
    if not fs.createNewFile(place):
        raise FileExistsError(str(place))


def stored(root: str, name: str, spark: SparkSession) -> DataFrame:
    """A table of the archives below a root, without what an append that failed left there."""
    whole = [x.rpartition("@")[2] for x in commits(root, spark)]
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}").where(F.col("batch").isNull() | F.col("batch").isin(whole)).drop("batch")


def _stored_bytes(root: str, requests: DataFrame, request: list[str], options: Options) -> DataFrame:
    """(request, bytes) of ranges (archive, pos, len) of the archives below a root, from chunks with bytes of their own; only chunks that are asked for are decoded."""
    chunks = stored(root, "chunks", requests.sparkSession).where(~F.col("codec").isin(c.C_REF, c.C_DELTA))
    asked = reads.overlaps(requests.select("archive", "pos", "len"), chunks.select("archive", "chunk_id", "dst", "rlen"), ["archive"], options.chunk_size)
    own = codecs.decode_chunks(chunks.join(asked.select("archive", "chunk_id").distinct(), ["archive", "chunk_id"], "left_semi"), options.settings.buckets)
    return reads.read_ranges(requests, own.select("archive", "dst", "rlen", "data"), ["archive"], request, options.chunk_size)


def find_append_deltas(tensors: DataFrame, files: DataFrame, members: DataFrame, refs: DataFrame, root: str, options: Options) -> DataFrame:
    """(archive, path, start, end, src): tensors that code clearly smaller against the latest equally named, typed and sized one that the archive holds plainly, by a sample coded both ways."""
    spark = files.sparkSession
    place = lambda t, m: t.join(m.select(*KEYS, "dst"), KEYS).withColumn("pos", F.col("dst") + F.col("start")).drop("dst")
    there = place(_delta_rows(stored(root, "tensors", spark), options), stored(root, "members", spark))
    coded = stored(root, "chunks", spark).where(F.col("codec").isin(c.C_REF, c.C_DELTA)).select("archive", "dst", "rlen")
    asked = there.select("archive", "pos", F.col("size").alias("len")).distinct()
    there = there.join(reads.overlaps(asked, coded, ["archive"], options.chunk_size).select("archive", "pos", F.col("len").alias("size")).distinct(), ["archive", "pos", "size"], "left_anti")
    # copies have no bytes of their own, and sources of copies must keep theirs
    rows = place(_delta_rows(tensors, options), members).join(refs.select(*PLACE), PLACE, "left_anti")
    rows = rows.join(refs.select("archive", F.col("src_path").alias("path"), F.col("src_start").alias("start")), PLACE, "left_anti")
    cand = kept(dedup.delta_candidates(rows, ["archive", "name", "dtype", "size"], ["pos"], latest=True, bases=there))
    first, length = _sample_of(options)
    own = _tensor_bytes(cand, files).withColumn("own", F.substring("data", first + 1, length)).drop("data")
    asked = cand.select(*PLACE, (F.col("base_pos") + first).alias("pos"), length.alias("len"))
    base = _stored_bytes(root, asked, PLACE, options).withColumnRenamed("bytes", "base")
    both = own.join(base, PLACE).where(F.octet_length("base") == F.octet_length("own"))
    return _worthwhile(both, options).select(*KEYS, "start", "end", F.col("base_pos").alias("src"))


def plan(files: DataFrame, options: Options = Options(), root: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members, tensors and planned chunks of files (archive, path, content); with a root, behind what the archives there hold, and against it."""
    members = plan_members(files)
    if root is not None:
        total = stored(root, "members", files.sparkSession).groupBy("archive").agg(F.max(F.col("dst") + F.col("size")).alias("total"))
        members = members.join(total, "archive", "left").withColumn("dst", F.col("dst") + F.coalesce("total", F.lit(0))).drop("total")
    members = kept(members)
    index = kept(tensor_index(files, KEYS))
    tensors = index.select(*KEYS, F.explode("tensors").alias("t")).select(*KEYS, "t.*")
    refs = deltas = None
    if options.dedup:
        refs = kept(find_refs(tensors, files, members, options.least))
    if options.delta:
        none = files.sparkSession.createDataFrame([], "archive string, path string, start bigint, src_path string, src_start bigint")
        copies = none if refs is None else refs
        taken = None if root is None else kept(find_append_deltas(tensors, files, members, copies, root, options))
        deltas = find_deltas(tensors, files, members, copies, options, taken)
        deltas = kept(deltas if taken is None else deltas.unionByName(taken))
    chunks = planning.plan_chunks(regions_of(index, KEYS), members, KEYS, options.chunk_size, refs, deltas)
    chunks = chunks.join(members.select(*KEYS, F.col("dst").alias("m_dst")), KEYS)
    return members.join(index.select(*KEYS, F.col("container").alias("kind")), KEYS), tensors, chunks.withColumn("dst", F.col("m_dst") + F.col("start")).drop("m_dst")


def _with_bases(chunks: DataFrame, members: DataFrame, files: DataFrame, options: Options, root: str | None = None) -> DataFrame:
    """Adds ``base``: the source bytes of differences. A source lies in one member, of the files or of the archives below the root."""
    m = members.select("archive", F.col("path").alias("b_path"), F.col("dst").alias("b_dst"), "size")
    want = chunks.where(F.col("kind") == DELTA).select("archive", "dst", "src", (F.col("end") - F.col("start")).alias("n"))
    at = want.join(m, "archive").where((F.col("src") >= F.col("b_dst")) & (F.col("src") < F.col("b_dst") + F.col("size")))
    got = at.join(files.select("archive", F.col("path").alias("b_path"), "content"), ["archive", "b_path"])
    got = got.select("archive", "dst", F.substring("content", (F.col("src") - F.col("b_dst") + 1).cast("int"), F.col("n").cast("int")).alias("base"))
    if root is not None:
        asked = want.select("archive", F.col("dst").alias("for_dst"), F.col("src").alias("pos"), F.col("n").alias("len"))
        got = got.unionByName(_stored_bytes(root, asked, ["archive", "for_dst"], options).select("archive", F.col("for_dst").alias("dst"), F.col("bytes").alias("base")))
    return chunks.join(got, ["archive", "dst"], "left")


def encode(files: DataFrame, members: DataFrame, planned: DataFrame, options: Options = Options(), root: str | None = None) -> DataFrame:
    """The chunk table: planned chunks with their encoded bytes."""
    rows = planned.join(files.select(*KEYS, "content"), KEYS)
    rows = rows.withColumn("data", F.when(F.col("kind") == REF, F.lit(None)).otherwise(F.substring("content", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))).drop("content")
    done = codecs.encode_chunks(_with_bases(rows, members, files, options, root), options.settings, base="base")
    # a copy's length is its range's, and its bytes are checked at their source
    copy = F.col("codec") == c.C_REF
    return done.withColumn("rlen", F.when(copy, F.col("end") - F.col("start")).otherwise(F.col("rlen"))).withColumn("crc", F.when(copy, F.lit(None)).otherwise(F.col("crc"))).withColumn("chunk_id", F.col("dst"))


def compress(files: DataFrame, root: str, options: Options = Options(), label: str | None = None) -> None:
    """Writes files (archive, path, content) as archives below a root, which must not hold any yet.

    The three tables are written beside the root and moved there in one step
    when all are whole; if anything fails, nothing is left. A label is kept
    as by ``append``.
    """
    spark = files.sparkSession
    fs, top = hadoop_path(spark, root)
    if fs.exists(top) and len(fs.listStatus(top)):
        raise FileExistsError(root)
    beside = f"{root.rstrip('/')}.part-{uuid.uuid4().hex}"
    part = hadoop_path(spark, beside)[1]
    try:
        members, tensors, planned = plan(files, options)
        for name, df in (("members", members), ("tensors", tensors), ("chunks", encode(files, members, planned, options))):
            df.withColumn("batch", F.lit(None).cast("string")).write.partitionBy("archive").parquet(f"{beside}/{name}")
        if label is not None:
            _commit(beside, spark, label, uuid.uuid4().hex)
        # only an empty folder goes; a rename onto a folder would move into it
        if fs.exists(top):
            fs.delete(top, False)
        if not fs.rename(part, top):
            raise FileExistsError(root)
    finally:
        fs.delete(part, True)


def append(files: DataFrame, root: str, options: Options = Options(), label: str = "") -> None:
    """Adds files to archives below a root, coded against what these hold where that is clearly smaller.

    A path that is there already fails before anything is written. What is
    written is seen by readers all at once, when its marker is set; rows of an
    append that failed are never seen. Files with a label that was appended
    already are passed over, so that an append may be repeated. One writer at a time.
    """
    spark = files.sparkSession
    if label and _committed(root, spark, label):
        return
    if not catalog.clashing(stored(root, "members", spark), files.select(*KEYS), KEYS).isEmpty():
        raise ValueError("members are there already")
    members, tensors, planned = plan(files, options, root)
    batch = uuid.uuid4().hex
    for name, df in (("members", members), ("tensors", tensors), ("chunks", encode(files, members, planned, options, root))):
        df.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("archive").parquet(f"{root}/{name}")
    _commit(root, spark, label, batch)


def decoded(chunks: DataFrame, options: Options = Options(), verify: bool = True) -> DataFrame:
    """Chunks with their bytes in ``data``; copies and differences take theirs from chunks that have their own."""
    keys = ["archive"]
    own = codecs.decode_chunks(chunks.where(~F.col("codec").isin(c.C_REF, c.C_DELTA)), options.settings.buckets, verify)
    need = chunks.where(F.col("codec").isin(c.C_REF, c.C_DELTA))
    sources = reads.resolve_sources(chunks.select("archive", "chunk_id", "dst", "rlen", "codec", "src"), keys, c.C_REF, c.C_DELTA, options.chunk_size)
    rest = codecs.decode_chunks(_with_sources(need, sources, own), options.settings.buckets, verify, base="base", copied="copied")
    return own.unionByName(rest.select(*own.columns))


def _with_sources(need: DataFrame, sources: DataFrame, own: DataFrame) -> DataFrame:
    """Copies and differences with their source bytes in ``base`` and ``copied``."""
    parts = sources.join(own.select("archive", F.col("chunk_id").alias("source_chunk"), "data"), ["archive", "source_chunk"], "left")
    chain = F.raise_error(F.lit("a copy or difference points at another one")).cast("binary")
    piece = F.when(F.col("source_codec").isin(c.C_REF, c.C_DELTA), chain).otherwise(F.substring("data", (F.col("begin") + 1).cast("int"), (F.col("stop") - F.col("begin")).cast("int")))
    parts = parts.select("archive", "for_chunk", "at", piece.alias("piece"))
    joined = parts.groupBy("archive", F.col("for_chunk").alias("chunk_id")).agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"))
    base = joined.select("archive", "chunk_id", F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["piece"])).alias("base"))
    return need.join(base, ["archive", "chunk_id"], "left").withColumn("copied", F.col("base"))


def _decoded_for(requests: DataFrame, chunks: DataFrame, options: Options) -> DataFrame:
    """The chunks that requests (archive, pos, len) touch, with their bytes; no others are read beyond their places."""
    places = chunks.select("archive", "chunk_id", "dst", "rlen", "codec", "src")
    ids = kept(reads.touched(requests, places, ["archive"], c.C_REF, c.C_DELTA, options.chunk_size))
    return decoded(chunks.join(ids, ["archive", "chunk_id"], "left_semi"), options)


def faults(root: str, spark: SparkSession, options: Options = Options()) -> DataFrame:
    """(archive, what, at): all that is wrong with archives below a root; empty if they are whole."""
    members, chunks = stored(root, "members", spark), stored(root, "chunks", spark)
    total = members.groupBy("archive").agg(F.sum("size").alias("total"))
    gaps = planning.coverage_faults(chunks, total, ["archive"]).select("archive", F.lit("gap or overlap").alias("what"), F.col("dst").alias("at"))
    sources = reads.resolve_sources(chunks.select("archive", "chunk_id", "dst", "rlen", "codec", "src"), ["archive"], c.C_REF, c.C_DELTA, options.chunk_size)
    chain = reads.chained(sources, c.C_REF, c.C_DELTA).select("archive", F.lit("source is no source").alias("what"), F.col("for_chunk").alias("at"))
    lost = reads.unresolved(chunks, sources, ["archive"], c.C_REF, c.C_DELTA).select("archive", F.lit("missing source").alias("what"), F.col("chunk_id").alias("at"))
    own = codecs.try_decode(chunks.where(~F.col("codec").isin(c.C_REF, c.C_DELTA)), options.settings.buckets)
    bad = own.where("error IS NOT NULL").select("archive", F.col("error").alias("what"), F.col("dst").alias("at"))
    # copies and differences are decoded too, but for those that are reported for their sources' places
    named = lost.unionByName(chain).select("archive", F.col("at").alias("chunk_id")).distinct()
    need = chunks.where(F.col("codec").isin(c.C_REF, c.C_DELTA)).join(named, ["archive", "chunk_id"], "left_anti")
    plain = sources.where(~F.col("source_codec").isin(c.C_REF, c.C_DELTA))
    rest = codecs.try_decode(_with_sources(need, plain, own), options.settings.buckets, base="base", copied="copied")
    more = rest.where("error IS NOT NULL").select("archive", F.col("error").alias("what"), F.col("dst").alias("at"))
    return gaps.unionByName(lost).unionByName(chain).unionByName(bad).unionByName(more)


def _member_parts(root: str, spark: SparkSession, archive: str | None, path: str | None, options: Options) -> tuple[DataFrame, DataFrame]:
    """The members (archive, path, size) of a name, or all, and their decoded chunks."""
    members, chunks = stored(root, "members", spark), stored(root, "chunks", spark)
    for name, value in (("archive", archive), ("path", path)):
        members = members if value is None else members.where(F.col(name) == value)
    wanted = members.select(*KEYS, "size")
    if archive is None and path is None:
        return wanted, decoded(chunks, options)
    asked = members.where("size > 0").select("archive", F.col("dst").alias("pos"), F.col("size").alias("len"))
    return wanted, _decoded_for(asked, chunks, options).join(wanted.select(*KEYS), KEYS, "left_semi")


def restore(root: str, spark: SparkSession, path: str | None = None, options: Options = Options()) -> DataFrame:
    """(archive, path, content): the files of archives below a root, or those of one path. Empty files have no chunks."""
    wanted, whole = _member_parts(root, spark, None, path, options)
    parts = whole.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("start", "data"))).alias("p"))
    content = F.aggregate(F.coalesce("p", F.array().cast("array<struct<start:bigint,data:binary>>")), F.unhex(F.lit("")), lambda a, x: F.concat(a, x["data"]))
    return wanted.join(parts, KEYS, "left").select(*KEYS, content.alias("content"))


class _FileWriter:
    """Writes one file after the other; a file has its name only when it is whole."""

    def __init__(self, place: str) -> None:
        self.store, self.top = open_store(place)
        self.name, self.out = None, None

    def begin(self, name: str, size: int) -> None:
        self.name, self.size, self.at = name, size, 0
        folder, _, base = f"{self.top}/{name}".rpartition("/")
        self.store.create_dir(folder, recursive=True)
        self.part = f"{folder}/.{base}.part-{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.part, compression=None)

    def add(self, start: int, data: pa.Buffer) -> None:
        if start != self.at:
            raise ValueError(f"{self.name}: bytes {self.at} to {start} are missing")
        self.out.write(data)
        self.at += data.size

    def end(self) -> None:
        self.out.close()
        if self.at != self.size:
            raise ValueError(f"{self.name}: {self.at} of {self.size} bytes")
        self.store.move(self.part, f"{self.top}/{self.name}")
        self.out = None

    def give_up(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.delete_file(self.part)


def extract(root: str, dest: str, spark: SparkSession, archive: str | None = None, path: str | None = None, options: Options = Options()) -> DataFrame:
    """Writes the files of archives below a root, or those of one archive or path, and returns (archive, path, size) of them.

    ``dest`` is a folder that all executors share. Files of one named archive
    lie right below it, others below the name of theirs. Each file is written
    by one task, chunk by chunk in order, so it may be of any size; it takes
    its name, and replaces a file of that name, when it is whole. Members that
    are asked for and not there raise KeyError.
    """
    wanted, whole = _member_parts(root, spark, archive, path, options)
    if wanted.isEmpty() and not (archive is None and path is None):
        raise KeyError(path if archive is None else archive if path is None else f"{archive}/{path}")
    place = dest if ":/" in dest else os.path.abspath(dest)
    name = F.col("path") if archive is not None else F.concat_ws("/", *KEYS)
    safe = F.when(safe_path(name), name).otherwise(F.raise_error(F.concat(F.lit("unsafe path: "), name)))
    rows = wanted.join(whole.select(*KEYS, "start", "data"), KEYS, "left").select(*KEYS, "size", safe.alias("name"), "start", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = _FileWriter(place), None
        schema = pa.schema([("archive", pa.string()), ("path", pa.string()), ("size", pa.int64())])
        try:
            for b in batches:
                for r in range(b.num_rows):
                    archive, path, size, name, start, data = (b.column(i)[r] for i in range(6))
                    if name.as_py() != writer.name:
                        if done:
                            writer.end()
                            yield pa.RecordBatch.from_pylist([done], schema)
                        writer.begin(name.as_py(), size.as_py())
                        done = {"archive": archive.as_py(), "path": path.as_py(), "size": size.as_py()}
                    if start.is_valid:
                        writer.add(start.as_py(), data.as_buffer())
            if done:
                writer.end()
                yield pa.RecordBatch.from_pylist([done], schema)
        finally:
            writer.give_up()

    return kept(rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "start").mapInArrow(run, "archive string, path string, size bigint"))


def read_tensor(root: str, spark: SparkSession, name: str, options: Options = Options()) -> DataFrame:
    """(archive, path, name, dtype, shape, bytes) of the tensors of a name; KeyError if there is none."""
    members, tensors = stored(root, "members", spark), stored(root, "tensors", spark).where(F.col("name") == name)
    if tensors.isEmpty():
        raise KeyError(name)
    asked = tensors.join(members.select(*KEYS, "dst"), KEYS).withColumn("pos", F.col("dst") + F.col("start")).withColumn("len", F.col("end") - F.col("start")).drop("dst", "start", "end")
    chunks = _decoded_for(asked, stored(root, "chunks", spark), options).select("archive", "dst", "rlen", "data")
    ask = ["archive", "path", "name"]
    got = reads.read_ranges(asked.select(*ask, "pos", "len"), chunks, ["archive"], ask, options.chunk_size)
    return asked.select(*ask, "dtype", "shape").join(got, ask)


def info(root: str, spark: SparkSession) -> DataFrame:
    return codecs.codec_table(stored(root, "chunks", spark), ["archive"])
