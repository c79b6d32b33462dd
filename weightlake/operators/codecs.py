"""Encoding and decoding of chunk rows, a piece of a batch at a time."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec as c
from ..functions import kernels as k
from ..functions.batches import by_pieces
from ..functions.tables import DELTA, REF

STREAMS = "array<struct<method:int,raw:bigint,payload:binary,other:bigint>>"
_STREAM = pa.struct([("method", pa.int32()), ("raw", pa.int64()), ("payload", pa.binary()), ("other", pa.int64())])


def _rows(e: c.Encoded) -> list[dict]:
    return [{"method": m, "raw": n, "payload": p, "other": o} for m, n, p, o in e.streams]


def encode_chunks(chunks: DataFrame, settings: c.Settings = c.Settings(), data: str = "data", base: str | None = None) -> DataFrame:
    """Rows with data, esize, kind, btype and ikind get rlen, clen, crc, codec, inner_codec, layout and streams; data goes.

    A copy (kind REF) keeps no bytes. A difference (kind DELTA) is coded
    against the bytes of column ``base``, and its crc is that of the data.
    """
    keep = [x for x in chunks.columns if x not in (data, base)]
    names = [*keep, "rlen", "clen", "crc", "codec", "inner_codec", "layout", "streams"]

    def code(b: pa.RecordBatch) -> pa.RecordBatch:
        get = lambda x: b.column(b.schema.get_field_index(x)).to_pylist()
        out: list[list] = [[] for _ in range(7)]
        bases = get(base) if base else [None] * b.num_rows
        rows = [(raw or b"", *rest) for raw, *rest in zip(get(data), get("esize"), get("kind"), get("btype"), get("ikind"), bases)]
        work = [i for i, r in enumerate(rows) if r[2] != REF]
        jobs = [c.encode_steps(k.xor(raw, other), esize, ikind, btype, settings) if kind == DELTA else c.encode_steps(raw, esize, kind, btype, settings) for raw, esize, kind, btype, ikind, other in (rows[i] for i in work)]
        done = dict(zip(work, c.together(jobs)))
        for i, (raw, _, kind, *_) in enumerate(rows):
            e = done.get(i, c.Encoded(c.C_REF, []))
            codec, inner = (c.C_DELTA, e.codec) if kind == DELTA else (e.codec, None)
            row = (len(raw), sum(len(p) for _, _, p, _ in e.streams), zlib.crc32(raw), codec, inner, e.layout, _rows(e))
            for column, x in zip(out, row):
                column.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(_STREAM)]
        return pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(x)) for x in keep] + [pa.array(x, t) for x, t in zip(out, kinds)], names=names)

    schema = T.StructType([chunks.schema[x] for x in keep] + T._parse_datatype_string(f"rlen bigint, clen bigint, crc bigint, codec int, inner_codec int, layout array<int>, streams {STREAMS}").fields)
    return chunks.mapInArrow(by_pieces(code), schema)


def decode_chunks(chunks: DataFrame, buckets: int = 8, verify: bool = True, base: str | None = None, copied: str | None = None, into: str = "data") -> DataFrame:
    """Adds the decoded bytes; copies take them from column ``copied``, differences are applied to ``base``. Damaged rows fail the query."""
    decoded = try_decode(chunks, buckets, verify, base, copied, into)
    return decoded.withColumn(into, F.when(F.col("error").isNull(), F.col(into)).otherwise(F.raise_error(F.concat(F.lit("corrupt chunk: "), F.col("error"))))).drop("error")


def try_decode(chunks: DataFrame, buckets: int = 8, verify: bool = True, base: str | None = None, copied: str | None = None, into: str = "data") -> DataFrame:
    """As ``decode_chunks``, with what is wrong with a row in ``error`` instead of failing."""
    names = [x for x in chunks.columns if x not in (base, copied)]

    def code(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = b.to_pylist()
        out, errors = [], []
        # a copy has no streams
        streams = [(s["method"], s["raw"], s["payload"]) for r in rows for s in r["streams"] or ()]
        parts = iter(c.decompress_many(streams))
        for r in rows:
            own = [next(parts) for _ in r["streams"] or ()]
            raw, error = None, None
            try:
                if r["codec"] == c.C_REF:
                    raw = r[copied] if copied else None
                    if raw is None or len(raw) != r["rlen"]:
                        raise c.CorruptChunk("a copy's source is missing")
                else:
                    codec = r["inner_codec"] if r["codec"] == c.C_DELTA else r["codec"]
                    if r["codec"] == c.C_DELTA and codec in (None, c.C_REF, c.C_DELTA):
                        raise c.CorruptChunk("a difference must have bytes of its own")
                    for x in own:
                        if isinstance(x, c.CorruptChunk):
                            raise x
                    raw = c.assemble(codec, own, r["layout"], r["rlen"], buckets)
                    if r["codec"] == c.C_DELTA:
                        if not base or r[base] is None:
                            raise c.CorruptChunk("a difference's source is missing")
                        raw = k.xor(raw, r[base])
                if verify and r["crc"] is not None and zlib.crc32(raw) != r["crc"]:
                    raise c.CorruptChunk("checksum differs")
            except ValueError as e:
                raw, error = None, str(e) or type(e).__name__
            out.append(raw)
            errors.append(error)
        return pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(x)) for x in names] + [pa.array(out, pa.binary()), pa.array(errors, pa.string())], names=[*names, into, "error"])

    schema = T.StructType([chunks.schema[x] for x in names] + [T.StructField(into, T.BinaryType()), T.StructField("error", T.StringType())])
    return chunks.mapInArrow(by_pieces(code, raw="rlen"), schema)


def method_tally(encoded: DataFrame, keys: list[str]) -> DataFrame:
    """Streams by method: how many, raw and coded bytes, and the streams that another method was tried on."""
    s = encoded.select(*keys, F.explode("streams").alias("s")).where("s.raw > 0")
    names = F.create_map(*[F.lit(x) for i, n in enumerate(c.METHOD_NAMES) for x in (i, n)])
    coded, tried = F.octet_length("s.payload").cast("long"), F.col("s.other") >= 0
    return s.groupBy(*keys, names[F.col("s.method")].alias("method")).agg(
        F.count("*").alias("streams"),
        F.sum("s.raw").alias("raw"),
        F.sum(coded).alias("coded"),
        F.count(F.when(tried, 1)).alias("contested"),
        F.coalesce(F.sum(F.when(tried, coded)), F.lit(0)).alias("contested_coded"),
        F.coalesce(F.sum(F.when(tried, F.col("s.other"))), F.lit(0)).alias("contested_alt"),
    )


def merge_tallies(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    sums = [x for x in a.columns if x not in keys]
    return a.unionByName(b, allowMissingColumns=True).groupBy(*keys).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in sums])


def ordered_tally(tally: DataFrame, keys: list[str]) -> DataFrame:
    """A tally as it is shown: the methods of each key by raw bytes, most first."""
    return tally.orderBy(*keys, F.desc("raw"), "method")


def codec_table(encoded: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks, raw bytes and stored bytes by codec, in the order of names."""
    names = F.create_map(*[F.lit(x) for i, n in enumerate(c.CODEC_NAMES) for x in (i, n)])
    return encoded.groupBy(*keys, names[F.col("codec")].alias("codec")).agg(F.count("*").alias("chunks"), F.sum("rlen").alias("raw"), F.sum("clen").alias("stored")).orderBy(*keys, "codec")
