"""The registered queries of the archive operators, bound to the sample tables, and SQL for each that SQL can express.

Documents stand for files (bytes of ``text``, in the order of ``doc_id``),
embeddings and line items for tensors, events for readers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codec as c
from .functions import scalars as s
from .functions.batches import by_pieces
from .functions.kernels import FREQUENCY_BYTES, SCALE
from .functions.tables import BF16, BYTES, DELTA, DTYPE_WIDTH, REF
from .operators import catalog, codecs, dedup, planning, reads, stats
from .plans.session import share, table
from .streaming.reads import sequential_runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CHUNK = 1 << 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", "lang", F.col("text").cast("binary").alias("data"), F.octet_length("text").cast("long").alias("size"))


# SQL fragments: bytes of documents, and rows of (doc_id, position, byte)
_MEMBERS = "members AS (SELECT doc_id, source, lang, text, octet_length(encode(text))::BIGINT AS size FROM documents)"
_DST = _MEMBERS + ", placed AS (SELECT *, (sum(size) OVER (ORDER BY doc_id) - size)::BIGINT AS dst FROM members)"
_CHUNKS = _DST + f""", chunks AS (SELECT doc_id, source, dst + k * {CHUNK} AS dst, least({CHUNK}, size - k * {CHUNK})::BIGINT AS rlen, k, text
  FROM placed, LATERAL (SELECT unnest(range((size + {CHUNK} - 1) // {CHUNK})) AS k))"""
_BYTES = "bytes AS (SELECT {keys}, ('0x' || unnest(regexp_extract_all({hex}, '..')))::INT AS byte FROM {table})"


def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut into chunks with their bytes."""
    placed = planning.member_offsets(docs(spark, sf), ["doc_id"])
    whole = planning.plain(placed.select("doc_id", "source", "data", "dst", F.lit(0).cast("long").alias("start"), F.col("size").alias("end")))
    pieces = planning.slice_regions(whole, CHUNK)
    return pieces.select("doc_id", "source", (F.col("dst") + F.col("start")).alias("dst"), (F.col("end") - F.col("start")).alias("rlen"), F.substring("data", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("data"))


@query(f"""WITH {_CHUNKS}, hexed AS (SELECT source, dst, substr(hex(encode(text)), (1 + 2 * k * {CHUNK})::BIGINT, 2 * rlen) AS h, rlen FROM chunks),
{_BYTES.format(keys="source, dst, rlen", hex="h", table="hexed")},
counts AS (SELECT source, dst, rlen, byte, count(*) AS cnt FROM bytes GROUP BY ALL),
bits AS (SELECT source, dst, rlen, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS b FROM counts GROUP BY ALL),
gated AS (SELECT *, CASE WHEN b >= 7.98 THEN 'noise' WHEN least(rlen, floor(rlen * b / 8) + 548) + greatest(1024, rlen >> 8) >= rlen THEN 'no gain' ELSE 'coded' END AS verdict FROM bits)
SELECT source, verdict, count(*)::BIGINT AS chunks, sum(rlen)::BIGINT AS raw, round(avg(b), 6) AS mean_bits FROM gated GROUP BY ALL""")
def chunk_report(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets, chunks, histograms, entropy and the coding gate, by source."""
    chunks = doc_chunks(spark, sf)
    found = stats.entropy(stats.byte_counts(chunks, ["source", "dst"], "data"), ["source", "dst"])
    found = found.withColumn("verdict", stats.gate(F.col("total"), F.col("bits")))
    return found.groupBy("source", "verdict").agg(F.count("*").alias("chunks"), F.sum("total").alias("raw"), F.round(F.avg("bits"), 6).alias("mean_bits"))


@query(f"WITH {_DST} SELECT doc_id, size, dst FROM placed")
def member_dst(spark, sf):
    return planning.member_offsets(docs(spark, sf).drop("data"), ["doc_id"]).select("doc_id", "size", "dst")


@query(f"WITH {_CHUNKS} SELECT doc_id, dst, rlen FROM chunks")
def chunk_plan(spark, sf):
    return doc_chunks(spark, sf).select("doc_id", "dst", "rlen")


@query("""WITH m AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS size, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 8 ELSE 6 END AS e FROM documents),
s AS (SELECT *, greatest(1000 - 1000 % e, e) AS step FROM m), p AS (SELECT doc_id, e, size, k * step AS a, least((k + 1) * step, size) AS b FROM s, LATERAL (SELECT unnest(range((size + step - 1) // step)) AS k))
SELECT doc_id, a::BIGINT AS "start", b::BIGINT AS "end", (CASE WHEN (b - a) % e <> 0 THEN 1 ELSE e END)::INT AS esize FROM p""")
def chunk_plan_aligned(spark, sf):
    """Chunks of whole elements; the ragged last piece is single bytes."""
    width = F.when(F.col("doc_id") % 3 == 0, 2).when(F.col("doc_id") % 3 == 1, 8).otherwise(6)
    whole = docs(spark, sf).select("doc_id", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"), width.alias("esize"))
    return planning.slice_regions(planning.plain(whole), 1000).select("doc_id", "start", "end", "esize")


@query(f"""WITH {_CHUNKS}, given AS (SELECT doc_id % 7 AS archive, dst, rlen FROM chunks WHERE doc_id % 7 <> 3), placed2 AS (SELECT *, coalesce(sum(rlen) OVER (PARTITION BY archive ORDER BY dst, rlen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS expected FROM given)
SELECT archive, dst, expected::BIGINT AS expected FROM placed2 WHERE dst <> expected UNION ALL
SELECT archive, 0::BIGINT, sum(rlen)::BIGINT FROM given GROUP BY archive HAVING sum(rlen) <> 0""")
def coverage_check(spark, sf):
    """Where the chunks of every seventh document leave gaps; the totals given are wrong on purpose."""
    some = doc_chunks(spark, sf).where("doc_id % 7 <> 3").select((F.col("doc_id") % 7).alias("archive"), "dst", "rlen")
    return planning.coverage_faults(some, some.select("archive").distinct().withColumn("total", F.lit(0).cast("long")), ["archive"])


# regions: parts of each conversation's text, by turn
_REGIONS = """r AS (SELECT conv_id, turn, (turn * 100)::BIGINT AS "start", (turn * 100 + least(length(text), CASE WHEN conv_id % 5 = 0 THEN 130 ELSE 100 END))::BIGINT AS "end", (CASE WHEN role = 'user' THEN 2 ELSE 4 END)::INT AS esize FROM (SELECT DISTINCT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL)),
m AS (SELECT conv_id, max("end") + 50 AS size FROM r GROUP BY 1)"""


def regions(spark, sf) -> DataFrame:
    t = table(spark, sf, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL").distinct()
    longest = F.when(F.col("conv_id") % 5 == 0, 130).otherwise(100)
    start = (F.col("turn") * 100).cast("long")
    return t.select("conv_id", start.alias("start"), (start + F.least(F.char_length("text"), longest)).cast("long").alias("end"), F.when(F.col("role") == "user", 2).otherwise(4).alias("esize"))


def region_members(r: DataFrame) -> DataFrame:
    return r.groupBy("conv_id").agg((F.max("end") + 50).alias("size"))


@query(f"""WITH {_REGIONS}, w AS (SELECT *, max("end") OVER (PARTITION BY conv_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r) SELECT DISTINCT conv_id FROM w WHERE "start" < seen""")
def region_overlap(spark, sf):
    return planning.overlapping(regions(spark, sf), ["conv_id"])


@query(f"""WITH {_REGIONS}, e AS (SELECT conv_id, "start", "end", esize, 0 AS last FROM r UNION ALL SELECT conv_id, size, size, 1, 1 FROM m),
w AS (SELECT *, coalesce(max("end") OVER (PARTITION BY conv_id ORDER BY "start", last, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e)
SELECT conv_id, "start", "end", esize FROM e WHERE last = 0 UNION ALL SELECT conv_id, b::BIGINT, "start", 1 FROM w WHERE "start" > b""")
def region_gap_fill(spark, sf):
    r = regions(spark, sf)
    return planning.fill_gaps(r, region_members(r), ["conv_id"]).select("conv_id", "start", "end", "esize")


@query("""WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderpriority FROM orders WHERE o_custkey IS NOT NULL),
g AS (SELECT *, ascii(o_orderpriority) % 2 AS kind FROM r), w AS (SELECT *, CASE WHEN lag(kind) OVER p = kind THEN 0 ELSE 1 END AS new FROM g WINDOW p AS (PARTITION BY o_custkey ORDER BY n)),
i AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY n) AS island FROM w)
SELECT o_custkey, (min(n) * 10 - 10)::BIGINT AS "start", (max(n) * 10)::BIGINT AS "end", min(kind)::INT AS kind FROM i GROUP BY o_custkey, island""")
def region_coalesce(spark, sf):
    """A customer's orders as neighbouring regions of ten bytes; neighbours of one kind join."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    r = table(spark, sf, "orders").where("o_custkey IS NOT NULL").withColumn("n", F.row_number().over(w).cast("long"))
    r = r.select("o_custkey", (F.col("n") * 10 - 10).alias("start"), (F.col("n") * 10).alias("end"), (F.ascii("o_orderpriority") % 2).cast("int").alias("kind"))
    return planning.coalesce_regions(planning.plain(r), ["o_custkey"]).select("o_custkey", "start", "end", "kind")


_CARVE = """d AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS size FROM documents WHERE octet_length(encode(text)) >= 400),
r AS (SELECT doc_id, 0::BIGINT AS a, 300::BIGINT AS b, 2 AS esize FROM d UNION ALL SELECT doc_id, 300, size, 4 FROM d),
c AS (SELECT doc_id, 100::BIGINT AS s, 200::BIGINT AS e, 1000::BIGINT AS src FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 250, 350, 5000 FROM d WHERE doc_id % 2 = 0 UNION ALL
      SELECT doc_id, 0, 100, 7 FROM d WHERE doc_id % 5 = 1 UNION ALL SELECT doc_id, 50, 80, 7 FROM d WHERE doc_id % 10 = 1),
good AS (SELECT * FROM c WHERE doc_id % 10 <> 1),
pts AS (SELECT doc_id, a, b, esize, unnest(list_distinct([a, b] || coalesce((SELECT list(greatest(s, a)) FROM good WHERE good.doc_id = r.doc_id AND s < b AND e > a), []) || coalesce((SELECT list(least(e, b)) FROM good WHERE good.doc_id = r.doc_id AND s < b AND e > a), []))) AS p FROM r),
seg AS (SELECT doc_id, esize, p AS a, lead(p) OVER (PARTITION BY doc_id, esize ORDER BY p) AS b FROM pts),
cut AS (SELECT seg.*, good.s, good.src FROM seg LEFT JOIN good ON good.doc_id = seg.doc_id AND good.s <= seg.a AND good.e >= seg.b WHERE seg.b IS NOT NULL)"""


def carving(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = docs(spark, sf).where("size >= 400").select("doc_id", "size")
    part = lambda a, b, e: d.select("doc_id", F.lit(a).cast("long").alias("start"), (F.lit(b) if isinstance(b, int) else F.col(b)).cast("long").alias("end"), F.lit(e).alias("esize"))
    cut = lambda when, a, b, src: d.where(when).select("doc_id", F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(src).cast("long").alias("src"))
    cuts = cut("doc_id % 2 = 0", 100, 200, 1000).unionByName(cut("doc_id % 2 = 0", 250, 350, 5000)).unionByName(cut("doc_id % 5 = 1", 0, 100, 7)).unionByName(cut("doc_id % 10 = 1", 50, 80, 7))
    return part(0, 300, 2).unionByName(part(300, "size", 4)), cuts, d


@query(f"""WITH {_CARVE} SELECT doc_id, a AS "start", b AS "end", esize::INT AS esize, 0::INT AS kind, (-1)::BIGINT AS src FROM cut WHERE s IS NULL UNION ALL SELECT doc_id, s, e, 1, {REF}, src FROM good""")
def carve_refs(spark, sf):
    """Copies cut out of regions; a document with overlapping copies keeps its regions."""
    r, cuts, d = carving(spark, sf)
    return planning.carve_refs(r, cuts, d, ["doc_id"]).select("doc_id", "start", "end", "esize", "kind", "src")


@query(f"""WITH {_CARVE} SELECT doc_id, a AS "start", b AS "end", esize::INT AS esize, (CASE WHEN s IS NULL THEN 0 ELSE {DELTA} END)::INT AS kind, (CASE WHEN s IS NULL THEN -1 ELSE src + a - s END)::BIGINT AS src FROM cut""")
def carve_deltas(spark, sf):
    r, cuts, d = carving(spark, sf)
    return planning.carve_deltas(r, cuts, d, ["doc_id"]).select("doc_id", "start", "end", "esize", "kind", "src")


_SOURCE_BYTES = f"WITH {_MEMBERS}, " + _BYTES.format(keys="source", hex="hex(encode(text))", table="members") + ", counts AS (SELECT source, byte, count(*)::BIGINT AS cnt FROM bytes GROUP BY ALL)"


def source_counts(spark, sf) -> DataFrame:
    return stats.byte_counts(docs(spark, sf), ["source"], "data")


@query(_SOURCE_BYTES + " SELECT * FROM counts")
def byte_histogram(spark, sf):
    return source_counts(spark, sf)


@query(_SOURCE_BYTES + " SELECT source, sum(cnt)::BIGINT AS total, round(log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt), 6) AS bits, count(*)::BIGINT AS n_symbols FROM counts GROUP BY source")
def entropy_by_source(spark, sf):
    counts = source_counts(spark, sf)
    return stats.entropy(counts, ["source"]).withColumn("bits", F.round("bits", 6)).join(counts.groupBy("source").agg(F.count("*").alias("n_symbols")), "source")


@query(f"""WITH {_MEMBERS}, h AS (SELECT doc_id, size, hex(encode(text)) AS x, (size - 256) // 2 AS mid FROM members WHERE size > 0),
w AS (SELECT doc_id, size, CASE WHEN size <= 768 THEN x ELSE substr(x, 1, 512) || substr(x, 1 + 2 * mid, 512) || substr(x, 1 + 2 * (size - 256), 512) END AS x FROM h),
b AS (SELECT doc_id, size, unnest(regexp_extract_all(x, '..')) AS y FROM w), n AS (SELECT doc_id, size, y, count(*) AS c FROM b GROUP BY ALL),
e AS (SELECT doc_id, size, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS bits FROM n GROUP BY ALL)
SELECT doc_id, round(bits, 6) AS bits, bits >= 4.3 AS noise FROM e""")
def entropy_sampled(spark, sf):
    """Entropy of three windows of 256 bytes, and the noise gate at a bound that text can reach."""
    part = docs(spark, sf).select("doc_id", s.windows_of(F.col("data"), F.col("size"), 256).alias("data"))
    found = stats.entropy(stats.byte_counts(part, ["doc_id"], "data"), ["doc_id"])
    return found.select("doc_id", F.round("bits", 6).alias("bits"), (F.col("bits") >= 4.3).alias("noise"))


@query(_SOURCE_BYTES + """, e AS (SELECT source, sum(cnt)::BIGINT AS total, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS bits FROM counts GROUP BY source)
SELECT source, total, least(total, floor(total * bits / 8)::BIGINT + 548)::BIGINT AS estimate, greatest(1024, total >> 8)::BIGINT AS least_gain FROM e""")
def est_stream_cost(spark, sf):
    e = stats.entropy(source_counts(spark, sf), ["source"])
    return e.select("source", "total", stats.stream_estimate(F.col("total"), F.col("bits")).alias("estimate"), stats.min_gain(F.col("total")).alias("least_gain"))


@query(_SOURCE_BYTES + f""", scaled AS (SELECT *, greatest(cnt * {SCALE} // (sum(cnt) OVER (PARTITION BY source))::BIGINT, 1) AS f FROM counts),
spare AS (SELECT *, {SCALE} - (sum(f) OVER (PARTITION BY source))::BIGINT AS spare FROM scaled),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN spare >= 0 THEN cnt ELSE f END DESC, byte) AS k FROM spare),
given AS (SELECT source, byte, cnt, (f + CASE WHEN k = 1 THEN spare ELSE 0 END)::BIGINT AS freq FROM ranked),
costs AS (SELECT source, {FREQUENCY_BYTES} + floor(-sum(cnt * log2(freq / {SCALE}.0)) / 8)::BIGINT AS cost FROM given GROUP BY source)
SELECT source, byte, cnt, freq, cost FROM given JOIN costs USING (source)""")
def code_frequencies(spark, sf):
    return stats.code_frequencies(source_counts(spark, sf), ["source"])


@query(_SOURCE_BYTES + """, w AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY source ORDER BY byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(cnt) OVER (PARTITION BY source) AS t FROM counts)
SELECT source, byte, cnt, least(7, (b * 8) // t)::INT AS bucket FROM w""")
def equal_mass_buckets(spark, sf):
    return stats.mass_buckets(source_counts(spark, sf), ["source"], 8)


@query(_SOURCE_BYTES + """, w AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY source ORDER BY byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(cnt) OVER (PARTITION BY source) AS t FROM counts)
SELECT source, least(7, (b * 8) // t)::INT AS bucket, sum(cnt)::BIGINT AS cnt FROM w GROUP BY ALL""")
def bucket_counts(spark, sf):
    return stats.bucket_counts(stats.mass_buckets(source_counts(spark, sf), ["source"], 8), ["source"])


_LINE_BUCKETS = """p AS (SELECT l_orderkey, l_linenumber, l_suppkey % 5 AS grp, (l_quantity)::INT AS ctx FROM lineitem),
c AS (SELECT grp, ctx, count(*) AS cnt FROM p GROUP BY ALL), w AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY grp ORDER BY ctx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(cnt) OVER (PARTITION BY grp) AS t FROM c),
lut AS (SELECT grp, ctx, least(3, (b * 4) // t)::INT AS bucket FROM w)"""


@query(f"""WITH {_LINE_BUCKETS} SELECT l_orderkey, l_linenumber, bucket, (row_number() OVER (PARTITION BY p.grp, bucket ORDER BY l_orderkey, l_linenumber) - 1)::BIGINT AS place FROM p JOIN lut USING (grp, ctx)""")
def bucket_partition(spark, sf):
    """Line items dealt by buckets of their quantity, in order within each."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 5).alias("grp"), F.col("l_quantity").cast("int").alias("ctx"))
    counts = rows.groupBy("grp", F.col("ctx").alias("byte")).agg(F.count("*").alias("cnt"))
    placed = stats.place_in_bucket(rows, stats.mass_buckets(counts, ["grp"], 4), ["grp"], "ctx", ["l_orderkey", "l_linenumber"])
    return placed.select("l_orderkey", "l_linenumber", "bucket", F.col("place").cast("long").alias("place"))


@query("SELECT k AS plane, ((l_partkey >> (8 * k)) & 255)::INT AS byte, count(*)::BIGINT AS cnt FROM lineitem, (SELECT unnest(range(8)) AS k) GROUP BY ALL")
def int_byte_planes(spark, sf):
    planes = F.array(*[F.struct(F.lit(k).cast("long").alias("plane"), s.byte_plane(F.col("l_partkey"), k).alias("byte")) for k in range(8)])
    return table(spark, sf, "lineitem").select(F.explode(planes).alias("p")).groupBy("p.plane", "p.byte").agg(F.count("*").alias("cnt"))


@query("SELECT l_orderkey, l_linenumber, l_partkey AS merged FROM lineitem")
def planes_round_trip(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", s.join_planes([s.byte_plane(F.col("l_partkey"), k) for k in range(8)]).alias("merged"))


@query("WITH c AS (SELECT k AS plane, bool_and(((l_partkey >> (8 * k)) & 255) = 0) AS zero FROM lineitem, (SELECT unnest(range(8)) AS k) GROUP BY k) SELECT plane, zero FROM c")
def zero_planes(spark, sf):
    counts = int_byte_planes(spark, sf)
    return counts.groupBy("plane").agg((F.max("byte") == 0).alias("zero"))


# the upper half of a FLOAT's bits, as a bfloat16 word
_WORDS = "x AS (SELECT vec_id, label, unnest(embedding) AS v FROM embeddings), words AS (SELECT vec_id, label, (('0b' || left(v::FLOAT::BIT::VARCHAR, 16))::INT) AS word FROM x WHERE v IS NOT NULL)"


def words(spark, sf) -> DataFrame:
    """bfloat16 words of the embeddings, by numpy's view of the bits."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten()
            at = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(lists).fill_null(0).to_numpy())
            ok = flat.is_valid()
            at, values = at[ok.to_numpy(zero_copy_only=False)], flat.drop_null().to_numpy().astype("<f4")
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array((values.view("<u4") >> 16).astype(np.int32))], names=["vec_id", "label", "word"])

    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<float>").alias("e")).mapInArrow(run, "vec_id bigint, label int, word int")


@query(f"WITH {_WORDS} SELECT label, ((word >> 7) & 255)::INT AS exponent, count(*)::BIGINT AS cnt FROM words GROUP BY ALL")
def exponent_histogram(spark, sf):
    w = words(spark, sf)
    return w.groupBy("label", s.bf16_exponent(F.col("word")).alias("exponent")).agg(F.count("*").alias("cnt"))


@query(f"WITH {_WORDS} SELECT word, ((word >> 7) & 255)::INT AS exponent, (((word >> 8) & 128) | (word & 127))::INT AS rest, word AS merged, count(*)::BIGINT AS cnt FROM words GROUP BY ALL")
def bf16_split_merge(spark, sf):
    w = words(spark, sf).select("word", s.bf16_exponent(F.col("word")).alias("exponent"), s.bf16_rest(F.col("word")).alias("rest"))
    return w.withColumn("merged", s.bf16_word(F.col("exponent"), F.col("rest"))).groupBy("word", "exponent", "rest", "merged").agg(F.count("*").alias("cnt"))


@query(f"""WITH {_WORDS}, p AS (SELECT label, (word >> 7) & 255 AS e, ((word >> 8) & 128) | (word & 127) AS r, count(*) AS c FROM words GROUP BY ALL),
h AS (SELECT label, e, sum(c) AS n, sum(c * log2(c)) AS s FROM p GROUP BY ALL), a AS (SELECT label, r, sum(c) AS c FROM p GROUP BY ALL),
plain AS (SELECT label, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS b FROM a GROUP BY ALL)
SELECT h.label, sum(n)::BIGINT AS total, round(sum(n * log2(n) - s) / sum(n), 6) AS cond_bits, round(any_value(plain.b), 6) AS plain_bits FROM h JOIN plain ON h.label IS NOT DISTINCT FROM plain.label GROUP BY h.label""")
def conditional_entropy(spark, sf):
    """What the exponent tells of sign and mantissa."""
    w = words(spark, sf)
    pairs = w.groupBy("label", s.bf16_exponent(F.col("word")).alias("e"), s.bf16_rest(F.col("word")).alias("r")).agg(F.count("*").alias("cnt"))
    found = stats.conditional_entropy(pairs, ["label"], "e", "r")
    return found.select("label", "total", F.round("cond_bits", 6).alias("cond_bits"), F.round("plain_bits", 6).alias("plain_bits"))


@query("SELECT user_id, event_id, xor(event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS diff FROM events")
def xor_delta(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", "event_id", F.col("event_id").bitwiseXOR(F.lag("event_id").over(w)).alias("diff"))


_DUPS = f"WITH {_MEMBERS}, h AS (SELECT doc_id, size, sha256(text) AS x FROM members WHERE size >= 64), f AS (SELECT *, min(doc_id) OVER (PARTITION BY size, x) AS src FROM h)"


@query(_DUPS + " SELECT doc_id, size, src AS src_doc_id FROM f WHERE doc_id <> src")
def dedup_refs(spark, sf):
    """Copies of earlier documents by size, then by digests of windows, then of all bytes."""
    return dedup.duplicates(docs(spark, sf).select("doc_id", "data"), ["doc_id"], least=64, sample=64)


@query(_DUPS + " SELECT count(*)::BIGINT AS copies, coalesce(sum(size), 0)::BIGINT AS dedup_bytes FROM f WHERE doc_id <> src")
def dedup_total(spark, sf):
    return dedup_refs(spark, sf).agg(F.count("*").alias("copies"), F.coalesce(F.sum("size"), F.lit(0)).alias("dedup_bytes"))


@query("""WITH t AS (SELECT vec_id, label, len(embedding) AS size FROM embeddings), b AS (SELECT label, size, min(vec_id) AS base FROM t GROUP BY ALL)
SELECT vec_id, label, size, base AS base_vec_id FROM t JOIN b USING (label, size) WHERE vec_id <> base""")
def delta_candidates(spark, sf):
    t = table(spark, sf, "embeddings").select("vec_id", "label", F.size("embedding").alias("size"))
    return dedup.delta_candidates(t, ["label", "size"], ["vec_id"])


@query("""WITH t AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS base FROM events), d AS (SELECT user_id, event_id, base, xor(event_id, base) AS x FROM t WHERE base IS NOT NULL),
b AS (SELECT user_id, k, (event_id >> (8 * k)) & 255 AS own, (x >> (8 * k)) & 255 AS diff FROM d, (SELECT unnest(range(8)) AS k)),
o AS (SELECT user_id, own AS v, count(*) AS c FROM b GROUP BY ALL), f AS (SELECT user_id, diff AS v, count(*) AS c FROM b GROUP BY ALL),
eo AS (SELECT user_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS bits FROM o GROUP BY ALL), ef AS (SELECT user_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS bits FROM f GROUP BY ALL)
SELECT user_id, round(eo.bits, 6) AS plain_bits, round(ef.bits, 6) AS delta_bits, round(ef.bits, 6) < round(eo.bits, 6) * 0.95 AS chosen FROM eo JOIN ef USING (user_id)""")
def delta_decision(spark, sf):
    """Whether a user's event ids cost a twentieth less as differences from the ones before."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    d = table(spark, sf, "events").select("user_id", "event_id", F.lag("event_id").over(w).alias("base")).where("base IS NOT NULL")
    planes = F.array(*[F.struct(s.byte_plane(F.col("event_id"), k).alias("own"), s.byte_plane(F.col("event_id").bitwiseXOR(F.col("base")), k).alias("diff")) for k in range(8)])
    b = d.select("user_id", F.explode(planes).alias("p")).select("user_id", "p.own", "p.diff")
    bits = lambda col, name: stats.entropy(b.groupBy("user_id", col).agg(F.count("*").alias("cnt")), ["user_id"]).select("user_id", F.round("bits", 6).alias(name))
    both = bits("own", "plain_bits").join(bits("diff", "delta_bits"), "user_id")
    return both.withColumn("chosen", F.col("delta_bits") < F.col("plain_bits") * 0.95)


def _encoded(spark, sf, settings: c.Settings = c.Settings(), esize: int = 1, kind: int = BYTES) -> DataFrame:
    rows = docs(spark, sf).select("doc_id", "source", "data", F.lit(esize).alias("esize"), F.lit(kind).alias("kind"), F.lit(-1).alias("btype"), F.lit(BYTES).alias("ikind"))
    return codecs.encode_chunks(rows, settings)


_DIGESTS = "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL"


def _digest(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", F.sha2("data", 256).alias("digest"))


@query(_DIGESTS)
def roundtrip_zstd(spark, sf):
    return _digest(codecs.decode_chunks(_encoded(spark, sf)))


@query(_DIGESTS)
def roundtrip_deflate(spark, sf):
    return _digest(codecs.decode_chunks(_encoded(spark, sf, c.Settings(general=c.DEFLATE, level=6))))


@query(_DIGESTS)
def roundtrip_split(spark, sf):
    """Elements of two bytes; texts of odd length fall back."""
    return _digest(codecs.decode_chunks(_encoded(spark, sf, esize=2)))


@query(_DIGESTS)
def roundtrip_bf16(spark, sf):
    return _digest(codecs.decode_chunks(_encoded(spark, sf, c.Settings(cond_elements=256, margin=0), esize=2, kind=BF16)))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) > 0")
def roundtrip_rans(spark, sf):
    """Every text through the range coder, also where it does not pay."""
    import pyarrow as pa

    from .functions import kernels as k

    def code(b):
        data = b.column(1).to_pylist()
        back = k.range_decode_many(k.range_encode_many(data), [len(x) for x in data])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(back, pa.binary())], names=["doc_id", "data"])

    return _digest(docs(spark, sf).where("size > 0").select("doc_id", "data").mapInArrow(by_pieces(code), "doc_id bigint, data binary"))


@query("WITH d AS (SELECT doc_id, text, lag(text) OVER (ORDER BY doc_id) AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha256(text) AS digest FROM d")
def roundtrip_delta(spark, sf):
    """Texts coded against the text of a document with the next lower id, cut or padded to length."""
    d = docs(spark, sf).where("data IS NOT NULL")
    before = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("data").alias("prev"))
    size = F.col("size").cast("int")
    padded = F.substring(F.concat(F.coalesce("prev", F.unhex(F.lit(""))), F.col("data")), F.lit(1), size)
    rows = d.join(before, "doc_id", "left").withColumn("base", padded).select("doc_id", "data", "base", F.lit(1).alias("esize"), F.lit(DELTA).alias("kind"), F.lit(-1).alias("btype"), F.lit(BYTES).alias("ikind"))
    bases = rows.select("doc_id", F.col("base").alias("from"))
    coded = codecs.encode_chunks(rows, base="base").join(bases, "doc_id")
    return _digest(codecs.decode_chunks(coded, base="from"))


@query()
def info_by_codec(spark, sf):
    return codecs.codec_table(_encoded(spark, sf), ["source"])


@query()
def method_tally(spark, sf):
    return codecs.method_tally(_encoded(spark, sf, c.Settings(contest=True), esize=2), ["source"])


@query("SELECT source, 'all' AS method, (2 * count(*))::BIGINT AS streams, (2 * sum(octet_length(encode(text))))::BIGINT AS raw FROM documents WHERE octet_length(encode(text)) > 0 GROUP BY source")
def merge_methods(spark, sf):
    """Two tallies merged; raw bytes and streams do not depend on the coder's sizes."""
    t = codecs.method_tally(_encoded(spark, sf), ["source"]).select("source", F.lit("all").alias("method"), "streams", "raw")
    return codecs.merge_tallies(t, t, ["source", "method"])


@query("""WITH t AS (SELECT source, lang, count(*)::BIGINT AS files, sum(octet_length(encode(text)))::BIGINT AS raw FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY raw DESC, source, lang) AS n FROM t) SELECT source, lang, files, raw FROM r WHERE n <= 25""")
def limit_listing(spark, sf):
    """The 25 largest groups of files: a report's limit."""
    t = docs(spark, sf).groupBy("source", "lang").agg(F.count("*").alias("files"), F.sum("size").alias("raw"))
    return t.orderBy(F.desc("raw"), "source", "lang").limit(25)


@query("SELECT source, max_by(byte, cnt * 1000 - byte)::INT AS byte FROM (" + _SOURCE_BYTES + " SELECT * FROM counts) GROUP BY source")
def most_frequent_byte(spark, sf):
    return source_counts(spark, sf).groupBy("source").agg(F.max_by("byte", F.struct("cnt", -F.col("byte"))).alias("byte"))


_LOCATE = f"""WITH {_CHUNKS}, q AS (SELECT o_orderkey, (o_orderkey * 37)::BIGINT AS pos FROM orders)"""


@query(_LOCATE + " SELECT o_orderkey, doc_id, dst, pos - dst AS within FROM q ASOF JOIN chunks ON q.pos >= chunks.dst WHERE pos < dst + rlen")
def locate_offset(spark, sf):
    """The chunk that holds each offset."""
    asked = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 37).alias("pos"), F.lit(0).alias("archive"))
    chunks = doc_chunks(spark, sf).drop("data").withColumn("archive", F.lit(0))
    return reads.locate(asked, chunks, ["archive"], CHUNK).select("o_orderkey", "doc_id", "dst", "within")


@query(f"WITH {_DST} SELECT doc_id, sha256(unhex(substr(hex(encode(text)), 1 + 2 * (size // 3), 2 * 3000))) AS digest FROM placed WHERE size > 0 AND size - size // 3 > 0")
def range_read(spark, sf):
    """Up to 3000 bytes of each document from a third on, read through its chunks."""
    chunks = doc_chunks(spark, sf)
    members = chunks.groupBy("doc_id").agg(F.min("dst").alias("first"), F.sum("rlen").alias("size"))
    asked = members.select("doc_id", (F.col("first") + F.floor(F.col("size") / 3)).alias("pos"), F.least(F.lit(3000), F.col("size") - F.floor(F.col("size") / 3)).alias("len"))
    got = reads.read_ranges(asked, chunks.select("doc_id", "dst", "rlen", "data"), ["doc_id"], ["doc_id"], CHUNK)
    return got.select("doc_id", F.sha2("bytes", 256).alias("digest"))


@query(_DUPS + f""", wants AS (SELECT f.doc_id, p.dst AS dst, q.dst AS pos, f.size FROM f JOIN (WITH {_DST} SELECT * FROM placed) p ON p.doc_id = f.doc_id JOIN (WITH {_DST} SELECT * FROM placed) q ON q.doc_id = f.src WHERE f.doc_id <> f.src),
parts AS (SELECT dst, unnest(range((size + {CHUNK} - 1) // {CHUNK})) AS k, pos, size FROM wants)
SELECT dst AS for_chunk, pos + k * {CHUNK} AS source_chunk, least({CHUNK}, size - k * {CHUNK})::BIGINT AS n, k * {CHUNK} AS at FROM parts""")
def resolve_refs(spark, sf):
    """Copied documents and the chunks that their bytes come from."""
    placed = planning.member_offsets(docs(spark, sf), ["doc_id"])
    copies = dedup.duplicates(docs(spark, sf).select("doc_id", "data"), ["doc_id"], least=64, sample=64)
    dst = placed.select("doc_id", "dst")
    refs = copies.join(dst, "doc_id").join(dst.select(F.col("doc_id").alias("src_doc_id"), F.col("dst").alias("src")), "src_doc_id")
    one = F.lit(0).alias("archive")
    refs = refs.select(one, F.col("dst").alias("chunk_id"), "dst", F.col("size").alias("rlen"), F.lit(c.C_REF).alias("codec"), "src")
    own = doc_chunks(spark, sf).join(copies.select("doc_id"), "doc_id", "left_anti").select(one, F.col("dst").alias("chunk_id"), "dst", "rlen", F.lit(c.C_ONE).alias("codec"), F.lit(-1).cast("long").alias("src"))
    found = reads.resolve_sources(refs.unionByName(own), ["archive"], c.C_REF, c.C_DELTA, CHUNK)
    return found.select("for_chunk", "source_chunk", (F.col("stop") - F.col("begin")).alias("n"), "at")


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS rlen, sha256(text) AS digest, true AS whole FROM documents WHERE text IS NOT NULL")
def verify_digest(spark, sf):
    """Decoded bytes against their checksum, without failing on damage."""
    tried = codecs.try_decode(_encoded(spark, sf))
    return tried.select("doc_id", "rlen", F.sha2("data", 256).alias("digest"), F.col("error").isNull().alias("whole"))


_CATALOG = "cat AS (SELECT source AS name, sum(octet_length(encode(text)))::BIGINT AS original_size, sum(n_chars)::BIGINT AS stored_size, count(*)::INT AS files FROM documents GROUP BY source)"


def models(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.groupBy(F.col("source").alias("name")).agg(F.sum(F.octet_length("text")).cast("long").alias("original_size"), F.sum("n_chars").alias("stored_size"), F.count("*").cast("int").alias("files"))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 0 AND doc_id % 6 = 0")
def append_reject_dup(spark, sf):
    """Members to append that are there already."""
    d = table(spark, sf, "documents").select("doc_id")
    return catalog.clashing(d.where("doc_id % 4 = 0"), d.where("doc_id % 6 = 0"), ["doc_id"])


@query(f"""WITH {_MEMBERS}, o AS (SELECT doc_id, size, (sum(size) OVER (ORDER BY doc_id) - size)::BIGINT AS dst FROM members WHERE doc_id % 3 <> 0), t AS (SELECT max(dst + size) AS total FROM o),
n AS (SELECT doc_id, size, (sum(size) OVER (ORDER BY doc_id) - size)::BIGINT AS dst FROM members WHERE doc_id % 3 = 0) SELECT * FROM o UNION ALL SELECT doc_id, size, dst + total FROM n, t""")
def append_members(spark, sf):
    d = docs(spark, sf).select("doc_id", "size")
    place = lambda x: planning.member_offsets(x, ["doc_id"]).select("doc_id", "size", "dst")
    return catalog.append_members(place(d.where("doc_id % 3 <> 0")), place(d.where("doc_id % 3 = 0")), ["doc_id"])


@query(f"WITH {_CATALOG} SELECT name, original_size, CASE WHEN name LIKE '%1' THEN 0 ELSE stored_size END::BIGINT AS stored_size, files FROM cat")
def catalog_upsert(spark, sf):
    m = models(spark, sf)
    return catalog.upsert(m, m.where(F.col("name").like("%1")).withColumn("stored_size", F.lit(0).cast("long")))


@query(f"WITH {_CATALOG} SELECT * FROM cat WHERE name NOT LIKE '%2'")
def catalog_remove(spark, sf):
    m = models(spark, sf)
    return catalog.remove(m, m.where(F.col("name").like("%2")))


@query("SELECT DISTINCT 'src' || (doc_id % 40) AS name FROM documents WHERE 'src' || (doc_id % 40) NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)")
def catalog_missing(spark, sf):
    wanted = table(spark, sf, "documents").select(F.concat(F.lit("src"), (F.col("doc_id") % 40).cast("string")).alias("name"))
    return catalog.missing(models(spark, sf), wanted)


@query(f"WITH {_CATALOG} SELECT count(*)::BIGINT AS models, sum(original_size)::BIGINT AS original_size, sum(stored_size)::BIGINT AS stored_size, round(1 - sum(stored_size) / sum(original_size), 9) AS saved FROM cat")
def catalog_totals(spark, sf):
    return catalog.totals(models(spark, sf)).withColumn("saved", F.round("saved", 9))


@query(f"WITH {_CATALOG} SELECT coalesce(name, 'total') AS name, sum(original_size)::BIGINT AS original_size, sum(stored_size)::BIGINT AS stored_size, sum(files)::BIGINT AS files, round(sum(original_size) / sum(stored_size), 9) AS ratio FROM cat GROUP BY ROLLUP (name)")
def models_report(spark, sf):
    return catalog.report(models(spark, sf)).withColumn("ratio", F.round("ratio", 9))


@query("""SELECT source AS name, source AS archive, sum(octet_length(encode(text)))::BIGINT AS original_size, sum(octet_length(encode(text)))::BIGINT AS stored_size, count(*)::INT AS files, array_to_string(list_sort(list(doc_id::VARCHAR)), ',') AS members FROM documents GROUP BY source""")
def catalog_rebuild(spark, sf):
    d = docs(spark, sf)
    members = d.select(F.col("source").alias("archive"), F.col("doc_id").cast("string").alias("path"), "size")
    found = catalog.rebuild(members, d.select(F.col("source").alias("archive"), F.col("size").alias("clen")))
    return found.select("name", "archive", "original_size", "stored_size", "files", F.array_join("members", ",").alias("members"))


@query("""SELECT DISTINCT p_name, nullif(regexp_replace(regexp_replace(regexp_replace(trim(' ../' || p_name || '/x y\\z.. ', ' '), '[/\\\\]+|[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+', ''), '[-.]+$', ''), '') AS name FROM part""")
def normalise_name(spark, sf):
    raw = F.concat(F.lit(" ../"), F.col("p_name"), F.lit("/x y\\z.. "))
    return table(spark, sf, "part").select("p_name", s.normalise_name(raw).alias("name")).distinct()


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1024 WHEN 1 THEN p_size * 1048576 WHEN 2 THEN p_size ELSE NULL END::BIGINT AS size FROM part""")
def parse_size(spark, sf):
    unit = F.when(F.col("p_partkey") % 4 == 0, "k").when(F.col("p_partkey") % 4 == 1, " MiB").when(F.col("p_partkey") % 4 == 2, "").otherwise(" apples")
    return table(spark, sf, "part").select("p_partkey", s.parse_size(F.concat(F.col("p_size").cast("string"), unit)).alias("size"))


@query("SELECT o_orderkey, CASE WHEN n >= 1048576 THEN printf('%.2f MiB', n / 1048576) WHEN n >= 1024 THEN printf('%.2f KiB', n / 1024) ELSE printf('%d B', n) END AS shown FROM (SELECT o_orderkey, (o_totalprice * o_orderkey % 3000000)::BIGINT AS n FROM orders)")
def human_size(spark, sf):
    n = F.rint(F.col("o_totalprice") * F.col("o_orderkey") % 3000000).cast("long")
    return table(spark, sf, "orders").select("o_orderkey", s.human_size(n).alias("shown"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '../' WHEN 1 THEN '/' WHEN 2 THEN 'a/../' WHEN 3 THEN 'C:' ELSE '' END || 'd' || page_id || '/x.bin.wlk' AS path FROM pages)
SELECT page_id, path, page_id % 6 >= 4 AS safe, 'x.bin' AS file FROM p""")
def safe_path(spark, sf):
    lead = F.when(F.col("page_id") % 6 == 0, "../").when(F.col("page_id") % 6 == 1, "/").when(F.col("page_id") % 6 == 2, "a/../").when(F.col("page_id") % 6 == 3, "C:").otherwise("")
    path = F.concat(lead, F.lit("d"), F.col("page_id").cast("string"), F.lit("/x.bin.wlk"))
    p = table(spark, sf, "pages").select("page_id", path.alias("path"))
    return p.select("page_id", "path", s.safe_path(F.col("path")).alias("safe"), s.file_name(s.logical_name(F.col("path"))).alias("file"))


_KINDS = list(DTYPE_WIDTH)[:12] + ["ODD"]


@query("WITH k AS (SELECT p_partkey, p_size, [" + ", ".join(f"'{x}'" for x in _KINDS) + f"][1 + p_partkey % {len(_KINDS)}] AS dtype FROM part) SELECT p_partkey, dtype, (CASE " + " ".join(f"WHEN dtype = '{x}' THEN {DTYPE_WIDTH[x]}" for x in _KINDS if x in DTYPE_WIDTH) + f" ELSE 1 END)::INT AS esize, (CASE dtype WHEN 'BF16' THEN {BF16} ELSE {BYTES} END)::INT AS kind, (p_size::BIGINT * 3 * (p_partkey % 5))::BIGINT AS elements FROM k")
def dtype_layout(spark, sf):
    """Element widths, kinds and numbers of elements from an index's types and shapes."""
    dtype = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % len(_KINDS) + 1).cast("int"))
    shape = F.array(F.col("p_size").cast("long"), F.lit(3).cast("long"), F.col("p_partkey") % 5)
    k = table(spark, sf, "part").select("p_partkey", dtype.alias("dtype"), shape.alias("shape"))
    return k.select("p_partkey", "dtype", s.element_width(F.col("dtype")).alias("esize"), s.region_kind(F.col("dtype")).alias("kind"), s.elements(F.col("shape")).alias("elements"))


@query("SELECT event_id, k AS key, json_extract_string(props, '$.\"' || k || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL)")
def json_index(spark, sf):
    """Entries of a JSON index, as a map."""
    e = table(spark, sf, "events").where("props IS NOT NULL")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("""WITH RECURSIVE i AS (SELECT o_custkey, o_orderkey, o_totalprice::BIGINT AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_custkey IS NOT NULL),
f AS (SELECT o_custkey, o_orderkey, n, 0 AS batch, CASE WHEN size >= 250000 THEN 0 ELSE size END AS acc, CASE WHEN size >= 250000 THEN 1 ELSE 0 END AS nxt FROM i WHERE n = 1 UNION ALL
SELECT i.o_custkey, i.o_orderkey, i.n, f.nxt, CASE WHEN f.acc + i.size >= 250000 THEN 0 ELSE f.acc + i.size END, CASE WHEN f.acc + i.size >= 250000 THEN f.nxt + 1 ELSE f.nxt END FROM f JOIN i ON i.o_custkey = f.o_custkey AND i.n = f.n + 1)
SELECT o_custkey, o_orderkey, batch::INT AS batch FROM f""")
def greedy_batches(spark, sf):
    """Orders of a customer in batches that close at a total."""
    o = table(spark, sf, "orders").where("o_custkey IS NOT NULL").select("o_custkey", "o_orderkey", F.rint("o_totalprice").cast("long").alias("size"))
    return reads.greedy_batches(o, ["o_custkey"], "o_orderkey", "size", 250_000)


_READS = "r AS (SELECT user_id, event_id, (event_id % 3) * 100 AS off, 100 AS size FROM events), w AS (SELECT *, coalesce(lag(off + size) OVER (PARTITION BY user_id ORDER BY event_id) = off, false) AS goes_on FROM r)"


@query(f"WITH {_READS} SELECT user_id, event_id, goes_on, (sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS run FROM w")
def sequential_streams(spark, sf):
    """Runs of reads that begin where the one before ended."""
    r = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 3 * 100).alias("offset"), F.lit(100).alias("size"))
    return sequential_runs(r, ["user_id"], "event_id").select("user_id", "event_id", "goes_on", "run")


@query("WITH t AS (SELECT source, sum(octet_length(encode(text)))::BIGINT AS input, sum(n_chars)::BIGINT AS output FROM documents GROUP BY source) SELECT source, input, output, round(CASE WHEN output > 0 THEN input / output ELSE 0 END, 9) AS ratio, round(CASE WHEN input > 0 THEN 1 - output / input ELSE 0 END, 9) AS saved FROM t")
def ratios(spark, sf):
    t = docs(spark, sf).groupBy("source").agg(F.sum("size").alias("input")).join(table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("output")), "source")
    return t.select("source", "input", "output", F.round(share(F.col("input"), F.col("output")), 9).alias("ratio"), F.round(F.when(F.col("input") > 0, 1 - F.col("output") / F.col("input")).otherwise(0.0), 9).alias("saved"))


@query("WITH m AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS size, n_chars FROM documents) SELECT doc_id, (size < 4096 OR n_chars * 50 > size * 49) AS raw FROM m")
def store_raw(spark, sf):
    """Which files are kept as they are."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", catalog.prefer_raw(F.octet_length("text").cast("long"), F.col("n_chars")).alias("raw"))


@query(f"WITH {_DST} SELECT doc_id, size FROM placed WHERE dst < 200000")
def prefix_sample(spark, sf):
    """The members that begin within the first 200000 bytes: a bench's prefix by bytes."""
    return planning.member_offsets(docs(spark, sf).drop("data"), ["doc_id"]).where("dst < 200000").select("doc_id", "size")


@query("SELECT o_orderkey, printf('%.0f MiB/s', o_totalprice * 1000 / 1048576) AS shown FROM orders WHERE o_totalprice IS NOT NULL")
def transfer_rate(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice IS NOT NULL")
    return o.select("o_orderkey", s.transfer_rate(F.col("o_totalprice") * 1000).alias("shown"))


@query(f"WITH {_CHUNKS}, m AS (SELECT source AS archive, max(dst + size) AS n FROM placed GROUP BY 1), l AS (SELECT source AS archive, max(rlen) AS n FROM chunks WHERE doc_id % 2 = 0 GROUP BY 1) SELECT m.archive, coalesce(m.n, 0)::BIGINT AS archive_size, coalesce(l.n, 0)::BIGINT AS block_bytes FROM m LEFT JOIN l ON l.archive = m.archive")
def archive_extents(spark, sf):
    """Restored sizes and longest chunks, of chunks that only every other document has."""
    placed = planning.member_offsets(docs(spark, sf).drop("data"), ["doc_id"]).withColumnRenamed("source", "archive")
    chunks = doc_chunks(spark, sf).where("doc_id % 2 = 0").withColumnRenamed("source", "archive")
    return catalog.extents(placed, chunks)


@query(f"WITH {_CHUNKS}, w AS (SELECT source, dst, lag(dst) OVER (PARTITION BY source ORDER BY rlen % 3, dst) AS p FROM chunks) SELECT source, bool_and(coalesce(dst >= p, true)) AS in_order FROM w GROUP BY source")
def chunk_order(spark, sf):
    """Whether chunks that are listed by a remainder of their lengths happen to be in the order of offsets."""
    chunks = doc_chunks(spark, sf).select("source", "dst", (F.col("rlen") % 3).alias("k"))
    return planning.in_order(chunks, ["source"], ["k", "dst"])


@query()
def method_listing(spark, sf):
    """The tally of methods in the order of a report."""
    return codecs.ordered_tally(method_tally(spark, sf), ["source"])
