import random

import pytest
from pyspark.sql import functions as F

from weightlake.functions import scalars as s
from weightlake.functions.tables import BF16, BLOCK, BYTES, DELTA, REF
from weightlake.operators import planning, reads
from weightlake.plans.session import running_total
from weightlake.sources import ranges

REGION = "m int, start long, end long, esize int, kind int, src long, btype int, ikind int"


def chunks_of(spark, rows, sizes, chunk, refs=None, deltas=None):
    cut = lambda x: spark.createDataFrame(x, "m int, start long, end long, src long") if x is not None else None
    df = planning.plan_chunks(spark.createDataFrame(rows, REGION), spark.createDataFrame(sizes, "m int, size long"), ["m"], chunk, cut(refs), cut(deltas))
    return sorted(tuple(r[c] for c in ("m", *planning.FIELDS)) for r in df.collect())


def test_chunks_cover_members(spark):
    rng = random.Random(4)
    rows, sizes = [], []
    for m in range(40):
        at, size = 0, rng.randint(0, 400)
        sizes.append((m, size))
        while at < size:
            at += rng.choice([0, 0, 5])
            e = rng.choice([1, 2, 4])
            end = min(at + e * rng.randint(1, 20), size)
            if end > at:
                rows.append((m, at, end, e, rng.choice([BYTES, BF16]), -1, -1, BYTES))
            at = max(end, at + 1)
    got = chunks_of(spark, rows, sizes, 16)
    for m, size in sizes:
        at = 0
        for c in (c for c in got if c[0] == m):
            assert c[1] == at and c[2] - c[1] <= 16 and (c[2] - c[1]) % c[3] == 0
            at = c[2]
        assert at == size


def test_overlap_gives_up_and_neighbours_join(spark):
    rows = [(1, 0, 10, 2, BYTES, -1, -1, BYTES), (1, 8, 20, 4, BYTES, -1, -1, BYTES), (2, 0, 10, 2, BF16, -1, -1, BYTES), (2, 10, 30, 2, BF16, -1, -1, BYTES), (3, 0, 34, 34, BLOCK, -1, 8, BYTES), (3, 34, 68, 34, BLOCK, -1, 8, BYTES)]
    assert chunks_of(spark, rows, [(1, 20), (2, 30), (3, 70)], 1000) == [(1, 0, 20, 1, 0, -1, -1, 0), (2, 0, 30, 2, BF16, -1, -1, 0), (3, 0, 68, 34, BLOCK, -1, 8, 0), (3, 68, 70, 1, 0, -1, -1, 0)]


def test_refs_and_deltas_move_their_sources(spark):
    rows = [(1, 0, 40, 4, BF16, -1, -1, BYTES)]
    got = chunks_of(spark, rows, [(1, 50)], 8, refs=[(1, 8, 24, 1000)], deltas=[(1, 24, 40, 5000)])
    assert got == [(1, 0, 8, 4, BF16, -1, -1, 0), (1, 8, 16, 1, REF, 1000, -1, 0), (1, 16, 24, 1, REF, 1008, -1, 0), (1, 24, 32, 4, DELTA, 5000, -1, BF16), (1, 32, 40, 4, DELTA, 5008, -1, BF16), (1, 40, 48, 1, 0, -1, -1, 0), (1, 48, 50, 1, 0, -1, -1, 0)]
    # out of bounds: the member's copies are set aside
    assert all(c[4] != REF for c in chunks_of(spark, rows, [(1, 50)], 8, refs=[(1, 8, 24, 1000), (1, 30, 60, 0)]))


def test_ragged_tail_is_plain(spark):
    rows = [(1, 0, 10, 4, BF16, -1, -1, BYTES)]
    assert chunks_of(spark, rows, [(1, 10)], 8) == [(1, 0, 8, 4, BF16, -1, -1, 0), (1, 8, 10, 1, 0, -1, -1, 0)]


def test_running_total_does_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    for n in (1, 3, 11):
        got = {r.id: r.total for r in running_total(df.repartition(n), "v", ["id"], "total", n).collect()}
        assert got == {i: sum(j % 7 for j in range(i)) for i in range(500)}


def test_ranges_read_what_was_asked(spark):
    data = bytes(range(256)) * 4
    chunks = spark.createDataFrame([(0, i, 100 if i + 100 <= 1024 else 1024 - i, bytearray(data[i : i + 100])) for i in range(0, 1024, 100)], "a int, dst long, rlen long, data binary")
    ask = [(0, 1, 0), (1023, 1, 1), (5, 1000, 2), (250, 300, 3), (0, 5000, 4), (99, 2, 5)]
    df = spark.createDataFrame([(0, *x) for x in ask], "a int, pos long, len long, q int")
    got = {r.q: bytes(r.bytes) for r in reads.read_ranges(df, chunks, ["a"], ["q"], 64).collect()}
    assert got == {q: data[p : p + n] for p, n, q in ask}


def test_chained_sources_are_seen(spark):
    rows = [(0, 0, 0, 10, 1, -1), (0, 10, 10, 10, 4, 0), (0, 20, 20, 10, 4, 10), (0, 30, 30, 10, 4, 1 << 40)]
    chunks = spark.createDataFrame(rows, "a int, chunk_id long, dst long, rlen long, codec int, src long")
    found = reads.resolve_sources(chunks, ["a"], 4, 8, 16)
    assert [r.for_chunk for r in reads.chained(found, 4, 8).collect()] == [20]
    assert [r.chunk_id for r in reads.unresolved(chunks, found, ["a"], 4, 8).collect()] == [30]


def test_names(spark):
    rows = [("meta-llama/Llama-3.1-8B", "meta-llama-Llama-3.1-8B"), ("../../etc/passwd", "etc-passwd"), ("  ", None), ("..", None)]
    df = spark.createDataFrame(rows, "t string, want string").select(s.normalise_name(F.col("t")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())
    with pytest.raises(Exception, match="not a usable name"):
        spark.createDataFrame([("//",)], "t string").select(s.required_name(F.col("t"))).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(bytes(range(200)))
    (tmp_path / "y.bin").write_bytes(b"yy")
    (tmp_path / ".DS_Store").write_bytes(b"no")
    assert sorted(map(tuple, ranges.list_files(spark, str(tmp_path)).collect())) == [("a/x.bin", 200), ("y.bin", 2)]
    ranges.register(spark)
    rows = spark.read.format("byte_ranges").option("path", str(tmp_path / "a" / "x.bin")).option("size", 200).option("step", 64).load().orderBy("start").collect()
    assert [(r.start, r.end) for r in rows] == [(0, 64), (64, 128), (128, 192), (192, 200)]
    assert b"".join(bytes(r.data) for r in rows) == bytes(range(200))
