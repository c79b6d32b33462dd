import json
import random
import struct

import numpy as np
import pytest

from weightlake.functions import codec as c
from weightlake.functions import kernels as k
from weightlake.functions.tables import BF16, BLOCK, BLOCK_FIELDS, GGML
from weightlake.plans import archive
from weightlake.sources import containers

OPT = archive.Options(chunk_size=1 << 16, least=1 << 12, settings=c.Settings(block_rows=64, cond_elements=1 << 14))
rng = np.random.default_rng(3)


def bf16(n):
    return (rng.normal(0, 0.02, n).astype("<f4").view("<u4") >> 16).astype("<u2").tobytes()


def safetensors(tensors):
    index, blob = {}, b""
    for name, (dtype, shape, raw) in tensors.items():
        index[name] = {"dtype": dtype, "shape": shape, "data_offsets": [len(blob), len(blob) + len(raw)]}
        blob += raw
    head = json.dumps(index).encode()
    return struct.pack("<Q", len(head)) + head + blob


def gguf(tensors):
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    out = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), 2) + text("general.alignment") + struct.pack("<II", 4, 64) + text("general.name") + struct.pack("<I", 8) + text("m")
    blob = b""
    for name, (kind, dims, raw) in tensors.items():
        blob += b"\0" * (-len(blob) % 64)
        out += text(name) + struct.pack(f"<I{len(dims)}QIQ", len(dims), *dims, kind, len(blob))
        blob += raw
    return out + b"\0" * (-len(out) % 64) + blob


def reader(raw):
    return (lambda at, n: raw[at : at + n]), len(raw)


def test_block_fields_tile_their_blocks():
    for kind, widths in BLOCK_FIELDS.items():
        assert sum(widths) == GGML[kind][2] <= 255


@pytest.mark.parametrize("width", [1, 2, 4, 8])
def test_planes_round_trip(width):
    data = rng.integers(0, 256, 96 * width).astype(np.uint8).tobytes()
    planes = k.split_planes(data, width)
    assert planes[0] == data[::width] and k.merge_planes(planes) == data


def test_frequencies_add_up_and_cost_is_a_floor():
    for counts in ([1] * 256, [1] * 255 + [10**9], [0] * 255 + [5], rng.integers(0, 50, 256).tolist()):
        counts = np.array(counts)
        f = k.frequencies(counts)
        assert f.sum() == k.SCALE and ((f > 0) == (counts > 0)).all()
    data = np.minimum(rng.geometric(0.1, 50_000), 255).astype(np.uint8).tobytes()
    assert k.coded_cost(k.histogram(data)) <= len(k.range_encode(data)) < 1.03 * len(data) * k.entropy_bits(k.histogram(data)) / 8 + 1500


def test_damaged_streams_are_noticed():
    data = np.minimum(rng.geometric(0.1, 20_000), 255).astype(np.uint8).tobytes()
    good = k.range_encode(data)
    for bad in (good[:-2], good + b"\0\0", good[:100], b"", bytes([good[0] ^ 255]) + good[1:]):
        with pytest.raises(c.CorruptChunk):
            c.decompress(bad, c.RANS, len(data))


def quant_blocks(kind, n):
    fields = [np.minimum(rng.geometric(0.15, (n, w)), 255).astype(np.uint8) for w in BLOCK_FIELDS[kind]]
    return np.concatenate(fields, axis=1).tobytes()


@pytest.mark.parametrize("kind", sorted(BLOCK_FIELDS))
def test_blocks_round_trip(kind):
    data = quant_blocks(kind, 600)
    e = c.encode_chunk(data, sum(BLOCK_FIELDS[kind]), BLOCK, kind, OPT.settings)
    assert e.codec == c.C_BLOCK and e.size < len(data)
    assert c.decode_chunk(e.codec, [s[:3] for s in e.streams], e.layout, len(data)) == data


def test_conditioning_is_chosen_where_it_pays_and_declined_elsewhere():
    exponent = rng.integers(118, 124, 1 << 16)
    for narrow in (True, False):
        rest = np.where((exponent >= 121) & narrow, rng.integers(0, 8, 1 << 16), rng.integers(0, 128, 1 << 16))
        data = (exponent << 7 | rest).astype("<u2").tobytes()
        e = c.encode_chunk(data, 2, BF16, -1, OPT.settings)
        assert e.codec == (c.C_COND if narrow else c.C_BF16)
        assert c.decode_chunk(e.codec, [s[:3] for s in e.streams], e.layout, len(data)) == data


def test_containers():
    raw = safetensors({"a": ("BF16", [4], b"x" * 8), "b": ("F32", [2], b"y" * 8)})
    kind, found = containers.probe(*reader(raw))
    assert kind == "safetensors" and [(t["dtype"], t["esize"], raw[t["start"] : t["end"]]) for t in found] == [("BF16", 2, b"x" * 8), ("F32", 4, b"y" * 8)]
    q = quant_blocks(12, 3)
    raw = gguf({"f": (1, [8], b"h" * 16), "q": (12, [256, 3], q), "u": (99, [7], b"zz")})
    kind, found = containers.probe(*reader(raw))
    assert kind == "gguf" and [(t["dtype"], t["btype"], t["esize"]) for t in found] == [("F16", -1, 2), ("Q4_K", 12, 144), ("TYPE_99", -1, 1)]
    assert raw[found[1]["start"] : found[1]["end"]] == q
    for bad in (b"", b"GGUF", b"\xff" * 64, raw[:40], struct.pack("<Q", 5) + b"[1,2]", b"PK\x03\x04" + b"\0" * 50):
        assert containers.probe(*reader(bad)) == ("raw", [])


def test_torch_zip(tmp_path):
    import pickletools  # noqa: F401
    import zipfile

    # opcodes of a persistent id: a storage class, then its key
    pkl = b"\x80\x02(X\x07\x00\x00\x00storageq\x00ctorch\nBFloat16Storage\nq\x01X\x01\x00\x00\x000q\x02t."
    with zipfile.ZipFile(tmp_path / "m.pt", "w") as z:
        z.writestr("archive/data.pkl", pkl)
        z.writestr("archive/data/0", b"ab" * 10)
        z.writestr("archive/data/1", b"c" * 7)
    raw = (tmp_path / "m.pt").read_bytes()
    kind, found = containers.probe(*reader(raw))
    assert kind == "pytorch"
    assert [(t["name"], t["dtype"], raw[t["start"] : t["end"]]) for t in found] == [("data/0", "BF16", b"ab" * 10), ("data/1", "U8", b"c" * 7)]


def test_storage_classes_of_real_pickles():
    """Pickles as a writer of persistent ids makes them, in every protocol that has them, with shared and repeated names."""
    import io
    import pickle
    import sys
    import types

    torch = types.ModuleType("torchlike")
    for name in ("HalfStorage", "BFloat16Storage"):
        kind = type(name, (), {"__module__": "torchlike"})
        setattr(torch, name, kind)
    sys.modules["torchlike"] = torch

    class Stored:
        def __init__(self, kind, key):
            self.id = ("storage", getattr(torch, kind), key, "cpu", 10)

    class Writer(pickle.Pickler):
        def persistent_id(self, x):
            return x.id if isinstance(x, Stored) else None

    try:
        tree = {"a": [Stored("HalfStorage", "0"), (1, 2, 3)], "b": {"c": Stored("BFloat16Storage", "1"), "storage": Stored("HalfStorage", "2")}, "d": ("storage", "no class", "3")}
        for protocol in (1, 2, 3, 4, 5):
            out = io.BytesIO()
            Writer(out, protocol).dump(tree)
            assert containers.storage_classes(out.getvalue()) == {"0": "HalfStorage", "1": "BFloat16Storage", "2": "HalfStorage"}
            with pytest.raises((ValueError, IndexError)):
                containers.storage_classes(out.getvalue()[:-20])
    finally:
        del sys.modules["torchlike"]


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    w, v = bf16(40_000), bf16(30_000)
    near = bytearray(w)
    for i in random.Random(1).sample(range(0, len(near), 2), 2000):
        near[i] ^= 1
    files = {
        ("m", "a.safetensors"): safetensors({"x": ("BF16", [40_000], w), "y": ("BF16", [30_000], v)}),
        ("m", "b.safetensors"): safetensors({"x": ("BF16", [40_000], bytes(near)), "z": ("BF16", [30_000], v)}),
        # an exact copy of b's x: b's x is a source, so it must not become a difference
        ("m", "c.safetensors"): safetensors({"x": ("BF16", [40_000], bytes(near))}),
        ("m", "q.gguf"): gguf({"q": (12, [256, 400], quant_blocks(12, 400))}),
        ("m", "empty.bin"): b"",
        ("m", "config.json"): b'{"a": 1}' * 50,
        ("n", "one.bin"): bytes(rng.integers(0, 256, 5000).astype(np.uint8)),
    }
    df = spark.createDataFrame([(a, p, bytearray(x)) for (a, p), x in files.items()], "archive string, path string, content binary")
    root = str(tmp_path_factory.mktemp("lake"))
    archive.compress(df, root, OPT)
    return root, files


def test_reads_touch_few_chunks(spark, model, monkeypatch):
    """A tensor or a file is read from its own chunks and those that these take bytes from."""
    root, files = model
    real, seen = archive.decoded, []
    monkeypatch.setattr(archive, "decoded", lambda chunks, *a, **k: seen.append(chunks.count()) or real(chunks, *a, **k))
    total = spark.read.parquet(f"{root}/chunks").count()
    got = {r.path: bytes(r.bytes) for r in archive.read_tensor(root, spark, "z", OPT).collect()}
    assert got == {"b.safetensors": files["m", "b.safetensors"][-60_000:]}
    assert contents(archive.restore(root, spark, "one.bin", OPT)) == {("n", "one.bin"): files["n", "one.bin"]}
    assert contents(archive.restore(root, spark, "empty.bin", OPT)) == {("m", "empty.bin"): b""}
    assert seen[0] < total / 2 and seen[1:] == [1, 0]


def contents(df):
    return {(r.archive, r.path): bytes(r.content) for r in df.collect()}


def test_archive_round_trip(spark, model):
    root, files = model
    assert contents(archive.restore(root, spark, options=OPT)) == files
    assert archive.faults(root, spark, OPT).count() == 0
    codecs = {r.codec: r.raw for r in archive.info(root, spark).where("archive = 'm'").collect()}
    # v once and b's x once are copies
    assert codecs["ref"] == 60_000 + 80_000
    assert "blk-split" in codecs
    assert sum(codecs.values()) == sum(len(x) for (a, _), x in files.items() if a == "m")


def test_one_member_and_tensor(spark, model):
    root, files = model
    assert contents(archive.restore(root, spark, "c.safetensors", OPT)) == {("m", "c.safetensors"): files["m", "c.safetensors"]}
    got = {r.path: bytes(r.bytes) for r in archive.read_tensor(root, spark, "x", OPT).collect()}
    assert got["c.safetensors"] == got["b.safetensors"] == files["m", "c.safetensors"][-80_000:]
    with pytest.raises(KeyError):
        archive.read_tensor(root, spark, "nothing", OPT)


def test_append_and_delta(spark, tmp_path):
    w = bf16(40_000)
    near = bytearray(w)
    for i in range(0, 4000, 2):
        near[i * 20] ^= 1
    make = lambda rows: spark.createDataFrame([(a, p, bytearray(x)) for a, p, x in rows], "archive string, path string, content binary")
    first, second = safetensors({"x": ("BF16", [40_000], w)}), safetensors({"x": ("BF16", [40_000], bytes(near))})
    root = str(tmp_path / "lake")
    archive.compress(make([("s", "1", first), ("s", "2", second)]), root, OPT)
    codecs = {r.codec: r.raw for r in archive.info(root, spark).collect()}
    assert codecs["delta"] == 80_000
    archive.append(make([("s", "3", second), ("t", "1", b"new")]), root, OPT)
    assert contents(archive.restore(root, spark, options=OPT)) == {("s", "1"): first, ("s", "2"): second, ("s", "3"): second, ("t", "1"): b"new"}
    assert archive.faults(root, spark, OPT).count() == 0
    with pytest.raises(ValueError):
        archive.append(make([("s", "3", b"again")]), root, OPT)


def test_appended_checkpoints_are_differences(spark, tmp_path):
    """A series appended one by one is coded against what the archive holds plainly, the latest of it."""
    make = lambda rows: spark.createDataFrame([(a, p, bytearray(x)) for a, p, x in rows], "archive string, path string, content binary")
    w, v = bf16(100_000), bf16(100_000)

    def changed(raw, k):
        raw = bytearray(raw)
        for i in range(k):
            raw[i * 40] ^= 1
        return bytes(raw)

    def step(k, x):
        return safetensors({"x": ("BF16", [100_000], x), "y": ("BF16", [100_000], changed(v, k)), "z": ("BF16", [4000], bf16(4000))})

    # the third has another x, plain, which is the latest base of the fourth's
    u = bf16(100_000)
    files = [("s", "0", step(0, w)), ("s", "1", step(300, changed(w, 300))), ("s", "2", step(900, u)), ("s", "3", step(1200, changed(u, 400)))]
    root, fresh = str(tmp_path / "lake"), str(tmp_path / "fresh")
    archive.compress(make(files[:1]), root, OPT)
    for f in files[1:-1]:
        archive.append(make([f]), root, OPT)
    # of two appended at once both are differences from the stored, not from each other; another archive has no base
    more = [("s", "4", step(1300, changed(u, 500))), ("t", "1", files[0][2])]
    archive.append(make([files[-1], *more]), root, OPT)
    every = files + more
    assert contents(archive.restore(root, spark, options=OPT)) == {(a, p): x for a, p, x in every}
    assert archive.faults(root, spark, OPT).count() == 0
    chunks = spark.read.parquet(f"{root}/chunks")
    deltas = {(r.archive, r.path): r.n for r in chunks.where(chunks.codec == c.C_DELTA).groupBy("archive", "path").agg({"rlen": "sum"}).withColumnRenamed("sum(rlen)", "n").collect()}
    assert deltas == {("s", "1"): 400_000, ("s", "2"): 200_000, ("s", "3"): 400_000, ("s", "4"): 400_000}
    sizes = {r.path: r.dst for r in spark.read.parquet(f"{root}/members").where("archive = 's'").collect()}
    first = min(r.src for r in chunks.where((chunks.codec == c.C_DELTA) & (chunks.path == "3")).collect())
    assert first < sizes["1"] and max(r.src for r in chunks.where((chunks.codec == c.C_DELTA) & (chunks.path == "3")).collect()) >= sizes["2"]
    stored = lambda where: spark.read.parquet(f"{where}/chunks").where("archive = 's'").agg({"clen": "sum"}).first()[0]
    archive.compress(make(every[:5]), fresh, OPT)
    print("stored", stored(root), "in one shot", stored(fresh))


def test_damage_is_reported(spark, model, tmp_path):
    root, _ = model
    for name in ("members", "chunks"):
        df = spark.read.parquet(f"{root}/{name}")
        if name == "chunks":
            df = df.where("NOT (archive = 'n')").withColumn("crc", df.crc + 1)
        df.write.partitionBy("archive").parquet(f"{tmp_path}/{name}")
    what = {(r.archive, r.what) for r in archive.faults(str(tmp_path), spark, OPT).collect()}
    assert ("m", "checksum differs") in what and ("n", "gap or overlap") in what


def test_unsafe_paths_fail(spark):
    for bad in ("../x", "/etc/passwd", "a/../../x", "C:/x", "", "a//b"):
        df = spark.createDataFrame([("a", bad, bytearray(b"x"))], "archive string, path string, content binary")
        with pytest.raises(Exception, match="unsafe path"):
            archive.plan_members(df).collect()


def test_compress_leaves_all_or_nothing(spark, tmp_path):
    schema = "archive string, path string, content binary"
    root = tmp_path / "lake"
    good = spark.createDataFrame([("a", "x", bytearray(b"x" * 9000))], schema)
    bad = good.unionByName(spark.createDataFrame([("a", "../x", bytearray(b"x"))], schema))
    with pytest.raises(Exception, match="unsafe path"):
        archive.compress(bad, str(root), OPT)
    assert list(tmp_path.iterdir()) == []
    archive.compress(good, str(root), OPT)
    assert sorted(p.name for p in root.iterdir()) == ["chunks", "members", "tensors"] and list(tmp_path.iterdir()) == [root]
    with pytest.raises(FileExistsError):
        archive.compress(good, str(root), OPT)
    assert contents(archive.restore(str(root), spark, options=OPT)) == {("a", "x"): b"x" * 9000}


def test_damaged_differences_are_reported(spark, tmp_path):
    from pyspark.sql import functions as F

    w = bf16(40_000)
    near = bytearray(w)
    for i in range(0, 4000, 2):
        near[i * 20] ^= 1
    files = [("s", str(n), bytearray(safetensors({"x": ("BF16", [40_000], bytes(raw))}))) for n, raw in enumerate((w, near))]
    archive.compress(spark.createDataFrame(files, "archive string, path string, content binary"), str(tmp_path / "lake"), OPT)
    for name in ("members", "chunks"):
        df = spark.read.parquet(str(tmp_path / "lake" / name))
        if name == "chunks":
            hurt = F.col("codec") == c.C_DELTA
            assert df.where(hurt).count() > 0
            want = {("checksum differs", r.dst) for r in df.where(hurt).collect()}
            df = df.withColumn("crc", F.when(hurt, F.col("crc") + 1).otherwise(F.col("crc")))
        df.write.partitionBy("archive").parquet(f"{tmp_path}/hurt/{name}")
    assert {(r.what, r.at) for r in archive.faults(f"{tmp_path}/hurt", spark, OPT).collect()} == want
