import json

import pytest
from test_archive import OPT, bf16, safetensors

from weightlake import cli
from weightlake.plans import archive, store
from weightlake.streaming import reads

SCHEMA = "archive string, path string, content binary"


def frame(spark, rows):
    return spark.createDataFrame([(a, p, bytearray(x)) for a, p, x in rows], SCHEMA)


def contents(df):
    return {(r.archive, r.path): bytes(r.content) for r in df.collect()}


def under(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


@pytest.fixture
def folder(tmp_path):
    w, v = bf16(40_000), bf16(30_000)
    files = {"a.safetensors": safetensors({"x": ("BF16", [40_000], w)}), "sub/b.safetensors": safetensors({"x": ("BF16", [40_000], w), "y": ("BF16", [30_000], v)}), "sub/empty.bin": b"", ".hidden": b"dot", "_under/a b.bin": b"line", "config.json": b"{}" * 900}
    for name, raw in files.items():
        place = tmp_path / "model" / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(raw)
    return tmp_path / "model", files


def test_extract(spark, tmp_path):
    w = bf16(300_000)
    rows = [("m", "d/a.safetensors", safetensors({"x": ("BF16", [300_000], w)})), ("m", "b.safetensors", safetensors({"x": ("BF16", [300_000], w)})), ("m", "e", b""), ("n", "d/a.safetensors", b"other" * 40_000)]
    root = str(tmp_path / "lake")
    archive.compress(frame(spark, rows), root, OPT)
    done = archive.extract(root, str(tmp_path / "all"), spark, options=OPT).collect()
    assert under(tmp_path / "all") == {f"{a}/{p}": x for a, p, x in rows}
    assert {(r.archive, r.path, r.size) for r in done} == {(a, p, len(x)) for a, p, x in rows}
    archive.extract(root, str(tmp_path / "one"), spark, archive="m", options=OPT)
    assert under(tmp_path / "one") == {p: x for a, p, x in rows if a == "m"}
    archive.extract(root, str(tmp_path / "few"), spark, path="d/a.safetensors", options=OPT)
    assert under(tmp_path / "few") == {f"{a}/{p}": x for a, p, x in rows if p == "d/a.safetensors"}
    with pytest.raises(KeyError):
        archive.extract(root, str(tmp_path / "none"), spark, path="nothing", options=OPT)


def test_damaged_files_are_not_left(spark, tmp_path):
    root = str(tmp_path / "lake")
    archive.compress(frame(spark, [("m", "a", b"abc" * 100_000), ("m", "b", b"abd" * 1000)]), root, OPT)
    for name in ("members", "chunks"):
        df = spark.read.parquet(f"{root}/{name}")
        df = df.where("path != 'a' OR start != 65536") if name == "chunks" else df
        df.write.partitionBy("archive").parquet(f"{tmp_path}/hurt/{name}")
    with pytest.raises(Exception, match="are missing"):
        archive.extract(f"{tmp_path}/hurt", str(tmp_path / "out"), spark, path="a", options=OPT)
    assert under(tmp_path / "out") == {}


def test_append_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "lake")
    old, new = ("s", "1", b"old" * 3000), ("s", "2", safetensors({"x": ("BF16", [4000], bf16(4000))}))
    archive.compress(frame(spark, [old]), root, OPT)
    with monkeypatch.context() as m:
        # all three tables are written, and the driver is lost before the marker is set
        m.setattr(archive, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            archive.append(frame(spark, [new]), root, OPT)
    assert contents(archive.restore(root, spark, options=OPT)) == {old[:2]: old[2]}
    assert archive.faults(root, spark, OPT).count() == 0
    for _ in range(2):
        archive.append(frame(spark, [new]), root, OPT, label="once")
    assert contents(archive.restore(root, spark, options=OPT)) == {old[:2]: old[2], new[:2]: new[2]}
    assert archive.faults(root, spark, OPT).count() == 0
    assert [r.name for r in archive.read_tensor(root, spark, "x", OPT).collect()] == ["x"]


def test_grow_archive(spark, tmp_path):
    rows = [("s", str(k), bytes([k]) * 5000) for k in range(3)]
    for r in rows:
        frame(spark, [r]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    root = str(tmp_path / "lake")
    # without the query's own memory all batches come again
    for run in range(2):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        reads.grow_archive(stream, root, str(tmp_path / f"cp{run}"), OPT).awaitTermination()
        assert contents(archive.restore(root, spark, options=OPT)) == {(a, p): x for a, p, x in rows}
    assert len(archive.commits(root, spark)) == 3


def test_store(spark, tmp_path):
    s = store.Store(str(tmp_path / "store"), spark, OPT)
    make = lambda *rows: frame(spark, [("", *r) for r in rows]).drop("archive")
    assert s.catalog().count() == 0
    s.add("m", make(("a", b"1" * 9000)), "/from/here")
    s.add("l", make(("a", safetensors({"x": ("BF16", [4000], bf16(4000))}))))
    with pytest.raises(ValueError):
        s.add("m", make(("b", b"2" * 9000)))
    s.add("m", make(("b", b"2" * 9000)), replace=True)
    s.grow("m", make(("c", b"3" * 100)))
    assert contents(s.restore("m")) == {("m", "b"): b"2" * 9000, ("m", "c"): b"3" * 100}
    assert [(r.name, r.files) for r in s.models().collect()] == [("l", 1), ("m", 2), ("total", 3)]
    assert s.read_tensor("l", "x").count() == 1
    s.extract("m", str(tmp_path / "out"))
    assert under(tmp_path / "out") == {"b": b"2" * 9000, "c": b"3" * 100}
    s.rebuild()
    assert {(r.name, r.files, r.source) for r in s.catalog().collect()} == {("l", 1, None), ("m", 2, None)}
    s.remove("m")
    with pytest.raises(KeyError):
        s.open("m")
    assert [r.name for r in s.catalog().collect()] == ["l"] and len(list((tmp_path / "store" / "archives").iterdir())) == 1
    with pytest.raises(Exception):
        s.add("bad", make(("../x", b"")))
    assert len(list((tmp_path / "store" / "archives").iterdir())) == 1


def test_commands(spark, folder, tmp_path, capfdbinary):
    source, files = folder
    root = str(tmp_path / "lake")
    assert cli.main(["compress", str(source), root, "--chunk-size", "65536"]) == 0
    assert cli.main(["c", str(source), root]) == 1
    assert cli.main(["append", str(source / "config.json"), root, "--name", "other"]) == 0
    assert cli.main(["verify", root]) == 0
    capfdbinary.readouterr()
    assert cli.main(["info", root, "--json"]) == 0
    told = json.loads(capfdbinary.readouterr().out)
    assert {x["archive"]: x["original_size"] for x in told["archives"]} == {"model": sum(map(len, files.values())), "other": 1800}
    assert cli.main(["cat", root, "y"]) == 0
    assert capfdbinary.readouterr().out == files["sub/b.safetensors"][-60_000:]
    assert cli.main(["cat", root, "x"]) == 1 and cli.main(["cat", root, "x", "--path", "a.safetensors"]) == 0
    assert cli.main(["x", root, str(tmp_path / "out"), "--name", "model"]) == 0
    assert under(tmp_path / "out") == files
    s = str(tmp_path / "store")
    assert cli.main(["add", s, str(source)]) == 0 and cli.main(["add", s, str(source)]) == 1
    capfdbinary.readouterr()
    assert cli.main(["ls", s]) == 0
    assert [x.split(b"\t")[0] for x in capfdbinary.readouterr().out.splitlines()] == [b"name", b"model", b"total"]
    assert cli.main(["rm", s, "model"]) == 0 and cli.main(["rm", s, "model"]) == 1
    assert cli.main(["doctor"]) == 0
    capfdbinary.readouterr()
    assert cli.main(["bench", str(source), "--work", str(tmp_path)]) == 0
    assert json.loads(capfdbinary.readouterr().out)["bytes"] == sum(map(len, files.values()))
