"""``python -m weightlake``: archives and stores from the command line.

Exit codes: 0 done, 1 failed or damaged, 130 interrupted.
"""

from __future__ import annotations

import argparse
import json
import platform
import sys
import tempfile
import time
from collections.abc import Sequence

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import human_size
from .operators import catalog, codecs
from .plans import archive
from .plans.store import Store
from .sources.ranges import read_files


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("weightlake").getOrCreate()


def _name(source: str) -> str:
    return source.rstrip("/").rpartition("/")[2]


def _options(a: argparse.Namespace) -> archive.Options:
    return archive.Options(chunk_size=a.chunk_size, dedup=not a.no_dedup, delta=not a.no_delta)


def _print(df: DataFrame) -> None:
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join(str(x) for x in row))


def _summary(root: str, spark: SparkSession) -> DataFrame:
    """For each archive its files, bytes as restored, bytes as kept, share saved and longest chunk."""
    members, chunks = archive.stored(root, "members", spark), archive.stored(root, "chunks", spark)
    sizes = catalog.rebuild(members, chunks).select("archive", "files", "original_size", "stored_size")
    saved = F.when(F.col("original_size") > 0, 1 - F.col("stored_size") / F.col("original_size")).otherwise(0.0)
    return sizes.withColumn("saved", saved).join(catalog.extents(members, chunks), "archive").orderBy("archive")


def compress(spark: SparkSession, a: argparse.Namespace) -> int:
    archive.compress(read_files(spark, a.source, a.name or _name(a.source)), a.root, _options(a))
    _print(_summary(a.root, spark))
    return 0


def append(spark: SparkSession, a: argparse.Namespace) -> int:
    archive.append(read_files(spark, a.source, a.name or _name(a.source)), a.root, _options(a))
    _print(_summary(a.root, spark))
    return 0


def extract(spark: SparkSession, a: argparse.Namespace) -> int:
    for path in a.paths or [None]:
        _print(archive.extract(a.root, a.dest, spark, a.name, path))
    return 0


def verify(spark: SparkSession, a: argparse.Namespace) -> int:
    wrong = archive.faults(a.root, spark).take(100)
    for row in wrong:
        print(f"{row.archive}\t{row.at}\t{row.what}")
    print("damaged" if wrong else "whole")
    return 1 if wrong else 0


def info(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.json:
        chunks = archive.stored(a.root, "chunks", spark)
        parts = {"archives": _summary(a.root, spark), "codecs": archive.info(a.root, spark), "methods": codecs.ordered_tally(codecs.method_tally(chunks, ["archive"]), ["archive"])}
        print(json.dumps({k: [r.asDict() for r in df.collect()] for k, df in parts.items()}, indent=1))
        return 0
    _print(_summary(a.root, spark))
    _print(archive.info(a.root, spark))
    return 0


def cat(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = archive.read_tensor(a.root, spark, a.tensor)
    for column, value in (("archive", a.name), ("path", a.path)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    found = rows.take(2)
    if len(found) != 1:
        raise KeyError(f"{a.tensor}: " + ("there are several, name an archive and a path" if found else "not there"))
    sys.stdout.flush()
    sys.stdout.buffer.write(bytes(found[0].bytes))
    return 0


def bench(spark: SparkSession, a: argparse.Namespace) -> int:
    """Bytes a second of compressing, checking and extracting a folder, and the share saved."""
    with tempfile.TemporaryDirectory(dir=a.work) as work:
        root, out = f"{work}/lake", {}
        files = read_files(spark, a.source, _name(a.source))
        steps = [
            ("compress", lambda: archive.compress(files, root, _options(a))),
            ("verify", lambda: archive.faults(root, spark).isEmpty()),
            ("extract", lambda: archive.extract(root, f"{work}/out", spark)),
        ]
        for name, step in steps:
            began = time.monotonic()
            step()
            out[name] = time.monotonic() - began
        row = _summary(root, spark).first()
        size = row.original_size if row else 0
        print(json.dumps({"bytes": size, "saved": row.saved if row else 0.0} | {f"{k}_bytes_per_s": size / v for k, v in out.items()}))
    return 0


def doctor(spark: SparkSession, a: argparse.Namespace) -> int:
    """What runs here, and whether a session off this machine names a shared folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    print(f"python {platform.python_version()}\npyspark {pyspark.__version__}\nmaster {spark.sparkContext.master}\ncores {spark.sparkContext.defaultParallelism}\ncheckpoints {shared}")
    return 0 if shared or spark.sparkContext.master.startswith("local") else 1


def add(spark: SparkSession, a: argparse.Namespace) -> int:
    Store(a.store, spark, _options(a)).add(a.name or _name(a.source), read_files(spark, a.source, "x"), a.source, a.replace)
    return 0


def models(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = Store(a.store, spark).models()
    shown = [c if not c.endswith("_size") else human_size(F.col(c)).alias(c) for c in rows.columns]
    _print(rows.select(*shown))
    return 0


def rm(spark: SparkSession, a: argparse.Namespace) -> int:
    Store(a.store, spark).remove(a.name)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weightlake", description="Archives of model files as Spark tables")
    sub = p.add_subparsers(dest="command", required=True)

    def command(run, *names: str, aliases: Sequence[str] = (), writes: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(run.__name__, aliases=list(aliases), help=(run.__doc__ or "").strip() or None)
        c.set_defaults(run=run)
        for n in names:
            c.add_argument(n)
        if writes:
            c.add_argument("--chunk-size", type=int, default=archive.Options.chunk_size)
            c.add_argument("--no-dedup", action="store_true")
            c.add_argument("--no-delta", action="store_true")
        return c

    for run, alias in ((compress, "c"), (append, "a")):
        command(run, "source", "root", aliases=[alias], writes=True).add_argument("--name")
    one = command(extract, "root", "dest", aliases=["x", "decompress", "d"])
    one.add_argument("paths", nargs="*")
    one.add_argument("--name")
    command(verify, "root")
    command(info, "root").add_argument("--json", action="store_true")
    one = command(cat, "root", "tensor")
    one.add_argument("--name")
    one.add_argument("--path")
    command(bench, "source", writes=True).add_argument("--work", help="a folder that all executors share")
    command(doctor)
    one = command(add, "store", "source", writes=True)
    one.add_argument("--name")
    one.add_argument("--replace", action="store_true")
    command(models, "store", aliases=["ls"])
    command(rm, "store", "name")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(_session(), a)
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
