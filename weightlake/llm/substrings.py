"""Substring deduplication on a De Bruijn graph of word windows.

The edges of the graph are windows of WINDOW words. Only an edge that occurs
twice matters, so windows first meet by their minimizer (the least hash of
their 8-word parts): a run of windows with one minimizer travels as one row,
and only if its minimizer occurs twice. Where runs with one minimizer meet,
edges are counted and every run is cut to its repeated edges. Joins then
compact these stretches into nonbranching paths: a stretch continues another if
it is the only one to follow it and follows only it. A path's source is where
its first stretch stands earliest. Each occurrence of a stretch is held against
the words at the path's source, by a digest from a second hash of every word
that took no part in naming the stretch, and the words of those that agree are
removed.

Defined results: a null or empty text has no words; rows that repeat id and
text are documents that repeat each other, so all their windows repeat; rows
that repeat the id alone are separate documents; null ids are ids; texts of any
length are read whole; extra columns are not looked at; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import cut, parts
from .words import Words, find_words, hash_values, mix, pieces, row_of, sliding_min, whole_windows, window_hashes

WINDOW = 35
_PART = 8


class _Runs:
    """Runs of windows that share a minimizer, over the rows of a column."""

    def __init__(self, words: Words, window: int) -> None:
        codes, distinct = words.encode()
        self.distinct, self.codes = distinct, codes
        n = len(codes)
        self.h = mix(hash_values(distinct))[codes] if n else np.zeros(0, np.uint64)
        parts8 = window_hashes(self.h, _PART)
        span = window - _PART + 1
        whole = whole_windows(words.rows, window, n)
        low = sliding_min(parts8, span)[: len(whole)]
        row = row_of(words.rows)[: len(whole)]
        new = np.ones(len(whole), bool)
        new[1:] = (low[1:] != low[:-1]) | ~whole[:-1] | (row[1:] != row[:-1])
        new &= whole
        self.start = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        self.size = np.bincount(run[whole], minlength=len(self.start)) if len(self.start) else np.zeros(0, np.int64)
        self.low = low[self.start].view(np.int64)
        self.row = row[self.start]
        # a run that holds its minimizer twice may hold a window twice; one place is the least of ``span`` windows at most
        self.times = np.where(self.size > span, 2, 1)
        for d in range(1, span):
            twin = np.flatnonzero(parts8[:-d] == parts8[d:]) if len(parts8) > d else []
            if len(twin):
                for back in range(span):
                    at = twin - back
                    at = at[(at >= 0) & (at < len(whole))]
                    at = at[whole[at] & (low[at] == parts8[np.minimum(at + back, len(parts8) - 1)])]
                    self.times[run[at]] = 2


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).cast("string").alias("t"))


def _minimizers(texts: DataFrame, window: int) -> DataFrame:
    """(id, th, low, times) for each run of windows."""
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            r = _Runs(find_words(b.column(2)), window)
            at = pa.array(r.row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(r.low), pa.array(r.times)], names=["id", "th", "low", "times"])

    return texts.mapInArrow(run, f"id {id_type}, th bigint, low bigint, times bigint")


def _run_rows(wanted: DataFrame, window: int) -> DataFrame:
    """A row for each different run of a piece of input whose minimizer is wanted: its edges and its occurrences."""
    id_type = wanted.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            words = find_words(b.column(2))
            r = _Runs(words, window)
            lows = b.column(3)
            owner = np.repeat(np.arange(b.num_rows), pc.list_value_length(lows).fill_null(0).to_numpy())
            key = lambda low, row: mix(low.view(np.uint64) + mix(row.astype(np.uint64) + np.uint64(1)))
            hit = np.flatnonzero(np.isin(key(r.low, r.row), key(np.ascontiguousarray(lows.flatten().to_numpy(zero_copy_only=False)), owner)))
            if not len(hit):
                continue
            start, size = r.start[hit], r.size[hit]
            a = window_hashes(r.h, window, seed=1)
            other = mix(hash_values(r.distinct, seed=1) + np.uint64(1))[r.codes]
            c = window_hashes(other, window, seed=2)
            first = np.concatenate([[0], np.cumsum(size)])
            place = np.arange(first[-1]) - np.repeat(first[:-1], size)
            flat = np.repeat(start, size) + place
            fa, fc = a[flat], c[flat]
            name = np.add.reduceat(mix(fa + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first[:-1]) + size.astype(np.uint64)
            offsets = np.frombuffer(words.values.buffers()[1], np.int64)
            raw = memoryview(words.values.buffers()[2])
            ends = start + size + window - 1
            digest = np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(offsets[start].tolist(), offsets[ends].tolist())), np.uint64, len(hit))
            order = np.lexsort((digest, name))
            new = np.ones(len(order), bool)
            new[1:] = (name[order][1:] != name[order][:-1]) | (digest[order][1:] != digest[order][:-1])
            lead = order[new]
            after = np.minimum(start + size, len(a) - 1)
            follows = (start + size < len(a)) & (start + size + window <= words.rows[r.row[hit] + 1])
            following = np.where(follows, a[after], np.uint64(0)).view(np.int64)
            at = pa.array(r.row[hit][order])
            occ = pa.StructArray.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array((start - words.rows[r.row[hit]])[order]), pa.array(following[order])], names=["id", "th", "start", "next"])
            occ = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(new), len(order)), pa.int32()), occ)
            # by many rows at a time, so that no batch grows large
            for k in range(0, len(lead), 20_000):
                part = lead[k : k + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r.low[hit][part]),
                        pa.array(name[part].view(np.int64)),
                        pa.array(digest[part].view(np.int64)),
                        pa.array([fa[first[i] : first[i + 1]].tobytes() for i in part], pa.binary()),
                        pa.array([fc[first[i] : first[i + 1]].tobytes() for i in part], pa.binary()),
                        occ.slice(k, len(part)),
                    ],
                    names=["low", "name", "digest", "a", "c", "occ"],
                )

    return wanted.mapInArrow(run, f"low bigint, name bigint, digest bigint, a binary, c binary, occ array<struct<id:{id_type},th:bigint,start:bigint,next:bigint>>")


def _stretches(runs: DataFrame) -> DataFrame:
    """A row for each run row and stretch of repeated edges in it: stretch (its name), check (the digest of its words), first edge, offset, edges, whether it ends the run, occurrences."""
    occ_type = runs.schema["occ"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        del held
        if not t.num_rows:
            return
        name, digest = t["name"].to_numpy(), t["digest"].to_numpy()
        times = pc.list_value_length(t["occ"]).to_numpy()
        order = np.lexsort((digest, name))
        new = np.ones(len(order), bool)
        new[1:] = (name[order][1:] != name[order][:-1]) | (digest[order][1:] != digest[order][:-1])
        run_of = np.empty(len(order), np.int64)
        run_of[order] = np.cumsum(new) - 1
        lead = order[new]
        weight = np.bincount(run_of, weights=times, minlength=len(lead)).astype(np.int64)
        a_raw, c_raw = t["a"].combine_chunks(), t["c"].combine_chunks()
        a_raw, c_raw = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (a_raw, c_raw))
        pick = pa.array(lead)
        size = pc.binary_length(a_raw).to_numpy()[lead] // 8
        a = np.frombuffer(b"".join(a_raw.take(pick).to_pylist()), np.uint64)
        c = np.frombuffer(b"".join(c_raw.take(pick).to_pylist()), np.uint64)
        owner = np.repeat(np.arange(len(lead)), size)
        by = np.lexsort((c, a))
        edge = np.ones(len(by), bool)
        edge[1:] = (a[by][1:] != a[by][:-1]) | (c[by][1:] != c[by][:-1])
        group = np.cumsum(edge) - 1
        total = np.bincount(group, weights=weight[owner[by]])
        repeated = np.empty(len(by), bool)
        repeated[by] = total[group] > 1
        # stretches of repeated edges within each run
        first = np.concatenate([[0], np.cumsum(size)])
        begin = repeated.copy()
        begin[1:] &= ~repeated[:-1] | (owner[1:] != owner[:-1])
        end = repeated.copy()
        end[:-1] &= ~repeated[1:] | (owner[1:] != owner[:-1])
        begin, end = np.flatnonzero(begin), np.flatnonzero(end)
        at, run_at = begin - first[owner[begin]], owner[begin]
        last = end - first[owner[end]] == size[run_at] - 1
        # every row of a run has the run's stretches
        low, high = np.searchsorted(run_at, run_of), np.searchsorted(run_at, run_of, side="right")
        rows = np.repeat(np.arange(len(run_of)), high - low)
        which = np.repeat(low, high - low) + np.arange(len(rows)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)

        def digest_of(edges: np.ndarray) -> np.ndarray:
            done = np.concatenate([[np.uint64(0)], np.cumsum(mix(edges))])
            return mix(done[end + 1] - done[begin] + mix(edges[begin]) + mix(edges[end] + np.uint64(1)) + (end - begin).astype(np.uint64))[which]

        # named by one hash of its edges, so that runs of different ends share their stretches; its words are known by the other
        label, check = digest_of(a), digest_of(c)
        occ = t["occ"].combine_chunks()
        occ = occ.chunk(0) if isinstance(occ, pa.ChunkedArray) else occ
        for k in range(0, len(rows), 20_000):
            s, w = rows[k : k + 20_000], which[k : k + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(label[k : k + 20_000].view(np.int64)), pa.array(check[k : k + 20_000].view(np.int64)), pa.array(a[begin[w]].view(np.int64)), pa.array(at[w]), pa.array((end - begin + 1)[w]), pa.array(last[w]), occ.take(pa.array(s))],
                names=["stretch", "check", "first", "at", "edges", "ends", "occ"],
            )

    return runs.repartition(parts(runs.sparkSession), "low").mapInArrow(run, f"stretch bigint, check bigint, first bigint, at bigint, edges bigint, ends boolean, occ {occ_type}")


def compact_paths(stretches: DataFrame) -> DataFrame:
    """(stretch, path, place, source, source_check): nonbranching paths of stretches, named by their source document and number there, each stretch's first edge in its path, and the place (id, th, start) and digest of its words at the path's source.

    A stretch continues another if both are linked to no other and it stands
    right behind it at its source.
    """
    # a stretch's source is its earliest occurrence, so stretches that occur together have neighbouring sources
    earliest = F.array_min(F.transform("occ", lambda o: F.struct(o.id.alias("id"), o.th.alias("th"), (o.start + F.col("at")).alias("start"), F.col("check").alias("check"))))
    own = stretches.groupBy("stretch").agg(F.first("first").alias("first"), F.min("at").alias("least_at"), F.first("edges").alias("edges"), F.min(earliest).alias("o"))
    own = own.select("stretch", "first", "least_at", "edges", F.col("o.id").alias("id"), F.col("o.th").alias("th"), F.col("o.start").alias("start"), F.col("o.check").alias("check"))
    behind = stretches.where("ends").select("stretch", F.explode(F.array_distinct(F.transform("occ", lambda o: o.next))).alias("first")).where("first != 0").distinct()
    links = behind.join(own.where("least_at = 0").select("first", F.col("stretch").alias("to")), "first").select("stretch", "to")
    alone = links.groupBy("stretch").agg(F.count("*").alias("n"), F.first("to").alias("to")).where("n = 1").select(F.col("stretch").alias("from"), "to")
    alone = alone.groupBy("to").agg(F.count("*").alias("n"), F.first("from").alias("from")).where("n = 1").select(F.col("to").alias("stretch"), "from")
    one_in = links.groupBy("to").agg(F.count("*").alias("n")).where("n = 1").select(F.col("to").alias("stretch"))
    own = own.join(alone.join(one_in, "stretch"), "stretch", "left")
    w = Window.partitionBy("id", "th").orderBy("start", "stretch")
    goes_on = (F.col("from") == F.lag("stretch").over(w)) & (F.lag(F.col("start") + F.col("edges")).over(w) == F.col("start"))
    own = own.withColumn("new", F.when(goes_on, 0).otherwise(1))
    own = own.withColumn("number", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("origin", F.min("start").over(Window.partitionBy("id", "th", "number")))
    source = F.struct("id", "th", "start").alias("source")
    return own.select("stretch", F.xxhash64("id", "th", "number").alias("path"), (F.col("start") - F.col("origin")).alias("place"), source, F.col("check").alias("source_check"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, th, spans): for each document, spans (path, origin, start, end) of words that repeated windows cover, end exclusive; origin is where the path would begin."""
    texts = _texts(docs, id_col, text_col)
    lows = _minimizers(texts, window)
    twice = lows.groupBy("low").agg(F.sum("times").alias("n")).where("n > 1").select("low")
    wanted = lows.select("id", "th", "low").join(twice, "low").groupBy("id", "th").agg(F.collect_set("low").alias("lows"))
    wanted = wanted.withColumnsRenamed({"id": "wid", "th": "wth"})
    chosen = texts.join(wanted, (F.col("th") == F.col("wth")) & F.col("id").eqNullSafe(F.col("wid"))).select("id", "th", "t", "lows")
    found = cut(_stretches(_run_rows(chosen, window)))
    # only what has the words that its path has at its source is a repeat
    paths = compact_paths(found).select("stretch", "path", "place", "source_check")
    places = found.select("stretch", "check", "at", "edges", F.explode("occ").alias("o")).join(paths, "stretch").where(F.col("check") == F.col("source_check"))
    start = F.col("o.start") + F.col("at")
    span = F.struct("path", (start - F.col("place")).alias("origin"), start.alias("start"), (start + F.col("edges") + (window - 1)).alias("end"))
    return places.select(F.col("o.id").alias("id"), F.col("o.th").alias("th"), span.alias("span")).groupBy("id", "th").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each document: id, n_words, n_removed, kept (the words left, joined by a space), n_spans (maximal runs of removed words)."""
    spans = repeated_spans(docs, id_col, text_col, window)
    spans = spans.select(F.col("id").alias("sid"), F.col("th").alias("sth"), F.transform("spans", lambda s: s.start).alias("starts"), F.transform("spans", lambda s: s.end).alias("ends"))
    texts = _texts(docs, id_col, text_col)
    joined = texts.join(spans, (F.col("th") == F.col("sth")) & F.col("id").eqNullSafe(F.col("sid")), "left").select("id", "t", "starts", "ends")
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            words = find_words(b.column(1))
            n = len(words.values)
            depth = np.zeros(n + 1, np.int64)
            for k, sign in ((2, 1), (3, -1)):
                owner = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(k)).fill_null(0).to_numpy())
                at = b.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) + words.rows[owner]
                np.add.at(depth, at, sign)
            gone = np.cumsum(depth)[:n] > 0
            row = row_of(words.rows)
            first = gone.copy()
            first[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
            removed, runs = np.bincount(row[gone], minlength=b.num_rows), np.bincount(row[first], minlength=b.num_rows)
            total = np.diff(words.rows)
            kept = words.values.filter(pa.array(~gone)).cast(pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(total - removed)]), pa.int32()), kept)
            text = pc.binary_join(lists, b" ").cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total), pa.array(removed), text, pa.array(runs)], names=["id", "n_words", "n_removed", "kept", "n_spans"])

    return joined.mapInArrow(run, f"id {id_type}, n_words bigint, n_removed bigint, kept string, n_spans bigint").withColumnRenamed("id", id_col)
