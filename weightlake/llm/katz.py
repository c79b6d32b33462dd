"""Katz back-off: Good-Turing discounted bigrams over discounted single words.

Counts live in tables partitioned by hash: words by their hash, bigrams by
their history (a history that is very frequent is split over partitions by the
following word). Documents are read once into batches of tokens, kept as a
table bucketed by batch. A batch asks the word partitions for its words and the
bigram partitions for its bigrams; the same messages carry the batch's training
counts, so counting and looking up are one exchange each. A message has each
word or bigram of a batch once.

P(w|h) = d(c(hw)) c(hw) / c(h) for a bigram seen in training, else
a(h) P(w), where a(h) gives the words that were not seen after h exactly the
mass that discounting left: a(h) = (1 - sum of seen P(w|h)) / (1 - sum of their
P(w)). P(w) = d(c) c / N, and what is left is the probability of a word not
seen at all. Where a history, or the whole, has no discounted count, its
denominators grow by one, so some mass is always left.

Defined results: a null or empty text is its end token alone; a null id counts
as an empty one; rows that repeat ids or texts are scored and counted as often
as they stand; without training documents every token is an unseen word, of
probability one; other
columns are not looked at; empty tables give empty results.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, parts
from .words import find_words, hash_values, mix, pieces, release

#: Counts above this are not discounted.
CUTOFF = 5
#: Bytes of text in a batch.
BATCH_BYTES = 8 << 20

# White space is in no word, so these hashes stand for what is not a word.
_END, _START = hash_values(pa.array([b"\nend", b"\nstart"], pa.binary()))


def held_out(key) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % 7 == 2


def discounts(times: list[float]) -> np.ndarray:
    """Good-Turing factors for counts 0 to CUTOFF, from how many types have the counts 0 to CUTOFF + 1; where the estimate is no proper discount, half a count is taken off."""
    d = np.ones(CUTOFF + 1)
    k, n = CUTOFF, times
    tail = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        good = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        f = (good - tail) / (1 - tail) if tail < 1 else 0.0
        d[r] = f if 0 < f < 1 else (r - 0.5) / r
    d[0] = 0.0
    return d


@dataclass
class Words:
    """The distribution of single words."""

    total: int
    types: int
    d: np.ndarray
    scale: float
    unseen: float

    @classmethod
    def of(cls, total: int, types: int, times: list[int]) -> Words:
        """times: how many types have the counts 0 to CUTOFF + 1."""
        d = discounts(times)
        if not total:
            return cls(0, 0, d, 0.0, 1.0)
        mass = sum(d[r] * r * times[r] for r in range(1, CUTOFF + 1)) + total - sum(r * times[r] for r in range(1, CUTOFF + 1))
        below = total if mass < total else total + 1
        return cls(total, types, d, 1.0 / below, 1.0 - mass / below)

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, _discounted(self.d, count) * self.scale, self.unseen)


def _discounted(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    """d(c) c."""
    return count * np.where(count > CUTOFF, 1.0, d[np.minimum(count, CUTOFF)])


def _pack(x: np.ndarray) -> bytes:
    """Non-negative whole numbers, byte planes apart, compressed."""
    if not len(x):
        return b""
    top = int(x.max())
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if top < 1 << 8 * int(k[2]))
    raw = x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes()
    return kind[2].encode() + len(x).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.int64)
    width, n = int(b[:1]), int.from_bytes(b[1:9], "little")
    raw = pa.Codec("zstd").decompress(b[9:], decompressed_size=width * n)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(f"<u{width}").reshape(n).astype(np.int64)


def _numbered(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 for the different values of ``x``, and how many there are."""
    names, number = np.unique(x, return_inverse=True)
    return number, len(names)


def _steps(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences of numbers that rise within groups; the first of a group as it is."""
    out = x.copy()
    out[1:] -= x[:-1]
    out[first] = x[first]
    return out


def _unstep(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    s = np.cumsum(x)
    return s - np.repeat(s[first] - x[first], size)


def _batches(docs: DataFrame, id_col: str, text_col: str, is_held_out: Callable) -> DataFrame:
    """A row for each batch: its documents, its words (hash and count in training) and its tokens as places in the list of words."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def one(number: int, b: pa.RecordBatch) -> pa.RecordBatch:
        words = find_words(b.column(1), lower=True)
        codes, distinct = words.encode()
        out = np.array([is_held_out(x) for x in b.column(0).to_pylist()], bool)
        size = np.diff(words.rows)
        train = np.repeat(~out, size)
        count = np.append(np.bincount(codes[train], minlength=len(distinct)), (~out).sum())
        hashes = np.append(hash_values(distinct), _END)
        # frequent words first, so that places are small
        order = np.lexsort((hashes, -np.append(np.bincount(codes, minlength=len(distinct)), b.num_rows)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        stream = place[np.insert(codes, words.rows[1:], len(distinct))]
        row = [[(TaskContext.get().partitionId() << 32) + number], [b.column(0).to_pylist()], [out.tolist()], [(size + 1).tolist()], [hashes[order].tobytes()], [_pack(count[order])], [_pack(stream)]]
        kinds = [pa.int64(), pa.list_(b.schema.field("id").type), pa.list_(pa.bool_()), pa.list_(pa.int64()), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["batch", "ids", "held", "sizes", "words", "counts", "stream"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a batch needs is freed before the next
        for number, b in enumerate(pieces(batches, "t", BATCH_BYTES)):
            yield one(number, b)

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return texts.mapInArrow(run, f"batch bigint, ids array<{id_type}>, held array<boolean>, sizes array<bigint>, words binary, counts binary, stream binary")


def _by_bucket(asked: DataFrame, n: int, one: Callable[[int, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``one`` makes of each bucket's messages; a task holds one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for b in batches:
            bucket = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for s, e in zip(edges[:-1], edges[1:]):
                if s == e:
                    continue
                if held and bucket[s] != last:
                    yield one(last, pa.Table.from_batches(held))
                    held = []
                    release()
                last = int(bucket[s])
                held.append(b.slice(s, e - s))
        if held:
            yield one(last, pa.Table.from_batches(held))

    return asked.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _word_answers(table: DataFrame, n: int) -> DataFrame:
    """For each batch and bucket, the ids and counts of the words asked for, in the batch's order; and a row of statistics for each partition."""
    buckets = 4 * n

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, words, counts in zip(*(b.column(k).to_pylist() for k in range(3))):
                h, c = np.frombuffer(words, np.uint64), _unpack(counts)
                bucket = (mix(h) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(edge)).tolist()
                cut_up = [order[edge[k] : edge[k + 1]] for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([batch] * len(some), pa.int64()), pa.array([h[x].tobytes() for x in cut_up], pa.binary()), pa.array([_pack(c[x]) for x in cut_up], pa.binary())], names=["bucket", "batch", "words", "counts"])

    def one(bucket: int, t: pa.Table) -> pa.RecordBatch:
        h = [np.frombuffer(x, np.uint64) for x in t["words"].to_pylist()]
        name, back = np.unique(np.concatenate(h), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([_unpack(x) for x in t["counts"].to_pylist()]), minlength=len(name)).astype(np.int64)
        rank = np.empty(len(name), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(name))
        ids = rank * buckets + bucket
        times = [int((total == r).sum()) for r in range(CUTOFF + 2)]
        at, out = 0, []
        for x in h:
            i = back[at : at + len(x)]
            out.append((_pack(ids[i]), _pack(total[i])))
            at += len(x)
        return pa.RecordBatch.from_arrays(
            [pa.array([bucket] * len(out) + [-1], pa.int32()), pa.array([*t["batch"].to_pylist(), -1], pa.int64()), pa.array([x for x, _ in out] + [None], pa.binary()), pa.array([x for _, x in out] + [None], pa.binary()), pa.array([None] * len(out) + [[int(total.sum()), int((total > 0).sum()), *times]], pa.list_(pa.int64()))],
            names=["bucket", "batch", "ids", "counts", "stats"],
        )

    asked = table.select("batch", "words", "counts").mapInArrow(ask, "bucket int, batch bigint, words binary, counts binary")
    return _by_bucket(asked, n, one, "bucket int, batch bigint, ids binary, counts binary, stats array<bigint>")


def _sum_stats(rows: DataFrame, size: int) -> list[int]:
    r = rows.where("stats IS NOT NULL").agg(*[F.coalesce(F.sum(F.get("stats", F.lit(k))), F.lit(0)).alias(f"x{k}") for k in range(size)]).first()
    return [int(x) for x in r]


class _Batch:
    """A batch's bigrams, each once, in the order of its questions."""

    def __init__(self, words: bytes, stream: bytes, sizes: list[int], held: list[bool], answers: list, n: int, total: int) -> None:
        h = np.frombuffer(words, np.uint64)
        bucket = (mix(h) % np.uint64(4 * n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(4 * n + 1))
        # one more word: the start, whose id no word has
        self.ids, self.count = np.zeros(len(h) + 1, np.int64), np.zeros(len(h) + 1, np.int64)
        for k, ids, counts in answers:
            part = order[edge[k] : edge[k + 1]]
            self.ids[part], self.count[part] = _unpack(ids), _unpack(counts)
        self.ids[:-1] += 1
        end = int(np.flatnonzero(h == _END)[0])
        # as a history the start is as frequent as the end
        self.count[-1] = self.count[end]
        self.w = _unpack(stream)
        self.sizes = np.array(sizes, np.int64)
        heads = np.cumsum(self.sizes) - self.sizes
        self.h = np.empty_like(self.w)
        self.h[1:] = self.w[:-1]
        self.h[heads] = len(h)
        self.heads = heads
        train = np.repeat(~np.array(held, bool), self.sizes)
        width = len(h) + 1
        key, self.back = np.unique(self.h * width + self.w, return_inverse=True)
        times = np.bincount(self.back[train], minlength=len(key))
        ph, pw = key // width, key % width
        known = (self.count[ph] > 0) & (self.count[pw] > 0)
        # a frequent history is split by the following word, and asked for in all its parts
        parts_of = np.clip(self.count * n // max(total, 1) + 1, 1, 4 * n)
        base = (mix(self.ids.astype(np.uint64)) % np.uint64(4 * n)).astype(np.int64)
        seen_h = np.unique(ph)
        seen_h = seen_h[self.count[seen_h] > 0]
        bucket = (base[ph] + (mix(self.ids[pw].astype(np.uint64) + np.uint64(77)) % parts_of[ph].astype(np.uint64)).astype(np.int64)) % (4 * n)
        sub = np.repeat(seen_h, parts_of[seen_h])
        step = np.arange(len(sub)) - np.repeat(np.cumsum(parts_of[seen_h]) - parts_of[seen_h], parts_of[seen_h])
        # questions: (bucket, history), then the words after it
        self.q_bucket, self.q_h = (base[sub] + step) % (4 * n), sub
        o = np.lexsort((self.ids[self.q_h], self.q_bucket))
        self.q_bucket, self.q_h = self.q_bucket[o], self.q_h[o]
        pair = np.flatnonzero(known)
        o = np.lexsort((self.ids[pw[pair]], self.ids[ph[pair]], bucket[pair]))
        self.pair, self.p_bucket = pair[o], bucket[pair][o]
        self.ph, self.pw, self.times, self.n_pairs = ph, pw, times, len(key)

    def questions(self) -> Iterator[tuple[int, list[bytes]]]:
        for k in np.unique(self.q_bucket).tolist():
            a, e = np.searchsorted(self.q_bucket, [k, k + 1])
            b, f = np.searchsorted(self.p_bucket, [k, k + 1])
            hist = self.ids[self.q_h[a:e]]
            pair = self.pair[b:f]
            at = np.searchsorted(hist, self.ids[self.ph[pair]])
            size = np.bincount(at, minlength=len(hist))
            w = self.ids[self.pw[pair]]
            first = (np.cumsum(size) - size)[size > 0]
            yield k, [_pack(_steps(hist, np.zeros(1, np.int64))), _pack(size), _pack(_steps(w, first)), _pack(self.count[self.pw[pair]]), _pack(self.times[pair])]


def _bigram_answers(joined: DataFrame, n: int, words: Words) -> DataFrame:
    """For each batch and bucket, the counts of the bigrams asked for, and of each history the discounted counts by size, the other counts' sum and its words' P(w); and statistics."""
    names = ["hist", "size", "w", "cw", "times"]

    def questions(row: dict) -> pa.RecordBatch:
        got = _Batch(row["words"], row["stream"], row["sizes"], row["held"], [(a["bucket"], a["ids"], a["counts"]) for a in row["answers"]], n, words.total)
        out = list(got.questions())
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([row["batch"]] * len(out), pa.int64()), *(pa.array([x[j] for _, x in out], pa.binary()) for j in range(5))], names=["bucket", "batch", *names])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield questions({k: b.column(k)[i].as_py() for k in b.schema.names})
                release()

    def one(bucket: int, t: pa.Table) -> pa.RecordBatch:
        hist, size, w, cw, times = [], [], [], [], []
        for a, s, x, c, k in zip(*(t[k].to_pylist() for k in names)):
            s = _unpack(s)
            hist.append(np.cumsum(_unpack(a)))
            size.append(s)
            w.append(_unstep(_unpack(x), (np.cumsum(s) - s)[s > 0], s[s > 0]))
            cw.append(_unpack(c))
            times.append(_unpack(k))
        lengths, entries = [len(x) for x in hist], [len(x) for x in w]
        hist, size, w, cw, times = map(np.concatenate, (hist, size, w, cw, times))
        # a bucket's part of a history is a history of its own here
        part, n_parts = _numbered(hist)
        owner = np.repeat(part, size)
        o = np.lexsort((w, owner))
        new = np.ones(len(o), bool)
        new[1:] = (owner[o][1:] != owner[o][:-1]) | (w[o][1:] != w[o][:-1])
        which = np.empty(len(o), np.int64)
        which[o] = np.cumsum(new) - 1
        count = np.bincount(which, weights=times).astype(np.int64) if len(o) else np.zeros(0, np.int64)
        p_owner, p_cw = owner[o][new], cw[o][new]
        del o, new, owner, w, cw, times
        seen = count > 0
        mass = np.bincount(p_owner[seen], weights=words.probability(p_cw[seen]), minlength=n_parts)
        small = [np.bincount(p_owner[count == r], minlength=n_parts) for r in range(1, CUTOFF + 1)]
        large = np.bincount(p_owner[count > CUTOFF], weights=count[count > CUTOFF], minlength=n_parts).astype(np.int64)
        stats = [int((count == r).sum()) for r in range(CUTOFF + 2)]
        counts, histories = [], []
        i = j = 0
        for li, le in zip(lengths, entries):
            p = part[i : i + li]
            counts.append(_pack(count[which[j : j + le]]))
            histories.append([_pack(x[p]) for x in (*small, large)] + [pa.Codec("zstd", 1).compress(mass[p].tobytes(), asbytes=True)])
            i, j = i + li, j + le
        k = len(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([*t["batch"].to_pylist(), -1], pa.int64()), pa.array([bucket] * k + [-1], pa.int32()), pa.array([*counts, None], pa.binary()), pa.array([*histories, None], pa.list_(pa.binary())), pa.array([None] * k + [stats], pa.list_(pa.int64()))],
            names=["batch", "bucket", "counts", "histories", "stats"],
        )

    asked = joined.mapInArrow(ask, "bucket int, batch bigint, " + ", ".join(f"{k} binary" for k in names))
    return _by_bucket(asked, n, one, "batch bigint, bucket int, counts binary, histories array<binary>, stats array<bigint>")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", is_held_out: Callable = held_out) -> DataFrame:
    """One row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score (add-one), score (Katz), as log10 probabilities.

    The model is computed at once; the scores are kept in the checkpoint folder
    and the table of batches is dropped.
    """
    spark = docs.sparkSession
    n = parts(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    name = f"katz_batches_{uuid.uuid4().hex}"
    try:
        _batches(docs, id_col, text_col, is_held_out).write.bucketBy(n, "batch").option("compression", "zstd").saveAsTable(name)
        table = spark.table(name)
        found = cut(_word_answers(table, n))
        total, types, *times = _sum_stats(found, CUTOFF + 4)
        words = Words.of(total, types, times)
        answers = found.where("batch >= 0").groupBy("batch").agg(F.collect_list(F.struct("bucket", "ids", "counts")).alias("answers"))
        joined = table.join(answers, "batch").select("batch", "words", "stream", "sizes", "held", "answers")
        bigrams = cut(_bigram_answers(joined, n, words))
        d = discounts(_sum_stats(bigrams, CUTOFF + 2))
        replies = bigrams.where("batch >= 0").groupBy("batch").agg(F.collect_list(F.struct("bucket", "counts", "histories")).alias("replies"))
        last = table.join(answers, "batch").join(replies, "batch", "left").select("batch", "words", "stream", "sizes", "held", "ids", "answers", "replies")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    yield _scored({k: b.column(k)[i].as_py() for k in b.schema.names}, b.schema.field("ids").type.value_type, n, words, d)
                    release()

        schema = f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
        return cut(last.mapInArrow(run, schema)).withColumnRenamed("id", id_col)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _scored(row: dict, id_kind: pa.DataType, n: int, words: Words, d: np.ndarray) -> pa.RecordBatch:
    got = _Batch(row["words"], row["stream"], row["sizes"], row["held"], [(a["bucket"], a["ids"], a["counts"]) for a in row["answers"]], n, words.total)
    count = np.zeros(got.n_pairs, np.int64)
    small, large, mass = [np.zeros((k, len(got.ids))) for k in (CUTOFF, 1, 1)]
    for r in row["replies"] or ():
        k = r["bucket"]
        a, e = np.searchsorted(got.q_bucket, [k, k + 1])
        b, f = np.searchsorted(got.p_bucket, [k, k + 1])
        count[got.pair[b:f]] = _unpack(r["counts"])
        hist = got.q_h[a:e]
        for j in range(CUTOFF):
            small[j][hist] += _unpack(r["histories"][j])
        large[0][hist] += _unpack(r["histories"][CUTOFF])
        mass[0][hist] += np.frombuffer(pa.Codec("zstd").decompress(r["histories"][-1], decompressed_size=8 * (e - a)), np.float64)
    sizes = np.arange(1, CUTOFF + 1)[:, None]
    all_counts = (small * sizes).sum(0) + large[0]
    left = (small * sizes * (1 - d[1:, None])).sum(0)
    # a history without a discounted count has one more in its denominator
    below = np.where(left > 0, all_counts, all_counts + 1)
    left = np.where(left > 0, left, 1.0)
    back_off = np.where(all_counts > 0, left / below / np.maximum(1 - mass[0], 1e-15), 1.0)
    single = words.probability(got.count)
    p = np.where(count > 0, _discounted(d, count) / below[got.ph], back_off[got.ph] * single[got.pw])
    score = np.add.reduceat(np.log10(p)[got.back], got.heads)
    base = np.log10((got.count + 1) / (words.total + words.types + 1))
    base = np.add.reduceat(base[got.w], got.heads)
    known = np.add.reduceat((got.count > 0).astype(np.int64)[got.w], got.heads)
    return pa.RecordBatch.from_arrays(
        [pa.array(row["ids"], id_kind), pa.array(row["held"], pa.bool_()), pa.array(got.sizes), pa.array(known), pa.array(np.full(len(got.sizes), words.total)), pa.array(base), pa.array(score)],
        names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )
