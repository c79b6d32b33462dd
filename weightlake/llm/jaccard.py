"""N-gram Jaccard join by filters under several global token orders.

A document's set is its distinct 5-word shingles. Under any global order of the
shingles, two sets of Jaccard similarity 0.75 share one of the first quarter of
each (the prefix). The first order puts frequent shingles last, so few
documents meet on a prefix shingle; pairs that meet must also share enough of
their prefixes under two hash orders, and pairs that pass all orders are
verified on the whole sets.

Equal sets are one class. To form no pairs within a group, the documents that
meet on a shingle are first paired with two members only: the one that meets
the most others, and one by hash. Groups whose members are then all connected
need nothing more. In the others every two members of different components are
compared, in blocks, by an upper bound of their overlap from counts of hash
classes, then by the hash orders, then by their whole sets. Each of these steps
sends on the members that are left, not their pairs, and the last gives a forest
of links. So no link between components is lost.

Defined results: a document without words has an empty set, links with nothing
and is its own component; with one to four words its set is the one sequence;
rows that repeat an id are separate documents with the same id; a null id takes
part in links, and component_id is the least id that is not null; extra columns
are not looked at; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .session import cut, parts
from .words import find_words, hash_values, mix, pieces, whole_windows, window_hashes

WIDTH = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: At most so many frequent shingles are put last in the first order; the bound affects speed only.
FREQUENT = 50_000
#: Members of a group that are compared in one block.
BLOCK = 2048
#: Set members that are compared in one block.
BLOCK_MEMBERS = 1 << 20
#: Documents up to so many are found by a broadcast of their keys; beyond, by a shuffle.
BROADCAST_KEYS = 50_000
#: Sizes of sets at which a level begins, each at least 100 / PERCENT of the one before; the last is beyond any set.
_LEVELS = [1]
while _LEVELS[-1] < 1 << 40:
    _LEVELS.append(-(-_LEVELS[-1] * 100 // PERCENT))


def shingle_sets(col: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    words = find_words(col, lower=True)
    codes, distinct = words.encode()
    h = mix(hash_values(distinct))[codes] if len(codes) else np.zeros(0, np.uint64)
    s = window_hashes(h, width)
    out = []
    for a, e in zip(words.rows[:-1].tolist(), words.rows[1:].tolist()):
        if e - a >= width:
            out.append(np.unique(s[a : e - width + 1]))
        elif e > a:
            out.append(mix(window_hashes(h[a:e], e - a, seed=3) + np.uint64(e - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _least_overlap(n: int) -> int:
    """A set of n links only with sets that share so many of its members."""
    return -(-PERCENT * n // 100)


def _signature(s: np.ndarray) -> int:
    """A hash of a set, as a signed number."""
    x = mix(s + np.uint64(0x51))
    total = np.add.reduce(x, dtype=np.uint64) ^ (np.bitwise_xor.reduce(mix(x)) if len(x) else np.uint64(0))
    return int(mix(np.array([total + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _class_counts(s: np.ndarray) -> bytes:
    """How many members fall in each hash class, four bits each, with two to four members in a class on average; empty if a count exceeds 15."""
    bits = max(6, int(np.ceil(np.log2(max(len(s), 1) / 4))))
    c = np.bincount((mix(s + np.uint64(7)) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return (c[::2] * 16 + c[1::2]).astype(np.uint8).tobytes() if len(s) and c.max() < 16 else b""


def _class_table(classes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which sets have class counts, and the counts, by as many classes as the set with the fewest has; classes that follow each other are joined."""
    sizes = np.array([len(c) for c in classes])
    known = sizes > 0
    width = int(sizes[known].min()) if known.any() else 1
    table = np.zeros((len(classes), 2 * width), np.uint8)
    for size in np.unique(sizes[known]).tolist():
        rows = np.flatnonzero(sizes == size)
        packed = np.frombuffer(b"".join(classes[k] for k in rows.tolist()), np.uint8)
        full = np.stack([packed >> 4, packed & 15], 1).reshape(len(rows), 2 * width, -1)
        table[rows] = np.minimum(full.sum(2, dtype=np.int64), 255)
        known[rows[(full.sum(2, dtype=np.int64) > 255).any(1)]] = False
    return known, table


def _counts_may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb) -> np.ndarray:
    """False only where no two sets of these class counts and sizes link: they share at most the lesser count of each class."""
    return (100 + PERCENT) * np.minimum(a, b).sum(-1, dtype=np.int64) >= PERCENT * (na + nb)


def _prefix_size(n: int) -> int:
    return n - _least_overlap(n) + 1


def _sketch(s: np.ndarray, order: int) -> bytes:
    """The first members under a hash order, beyond the prefix by a tenth of the set; 16 bits of each."""
    size = min(len(s), _prefix_size(len(s)) + len(s) // 10)
    return np.sort(mix(s + np.uint64(1000 * order + 1)))[:size].astype("<u2").tobytes()


def sketches_may_link(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> bool:
    """False only if no two sets with these first members and sizes link: prefixes longer by l must share l + 1 members. Few bits may match too often, never too seldom."""
    need = -(-PERCENT * (nx + ny) // (100 + PERCENT))
    if need > min(nx, ny):
        return False
    spare = min(len(x) - (nx - need + 1), len(y) - (ny - need + 1))
    if spare < 0:
        return True
    x, y = np.sort(x[: nx - need + 1 + spare]), y[: ny - need + 1 + spare]
    at = np.searchsorted(x, y)
    return int((x[np.minimum(at, len(x) - 1)] == y).sum()) > spare


def sets_link(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).cast("string").alias("t"))


def _profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each document (id, th, n, ref, classes, second, third), and rows of shingles that several documents of a piece of input share (token, times)."""
    texts = _texts(docs, id_col, text_col)
    id_type = texts.schema["id"].dataType.simpleString()

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(b.column(2))
        refs = [_signature(s) for s in sets]
        different = {r: s for r, s in zip(refs, sets)}
        token, times = np.unique(np.concatenate(list(different.values())), return_counts=True)
        often = np.flatnonzero(times >= 3)
        often = often[np.argsort(-times[often], kind="stable")[:4096]]
        m, k = b.num_rows, len(often)
        classes = [_class_counts(s) for s in sets]
        none = pa.nulls(k)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([b.column(0), none.cast(b.column(0).type)]),
                pa.concat_arrays([b.column(1), none.cast(pa.int64())]),
                pa.array([*map(len, sets)] + [None] * k, pa.int64()),
                pa.array(refs + [None] * k, pa.int64()),
                pa.array(classes + [None] * k, pa.binary()),
                *(pa.array([_sketch(s, order) for s in sets] + [None] * k, pa.binary()) for order in (2, 3)),
                pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(token[often].view(np.int64))]),
                pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(times[often].astype(np.int64))]),
            ],
            names=["id", "th", "n", "ref", "classes", "second", "third", "token", "times"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a piece needs is freed before the next
        return map(one, pieces(batches, "t"))

    return texts.mapInArrow(run, f"id {id_type}, th bigint, n bigint, ref bigint, classes binary, second binary, third binary, token bigint, times bigint")


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and how often they were counted; at most FREQUENT, by a count from which on that few exist."""
    total = cut(rows.groupBy("token").agg(F.sum("times").alias("times")))
    # steps of an eighth of a power of two
    level = total.select(F.floor(F.log2("times") * 8).alias("k")).groupBy("k").count().orderBy(F.desc("k")).collect()
    have, least = 0, None
    for r in level:
        have += r["count"]
        if have > FREQUENT:
            break
        least = r.k
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = total.where(F.floor(F.log2("times") * 8) >= least).toPandas()
    token, times = top.token.to_numpy().view(np.uint64), top.times.to_numpy()
    order = np.argsort(token)
    return token[order], times[order]


def _meetings(docs: DataFrame, id_col: str, text_col: str, often: tuple[np.ndarray, np.ndarray], n_parts: int) -> DataFrame:
    """(token, ref, n) for each set and prefix shingle of the first order that another set has in its prefix too.

    Prefixes travel as packed rows, one for each piece of input and bucket;
    buckets of very frequent shingles are split by the set's hash.
    """
    tokens, times = often
    n_buckets = 4 * n_parts
    split_at = max(int(times.sum()) // n_buckets, 1000) if len(times) else 1

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        different = {}
        for s in shingle_sets(b.column(2)):
            if len(s):
                different.setdefault(_signature(s), s)
        sets = list(different.values())
        if not sets:
            return
        refs = np.array(list(different), np.int64)
        sizes = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        if len(tokens):
            at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
            count = np.where(tokens[at] == flat, times[at], 0)
        else:
            count = np.zeros(len(flat), np.int64)
        order = np.lexsort((mix(flat), count, owner))
        start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        rank = np.arange(len(flat)) - np.repeat(start, sizes)
        first = order[rank < np.repeat([_prefix_size(n) for n in sizes.tolist()], sizes)]
        t, o, c = flat[first], owner[first], count[first]
        spread = np.clip(c // split_at + 1, 1, n_buckets).astype(np.uint64)
        bucket = ((mix(t) + mix(refs[o].view(np.uint64)) % spread * np.uint64(7919)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        t, o, c, bucket = t[order], o[order], c[order], bucket[order]
        edge = np.searchsorted(bucket, np.arange(n_buckets + 1))
        out = ([], [], [], [], [])
        for k in np.flatnonzero(np.diff(edge)).tolist():
            part = slice(edge[k], edge[k + 1])
            local, index = np.unique(o[part], return_inverse=True)
            out[0].append(k)
            out[1].append(refs[local].tobytes())
            out[2].append(sizes[local].astype(np.int64).tobytes())
            out[3].append(t[part].tobytes())
            out[4].append((index.astype("<u4") | ((c[part] > 0).astype("<u4") << np.uint32(31))).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["bucket", "refs", "sizes", "tokens", "owners"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            yield from one(b)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, r, n, f = [], [], [], []
        for b in batches:
            for refs, sizes, tok, own in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                own = np.frombuffer(own, "<u4")
                index = own & np.uint32(0x7FFFFFFF)
                t.append(np.frombuffer(tok, np.uint64))
                r.append(np.frombuffer(refs, np.int64)[index])
                n.append(np.frombuffer(sizes, np.int64)[index])
                f.append(own >> np.uint32(31))
        if not t:
            return
        t, r, n, f = map(np.concatenate, (t, r, n, f))
        order = np.lexsort((r, t))
        t, r, n, f = t[order], r[order], n[order], f[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (r[1:] != r[:-1])
        t, r, n, f = t[new], r[new], n[new], f[new]
        same = t[1:] == t[:-1]
        met = f > 0
        met[1:] |= same
        met[:-1] |= same
        t, r, n = t[met], r[met], n[met]
        for k in range(0, len(t), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(t[k : k + 100_000].view(np.int64)), pa.array(r[k : k + 100_000]), pa.array(n[k : k + 100_000])], names=["token", "ref", "n"])

    sent = _texts(docs, id_col, text_col).mapInArrow(send, "bucket int, refs binary, sizes binary, tokens binary, owners binary")
    return sent.repartition(n_parts, "bucket").mapInArrow(meet, "token bigint, ref bigint, n bigint")


def _sizes_fit(a: str, b: str):
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ref, members) for the documents (ref, rid, rth) that stand for their sets."""
    few = wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    same = (F.col("th") == F.col("rth")) & F.col("id").eqNullSafe(F.col("rid"))
    found = _texts(docs, id_col, text_col).join(F.broadcast(wanted) if few else wanted, same).select("ref", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1))], pa.binary())], names=["ref", "members"])

    return found.mapInArrow(run, "ref bigint, members binary")


def _verify(pairs: DataFrame, sketches: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of sets that pass the filters of all orders and link; whole sets are fetched only for pairs that pass."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {k: b.column(k).to_pylist() for k in b.schema.names}
            good = []
            for x, y, nx, ny in zip(c["aclasses"], c["bclasses"], c["an"], c["bn"]):
                known, table = _class_table([x, y])
                good.append(not known.all() or bool(_counts_may_link(table[0], table[1], nx, ny)))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good, pa.bool_())), b.column(1).filter(pa.array(good, pa.bool_()))], names=["a", "b"])

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {k: b.column(k).to_pylist() for k in b.schema.names}
            good = [all(sketches_may_link(np.frombuffer(c["a" + k][i], "<u2"), c["an"][i], np.frombuffer(c["b" + k][i], "<u2"), c["bn"][i]) for k in ("second", "third")) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good, pa.bool_())), b.column(1).filter(pa.array(good, pa.bool_()))], names=["a", "b"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [sets_link(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good, pa.bool_())), b.column(1).filter(pa.array(good, pa.bool_()))], names=["a", "b"])

    def both(pairs: DataFrame, data: DataFrame, cols: list[str]) -> DataFrame:
        side = lambda k: data.select(F.col("ref").alias(k), *[F.col(c).alias(k + c) for c in cols])
        return pairs.join(side("a"), "a").join(side("b"), "b")

    nodes = lambda pairs: pairs.select(F.col("a").alias("ref")).unionByName(pairs.select(F.col("b").alias("ref"))).distinct()
    pairs = cut(both(pairs, sketches, ["n", "classes"]).select("a", "b", "an", "aclasses", "bn", "bclasses").mapInArrow(counted, "a bigint, b bigint"))
    order = ["a", "b", "an", "asecond", "athird", "bn", "bsecond", "bthird"]
    passed = cut(both(pairs, sketches.join(nodes(pairs), "ref", "left_semi"), ["n", "second", "third"]).select(order).mapInArrow(passing, "a bigint, b bigint"))
    sets = cut(_sets_of(docs, cut(nodes(passed).join(reps, "ref")), id_col, text_col))
    return both(passed, sets, ["members"]).select("a", "b", "amembers", "bmembers").mapInArrow(linked, "a bigint, b bigint").distinct()


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each run of equal values in the first ``keys`` columns."""
    key, held = None, []
    for b in batches:
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if b.num_rows else []
        for s, e in zip([0, *new], [*new, b.num_rows]):
            if s == e:
                continue
            k = tuple(c[s] for c in cols)
            if k != key:
                if held:
                    yield key, pa.Table.from_batches(held)
                key, held = k, []
            held.append(b.slice(s, e - s))
    if held:
        yield key, pa.Table.from_batches(held)


def _candidates(cell: int, split: bool, own: np.ndarray, comp: np.ndarray, n: np.ndarray, classes: list[bytes] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Members x of a cell's block, each with those of other components that it may link with by sizes and, if given, class counts; a pair comes once."""
    known, table = _class_table(classes) if classes else (np.zeros(len(n), bool), None)
    names, times = np.unique(comp, return_counts=True)
    common, place, level = names[times.argmax()], np.arange(len(n)), _levels(n)
    for x in np.flatnonzero(comp != common).tolist():
        y = (comp != comp[x]) & ((comp == common) | (place > x)) & (np.minimum(n, n[x]) * 100 >= np.maximum(n, n[x]) * PERCENT)
        y &= np.maximum(level, level[x]) == cell
        if split:
            y &= own != own[x]
        y = np.flatnonzero(y)
        if len(y) and known[x]:
            y = y[~known[y] | _counts_may_link(table[y], table[x], n[y], n[x])]
        if len(y):
            yield x, y


def _levels(n: np.ndarray) -> np.ndarray:
    """Sizes in steps by which two linked sets differ at most: they are of one level or of two that follow each other."""
    return np.searchsorted(_LEVELS, n, side="right")


def _level(n: str):
    """The same as a column."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in _LEVELS]), lambda x: x <= F.col(n)))


def _in_blocks(rows: DataFrame, group: list[str], blocks: DataFrame) -> DataFrame:
    """Each row in every block (i, j) of its group that has its part (own) of the group; ``blocks`` says in how many parts a group is cut."""
    rows = rows.join(blocks, group).withColumn("own", F.pmod(F.xxhash64(F.lit(5), "ref"), "blocks").cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("own", "with"), "j": F.greatest("own", "with")}).drop("with", "blocks")


def _n_blocks() -> Column:
    return F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_MEMBERS)).cast("int").alias("blocks")


_FOUND = "lead bigint, cell int, ref bigint, component bigint, n bigint"
_KEYS = ["lead", "cell", "i", "j"]


def _flagged(key: tuple, refs: dict[int, tuple[int, int]]) -> pa.RecordBatch:
    k, (lead, cell, *_) = len(refs), key
    comp, n = zip(*refs.values()) if refs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array([lead] * k, pa.int64()), pa.array([cell] * k, pa.int32()), pa.array(list(refs), pa.int64()), pa.array(comp, pa.int64()), pa.array(n, pa.int64())], names=["lead", "cell", "ref", "component", "n"])


def _may_link(met: DataFrame, comp: DataFrame, classes: DataFrame) -> DataFrame:
    """(lead, cell, ref, component, n): of the sets that meet on a shingle, those that may link with one of another component by sizes and class counts.

    A cell holds two levels of sizes of a shingle's sets. Cells with one lead,
    the set of the least hash in each, are one group here, as pairs that share
    much meet in many cells; members come out, never pairs.
    """
    rows = met.join(comp.withColumnRenamed("node", "ref"), "ref", "left").withColumn("component", F.coalesce("component", "ref"))
    mixed = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("token")
    rows = rows.join(mixed, "token").withColumn("level", _level("n"))
    rows = cut(rows.select("token", "ref", "n", "component", "level", F.explode(F.array("level", F.col("level") + 1)).alias("cell")))
    lead = F.min(F.struct(F.xxhash64(F.lit(11), "ref"), "ref"))["ref"].alias("lead")
    cells = rows.groupBy("token", "cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("level").alias("top"), F.count("*").alias("size"), lead, _n_blocks())
    cells = cut(cells.where((F.col("lo") != F.col("hi")) & (F.col("top") == F.col("cell"))).select("token", "cell", "lead", "blocks", "size"))
    # a lead with many cells has them dealt over several tasks
    spread = cells.groupBy("lead", "cell").agg(F.ceil(F.sum("size") / BLOCK).alias("spread"))
    cells = cells.join(spread, ["lead", "cell"]).select("token", "cell", "lead", "blocks", F.pmod(F.xxhash64("token"), "spread").cast("int").alias("part"))
    rows = _in_blocks(rows.drop("level"), ["token", "cell"], cells).join(classes, "ref").select(*_KEYS, "part", "token", "own", "ref", "component", "n", "classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, {}
        for (*key, _), t in _groups(batches, 6):
            if key != last:
                if found:
                    yield _flagged(last, found)
                last, found = key, {}
            own, ref, comp, n = (t[k].to_numpy() for k in ("own", "ref", "component", "n"))
            if all(r in found for r in ref.tolist()):
                continue
            good = np.zeros(len(n), bool)
            for x, y in _candidates(key[1], key[2] != key[3], own, comp, n, t["classes"].to_pylist()):
                good[x] = True
                good[y] = True
            good = np.flatnonzero(good)
            found.update(zip(ref[good].tolist(), zip(comp[good].tolist(), n[good].tolist())))
        if found:
            yield _flagged(last, found)

    return rows.repartition(parts(met.sparkSession), *_KEYS, "part").sortWithinPartitions(*_KEYS, "part", "token").mapInArrow(run, _FOUND).distinct()


def _may_link_sketched(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of ``members`` that may link with another of their group by their sketches of both hash orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in _groups(batches, 4):
            own, ref, comp, n = (t[k].to_numpy() for k in ("own", "ref", "component", "n"))
            second, third = ([np.frombuffer(x, "<u2") for x in t[k].to_pylist()] for k in ("second", "third"))
            found: dict[int, tuple[int, int]] = {}
            for x, ys in _candidates(key[1], key[2] != key[3], own, comp, n):
                for y in ys.tolist():
                    if not (ref[x] in found and ref[y] in found) and all(sketches_may_link(s[x], n[x], s[y], n[y]) for s in (second, third)):
                        found |= {ref[k]: (comp[k], n[k]) for k in (x, y)}
            if found:
                yield _flagged(key, found)

    rows = _in_blocks(members, _KEYS[:2], members.groupBy("lead", "cell").agg(_n_blocks())).join(sketches, "ref").select(*_KEYS, "own", "ref", "component", "n", "second", "third")
    return rows.repartition(parts(members.sparkSession), *_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(run, _FOUND).distinct()


def _links_across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of ``members`` as far as their whole sets do: within a block, a forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for key, t in _groups(batches, 4):
            own, ref, comp, n = (t[k].to_numpy() for k in ("own", "ref", "component", "n"))
            members = [np.frombuffer(x, np.uint64) for x in t["members"].to_pylist()]
            label = comp.copy()
            for x, ys in _candidates(key[1], key[2] != key[3], own, comp, n, [_class_counts(s) for s in members]):
                for y in ys.tolist():
                    if label[x] != label[y] and sets_link(members[x], members[y]):
                        label[label == label[y]] = label[x]
                        a.append(min(ref[x], ref[y]))
                        b.append(max(ref[x], ref[y]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = _in_blocks(members, _KEYS[:2], members.groupBy("lead", "cell").agg(_n_blocks())).join(sets, "ref").select(*_KEYS, "own", "ref", "component", "n", "members")
    return rows.repartition(parts(members.sparkSession), *_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(run, "a bigint, b bigint").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, th (hash of its text), n_shingles, ref (its set's class) and component (least ref that it reaches by links)."""
    n_parts = parts(docs.sparkSession)
    profile = cut(_profile(docs, id_col, text_col))
    own = profile.where(F.col("n").isNotNull())
    often = _frequent(profile.where(F.col("token").isNotNull()).select("token", "times"))
    met = cut(_meetings(docs, id_col, text_col, often, n_parts))

    # shingles on which the same sets meet are one group
    groups = met.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("ref")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "ref")).alias("y")).where("size > 1")
    groups = groups.groupBy("x", "y", "size").agg(F.min("token").alias("token"))
    met = cut(met.join(groups.select("token", "size"), "token"))
    degree = met.groupBy("ref").agg(F.sum("size").alias("degree"))
    ranked = met.join(degree, "ref")
    pivots = ranked.groupBy("token").agg(F.max(F.struct("degree", "ref", "n")).alias("p"), F.min(F.struct(F.xxhash64(F.lit(9), "ref").alias("h"), "ref", "n")).alias("q"))
    star = met.join(pivots, "token").select("ref", "n", F.explode(F.array(F.struct("p.ref", "p.n"), F.struct("q.ref", "q.n"))).alias("other"))
    star = star.where((F.col("ref") != F.col("other.ref")) & _sizes_fit("n", "other.n")).select(F.least("ref", "other.ref").alias("a"), F.greatest("ref", "other.ref").alias("b")).distinct()
    reps = own.groupBy("ref").agg(F.min(F.struct("id", "th")).alias("r")).select("ref", F.col("r.id").alias("rid"), F.col("r.th").alias("rth"))
    if not own.groupBy("id", "th").count().where("count > 1").isEmpty():
        # of rows that repeat id and text one stands for their set
        docs = docs.select(F.col(id_col), F.col(text_col)).distinct()
    # of the sets that meet another, once each
    sketches = cut(own.select("ref", "n", "classes", "second", "third").join(met.select("ref").distinct(), "ref", "left_semi").dropDuplicates(["ref"]))
    links = cut(_verify(star, sketches, reps, docs, id_col, text_col))
    comp = components(links)
    members = cut(_may_link(met.select("token", "ref", "n"), comp, sketches.select("ref", "classes")))
    members = cut(_may_link_sketched(members, sketches.select("ref", "second", "third")))
    sets = cut(_sets_of(docs, cut(members.select("ref").distinct().join(reps, "ref")), id_col, text_col))
    more = cut(_links_across(members, sets))
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    return own.select("id", "th", "n", "ref").join(comp.withColumnRenamed("node", "ref"), "ref", "left").select(F.col("id").alias(id_col), "th", F.col("n").alias("n_shingles"), "ref", F.coalesce("component", "ref").alias("component"))


def with_component_ids(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_shingles, component_id: the least id of the component; a document without a set is alone."""
    least = found.where("n_shingles > 0").groupBy("component").agg(F.min(id_col).alias("component_id"))
    alone = F.when(F.col("n_shingles") == 0, F.col(id_col)).otherwise(F.col("component_id"))
    return found.join(least, "component", "left").select(id_col, "n_shingles", alone.alias("component_id"))
