"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is a hash of the words that a fixed mask selects at a position; words at
the mask's zeros do not count. Seeds of documents and of benchmark items are
joined, every hit names a diagonal, and on each diagonal the words are compared
one by one. An item is found where WINDOW consecutive words of it, all of a
shorter item, differ from the document in at most MAX_SUBSTITUTED words (none
for a shorter item). The two masks hit every such window; a test enumerates
all substitutions. With ``short``, as in the pipeline (the query's SQL leaves
them out), items shorter than the masks meet documents on the hash of all their words, and items
of ONE_SUBSTITUTED words and more, which may then differ in one, on that of
either half.

Words are maximal runs of ASCII letters, digits and non-ASCII characters in
lower case. Defined results: null or empty texts and items have no words;
items with fewer words than the shorter mask's span are looked for with
``short`` only, so that an item of one word is found wherever that word is;
rows that repeat id and text are one document, rows that repeat only the id are
judged apart; extra columns are kept by ``drop_contaminated`` and not looked
at; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import BROADCAST_BYTES, cut, small

MASKS = ("1111011", "111010011")
WINDOW = 13
MAX_SUBSTITUTED = 2
#: Items of so many words, below WINDOW, may differ in one word.
ONE_SUBSTITUTED = 8
#: Verified hits are broadcast to their documents up to so many rows; beyond, both sides are shuffled.
BROADCAST_HITS = 50_000

_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _NOT_WORD), lambda w: w != "")


def _run(n: Column) -> Column:
    """The words that an item of n words must have in a row: all, or a half, as one substitution leaves one as it is; null if masks find it."""
    return F.when((n > 0) & (n < min(map(len, MASKS))), n).when((n >= ONE_SUBSTITUTED) & (n < WINDOW), F.floor(n / 2).cast("int"))


def _seeds(df: DataFrame, keep: list[str], runs: list[int] = [], items: bool = False) -> DataFrame:
    """A row for each position and mask of ``words``, and each length of ``runs``, for items only their own: the columns to keep, ``at`` and ``seed``."""
    least = min([*map(len, MASKS), *runs])
    n, at = F.size("words"), F.col("at")
    placed = df.where(n >= least).select(*keep, "words", F.explode(F.sequence(F.lit(0), n - least)).alias("at"))
    one = lambda k, mask: F.xxhash64(F.lit(k), *[F.get("words", at + i) for i, c in enumerate(mask) if c == "1"])
    own = lambda w: (_run(n) == w) & ((at == 0) | (at == n - w)) if items else F.lit(True)
    # a mask that reaches beyond the last word has no seed there
    hashes = F.array(*[F.when(at + len(mask) <= n, one(k, mask)) for k, mask in enumerate(MASKS)], *[F.when((at + w <= n) & own(w), one(len(MASKS), "1" * w)) for w in runs])
    return placed.select(*keep, "at", F.explode(hashes).alias("seed")).where(F.col("seed").isNotNull())


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", short: bool = False) -> DataFrame:
    """One row for each document and benchmark item found in it: id, text hash, item, first word in document and item, words compared, words equal."""
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), _words(F.col(text_col)).alias("words"))
    items = benchmark.select(F.col(item_col).alias("item"), _words(F.col(item_text_col)).alias("words")).dropDuplicates()
    # at most a length for each below the masks and below half a window
    runs = sorted(r.w for r in items.select(_run(F.size("words")).alias("w")).where("w IS NOT NULL").distinct().collect()) if short else []
    seeds = _seeds(items, ["item"], runs, True).withColumnRenamed("at", "item_at")
    item_side = small(benchmark, [item_text_col], BROADCAST_BYTES // 16)
    hits = _seeds(d, ["id", "th"], runs).join(F.broadcast(seeds) if item_side else seeds, "seed")
    diagonals = cut(hits.groupBy("id", "th", "item", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.count("*").alias("n")))

    few = diagonals.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
    found = diagonals.select("id", "th", "item", "shift").withColumnRenamed("id", "hit_id").withColumnRenamed("th", "hit_th")
    known = items.withColumnRenamed("words", "item_words")
    found = found.join(F.broadcast(known) if item_side else known, "item")
    same = (F.col("th") == F.col("hit_th")) & F.col("id").eqNullSafe(F.col("hit_id"))
    pairs = d.join(F.broadcast(found) if few else found, same)
    # 1 at each word of the item that equals the document's on this diagonal; then sums over windows by running totals
    n = F.size("item_words")
    width = F.least(n, F.lit(WINDOW))
    equal = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.coalesce((F.when(j + F.col("shift") >= 0, F.get("words", j + F.col("shift"))) == F.get("item_words", j)).cast("int"), F.lit(0)))
    pairs = pairs.select("id", "th", "item", "shift", n.alias("n"), width.alias("width"), equal.alias("equal"))
    sums = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("width")), lambda j: F.struct(F.aggregate(F.slice("equal", j + 1, F.col("width")), F.lit(0), lambda a, x: a + x).alias("n_equal"), (-j).alias("back")))
    best = pairs.select("id", "th", "item", "shift", "width", F.array_max(sums).alias("best"))
    allowed = F.when(F.col("width") < (ONE_SUBSTITUTED if short else WINDOW), 0).when(F.col("width") < WINDOW, 1).otherwise(MAX_SUBSTITUTED)
    best = best.where(F.col("best.n_equal") >= F.col("width") - allowed)
    first = F.struct(F.col("best.n_equal").alias("n_equal"), (-(F.col("shift") - F.col("best.back"))).alias("back"), F.col("best.back").alias("item_back"), "width")
    return best.groupBy("id", "th", "item").agg(F.max(first).alias("x")).select(
        F.col("id").alias(id_col), "th", F.col("item").alias(item_col), (-F.col("x.back")).cast("long").alias("start_word"), (-F.col("x.item_back")).cast("long").alias("item_start"), F.col("x.width").cast("long").alias("n_words"), F.col("x.n_equal").cast("long").alias("n_equal")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """The documents without those that hold a benchmark passage."""
    bad = contaminated_spans(docs, benchmark, id_col, text_col, short=short).select(F.col(id_col).alias("bad_id"), F.col("th").alias("bad_th")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"))
    bad = cut(bad)
    few = bad.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
    same = (F.col("th") == F.col("bad_th")) & F.col("id").eqNullSafe(F.col("bad_id"))
    return rows.join(F.broadcast(bad) if few else bad, same, "left_anti").select("row.*")
