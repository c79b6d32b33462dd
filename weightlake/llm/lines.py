"""Line deduplication by deletion neighbourhoods, in DataFrame operations only.

A line, without outer white space, is dropped if an earlier line (by document
id, then place) equals it, or, for lines of NEAR_CHARS[0] characters up to the
length asked for (any length in the query and the pipeline), is one edit away. Equal lines meet on their hash. For one edit, all deletion variants of a
line are emitted as hashed keys and equal variants joined. One edit leaves one
half of a line as it is, so only lines that share a half with another line emit
variants, and only of their other half; lines that share a variant at one place
are all one substitution apart, and lines that a variant of another equals are
one insertion apart, so the earliest of each group suffices and no pairs are
formed. In lines of more than NEAR_CHARS[1] characters the other half is cut into
blocks; one edit changes one block, so only a block around which all else is
shared emits variants. Matches are verified on the whole lines.

Defined results: lines without a word stay; a null text stays null; rows that
repeat id and text are one document, so their lines are equally early and
treated alike; a null id comes first; extra columns of any name are kept; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import cut

#: Lines of so many characters are compared within one edit by their halves; shorter ones must be equal, longer ones are cut into blocks where asked for.
NEAR_CHARS = (8, 2000)
#: Characters in a block of a longer line.
BLOCK = 1000

#: Lines that make up more than one part in SHARES of all are dealt over SALTS tasks.
SHARES = 1000
SALTS = 64
#: Lines up to so many are sent to their documents by a broadcast; beyond, by a shuffle.
BROADCAST_LINES = 100_000

_BLANK = " \t\n\x0b\f\r"


def _halves(line: Column) -> list[tuple[Column, Column, bool]]:
    """(hash of a half, the rest, whether this is the shorter line of an insertion) for each way two lines within one edit can share a half."""
    n = F.char_length(line)
    out = []
    for shorter in (True, False):
        size = n if shorter else n - 1
        m = F.floor(size / 2).cast("int")
        head, tail = F.left(line, m), F.right(line, size - m)
        out.append((F.xxhash64(F.lit("head"), size, head), F.substr(line, m + 1), shorter))
        out.append((F.xxhash64(F.lit("tail"), size, tail), F.left(line, n - (size - m)), shorter))
    return out


def _blocks(key: Column, rest: Column, shorter: bool) -> Column:
    """An array of (key, rest) for each block of a long rest: the hash of all around the block, and the block."""
    extra = 0 if shorter else 1
    count = F.ceil((F.char_length(rest) - extra) / BLOCK).cast("int")
    numbers = F.sequence(F.lit(0), count - 1)
    # behind an insertion the blocks of the longer line are one further on
    hashes = lambda text, shift: F.transform(numbers, lambda i: F.xxhash64(F.substr(text, i * BLOCK + F.lit(1 + shift), F.lit(BLOCK))))
    # a lambda's variable is computed once, not for each block
    given = F.array(F.struct(key.alias("key"), rest.alias("rest"), numbers.alias("numbers"), hashes(rest, 0).alias("ahead"), hashes(rest, extra).alias("behind")))
    around = lambda g, i: F.xxhash64(g["key"], i, F.slice(g["ahead"], 1, i), F.slice(g["behind"], i + 2, F.size(g["behind"])))
    block = lambda g, i: F.substr(g["rest"], i * BLOCK + F.lit(1), F.lit(BLOCK + extra))
    return F.flatten(F.transform(given, lambda g: F.transform(g["numbers"], lambda i: F.struct(around(g, i).alias("key"), block(g, i).alias("rest")))))


def _within_one(a: Column, b: Column) -> Column:
    """Whether two different lines are one edit apart: what follows their longest common start, found by halving, is equal but for one character."""
    fits = lambda n: (n <= F.char_length(a)) & (n <= F.char_length(b)) & (F.left(a, n) == F.left(b, n))
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    same = F.aggregate(steps, F.lit(0), lambda n, step: F.when(fits(n + step), n + step).otherwise(n))
    more = F.char_length(a) - F.char_length(b)
    behind = lambda line, skip: F.substr(line, same + 1 + skip)
    return F.when(more == 0, behind(a, 1) == behind(b, 1)).when(more == 1, behind(a, 1) == behind(b, 0)).when(more == -1, behind(a, 0) == behind(b, 1)).otherwise(False)


def _line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each line with a word: document, place, two hashes, and the half hashes where near matches count."""
    # the text's hash below the explode, else each line computes it
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    lines = texts.select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("no", "raw"))
    lines = lines.select("id", "th", "no", F.btrim("raw", F.lit(_BLANK)).alias("line")).where(F.col("line") != "")
    return lines.select("id", "th", "no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line")


def _near_matches(distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line within one edit."""
    keys = distinct.select("h1", "first", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key")).where(F.col("key").isNotNull())
    # the hash of a half tells its kind, so a line has a key once
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key")
    flagged = cut(keys.join(shared, "key").groupBy("h1", "first").agg(F.collect_set("key").alias("keys")))
    # the lines' texts come from the documents that have them first
    wanted = flagged.groupBy(F.col("first.id").alias("wid"), F.col("first.th").alias("wth")).agg(F.collect_list(F.struct("first", "keys")).alias("lines"))
    few = flagged.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(wanted) if few else wanted, (F.col("th") == F.col("wth")) & F.col("id").eqNullSafe(F.col("wid"))).select(F.split("text", "\n", -1).alias("all"), F.explode("lines").alias("x"))
    line = F.btrim(F.get("all", F.col("x.first.no")), F.lit(_BLANK))
    # rows that repeat id and text give a line twice
    found = cut(found.select(line.alias("line"), "x.first", "x.keys").dropDuplicates(["first"]).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")}))

    long = lambda shorter: F.char_length("line") - (0 if shorter else 1) > NEAR_CHARS[1]
    blocks = None
    if not found.where(long(False)).isEmpty():
        for key, rest, shorter in _halves(F.col("line")):
            own = found.where(long(shorter) & F.array_contains("keys", key))
            own = own.select("h1", "first", F.lit(shorter).alias("shorter"), F.explode(_blocks(key, rest, shorter)).alias("x")).select("h1", "first", "shorter", "x.key", "x.rest")
            blocks = own if blocks is None else blocks.unionByName(own)
        around = blocks.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key")
        blocks = cut(blocks.join(around, "key"))

    variants = []
    owns = [(found.where(~long(shorter) & F.array_contains("keys", key)).select("h1", "first", key.alias("key"), rest.alias("rest")), shorter) for key, rest, shorter in _halves(F.col("line"))]
    if blocks is not None:
        owns += [(blocks.where(F.col("shorter") == shorter).select("h1", "first", "key", "rest"), shorter) for shorter in (True, False)]
    for own, shorter in owns:
        places = F.when(F.char_length("rest") > 0, F.sequence(F.lit(1), F.char_length("rest"))).otherwise(F.array().cast("array<int>"))
        cutout = lambda i: F.concat(F.left("rest", i - 1), F.substr("rest", i + 1))
        if shorter:
            # same length: the variant and its place; one longer: the rest itself
            made = F.concat(F.transform(places, lambda i: F.xxhash64(F.col("key"), i, cutout(i))), F.array(F.xxhash64("key", "rest")))
            variants.append(own.select("h1", "first", F.lit(0).alias("longer"), F.explode(F.array_distinct(made)).alias("v")))
        else:
            made = F.transform(places, lambda i: F.xxhash64(F.col("key"), cutout(i)))
            variants.append(own.select("h1", "first", F.lit(1).alias("longer"), F.explode(F.array_distinct(made)).alias("v")))
    both = variants[0]
    for v in variants[1:]:
        both = both.unionByName(v)
    early = lambda longer: F.min(F.when(F.col("longer") == longer, F.struct("first", "h1"))).alias(f"early{longer}")
    groups = both.groupBy("v").agg(early(0), early(1), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    # a longer line meets shorter ones only; a shorter line meets both
    met = both.join(groups, "v").select("h1", "first", F.explode(F.array("early0", F.when(F.col("longer") == 0, F.col("early1")))).alias("other"))
    met = met.where(F.col("other").isNotNull() & (F.col("other.first") < F.col("first"))).select("h1", "first", F.col("other.first").alias("other_first")).distinct()
    a = found.select(F.col("first"), F.col("line"), "h1", "h2")
    b = found.select(F.col("first").alias("other_first"), F.col("line").alias("other_line"))
    checked = met.select("first", "other_first").join(a, "first").join(b, "other_first")
    return checked.where(F.when(F.char_length("line") > NEAR_CHARS[1], _within_one(F.col("line"), F.col("other_line"))).otherwise(F.levenshtein("line", "other_line", 1) >= 0)).select("h1", "h2").distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: bool = True, longest: int | None = NEAR_CHARS[1]) -> DataFrame:
    """The places of the lines to drop, by document: id, th (hash of its text), drop (equal) and near (one edit, in lines up to ``longest`` characters, or of any length) as arrays."""
    rows = _line_rows(docs, id_col, text_col)
    if near:
        fits = F.char_length("line") >= NEAR_CHARS[0]
        if longest is not None:
            fits &= F.char_length("line") <= longest
        rows = rows.select("id", "th", "no", "h1", "h2", *[F.when(fits, key).alias(f"k{i}") for i, (key, _, _) in enumerate(_halves(F.col("line")))])
        keys = [F.min(f"k{i}").alias(f"k{i}") for i in range(4)]
    else:
        rows, keys = rows.select("id", "th", "no", "h1", "h2"), []
    place = F.struct("id", "th", "no")
    # one row for each different line, kept because it is used three times
    distinct = cut(rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"), *keys).withColumn("again", F.col("first") != F.col("last")).drop("last"))
    more = distinct.where("again").select("h1", "h2", "first", F.lit(False).alias("near"))
    if near:
        close = cut(_near_matches(distinct, docs, id_col, text_col)).select("h1", "h2", F.lit(None).cast(distinct.schema["first"].dataType).alias("first"), F.lit(True).alias("near"))
        more = more.unionByName(close).groupBy("h1", "h2").agg(F.min("first").alias("first"), F.max("near").alias("near"))
    # a line with over a share of all lines is split; by its definition there are fewer than SHARES of them
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    often = distinct.where(F.col("n") > total / SHARES).select("h1", "h2", F.lit(True).alias("often"))
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("id", "th"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt")
    occurrences = rows.select("id", "th", "no", "h1", "h2").join(F.broadcast(often), ["h1", "h2"], "left").select("id", "th", "no", "h1", "h2", salt)
    salts = F.sequence(F.lit(0), F.when(F.col("often"), SALTS - 1).otherwise(0))
    more = more.join(F.broadcast(often), ["h1", "h2"], "left").select("h1", "h2", "first", "near", F.explode(salts).alias("salt"))
    out = occurrences.join(more, ["h1", "h2", "salt"]).where(F.col("near") | (F.struct("id", "th", "no") != F.col("first")))
    return out.groupBy("id", "th").agg(F.collect_set(F.when(~F.col("near"), F.col("no"))).alias("drop"), F.collect_set(F.when(F.col("near"), F.col("no"))).alias("near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: bool = True, longest: int | None = NEAR_CHARS[1]) -> DataFrame:
    """The documents with the dropped lines taken out of their texts, as struct ``row`` (all columns), and n_lines, n_dropped, n_near."""
    found = dropped_lines(docs, id_col, text_col, near, longest).withColumnRenamed("id", "did").withColumnRenamed("th", "dth")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"))
    all_lines = F.split(F.col("row").getField(text_col), "\n", -1)
    rows = rows.join(found, (F.col("th") == F.col("dth")) & F.col("id").eqNullSafe(F.col("did")), "left")
    gone = F.concat(F.coalesce("drop", F.array().cast("array<int>")), F.coalesce("near", F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), gone)
    text = F.when(F.size(gone) == 0, F.col("row").getField(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(all_lines, i)), "\n"))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    fields = [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    # without a split, which only texts that lose lines need
    n_lines = F.octet_length(F.col("row").getField(text_col)) - F.octet_length(F.replace(F.col("row").getField(text_col), F.lit("\n"), F.lit(""))) + 1
    return rows.select(F.struct(*fields).alias("row"), F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), (count("drop") + count("near")).alias("n_dropped"), count("near").alias("n_near"))
