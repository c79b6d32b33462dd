"""From regions to chunks: gaps, overlaps, carving, joining, slicing, coverage.

Regions are rows (keys..., start, end, esize, kind, src, btype, ikind) of a
member of ``size`` bytes; windows are partitioned by the member's keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import BYTES, DELTA, REF
from ..plans.session import running_total

FIELDS = ["start", "end", "esize", "kind", "src", "btype", "ikind"]


def member_offsets(members: DataFrame, order: list[str], size: str = "size") -> DataFrame:
    """Adds ``dst``: where each member starts in the one output space.

    ``order`` tells the members apart. Offsets are made of it and the sizes
    alone; other columns are joined to them, so contents are not sorted.
    """
    placed = running_total(members.select(*order, size), size, order, "dst")
    if set(members.columns) == {*order, size}:
        return placed
    names = {k: f"_{k}_of" for k in order}
    same = [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]
    return members.join(placed.drop(size).withColumnsRenamed(names), same).drop(*names.values())


def plain(df: DataFrame) -> DataFrame:
    """Missing region columns with the values of untyped bytes."""
    for c, v in (("esize", 1), ("kind", BYTES), ("src", -1), ("btype", -1), ("ikind", BYTES)):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(v).cast("long" if c == "src" else "int"))
    return df


def overlapping(regions: DataFrame, keys: list[str]) -> DataFrame:
    """The members (keys) of which two regions overlap."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    seen = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return regions.withColumn("_seen", seen).where(F.col("start") < F.col("_seen")).select(*keys).distinct()


def fill_gaps(regions: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Regions and, for bytes that none covers, regions of single bytes; ``members`` has keys and size."""
    edges = plain(regions.select(*keys, *[c for c in FIELDS if c in regions.columns])).withColumn("_real", F.lit(True))
    stops = plain(members.select(*keys, F.col("size").alias("start"), F.col("size").alias("end"))).withColumn("_real", F.lit(False))
    w = Window.partitionBy(*keys).orderBy("start", "_end_mark", "end")
    both = edges.unionByName(stops).withColumn("_end_mark", ~F.col("_real"))
    both = both.withColumn("_before", F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    gaps = plain(both.where("start > _before").select(*keys, F.col("_before").cast("long").alias("start"), F.col("start").cast("long").alias("end")))
    return edges.drop("_real").unionByName(gaps)


def coalesce_regions(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Joins neighbours of one layout; copies and differences only where their sources are neighbours too."""
    w = Window.partitionBy(*keys).orderBy("start")
    was = lambda c: F.lag(c).over(w)
    sourced = F.col("kind").isin(REF, DELTA)
    same = (was("end") == F.col("start")) & (was("kind") == F.col("kind")) & (was("btype") == F.col("btype")) & (was("ikind") == F.col("ikind"))
    same &= (F.col("kind") == REF) | (was("esize") == F.col("esize"))
    same &= ~sourced | (was("src") + was("end") - was("start") == F.col("src"))
    marked = regions.withColumn("_new", F.when(same, 0).otherwise(1))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, "start").alias(c)
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[first(c) for c in FIELDS[2:]]).drop("_island")


def slice_regions(regions: DataFrame, chunk_size: int) -> DataFrame:
    """Chunks of whole elements; a last piece that is none is plain bytes, and sources move along."""
    step = F.greatest(F.lit(chunk_size) - F.lit(chunk_size) % F.col("esize"), F.col("esize"))
    pieces = regions.where("end > start").withColumn("_step", step.cast("long")).withColumn("_at", F.explode(F.sequence(F.col("start").cast("long"), (F.col("end") - 1).cast("long"), F.col("_step"))))
    stop = F.least(F.col("_at") + F.col("_step"), F.col("end"))
    pieces = pieces.withColumn("_stop", stop)
    ragged = (F.col("kind") != REF) & ((F.col("_stop") - F.col("_at")) % F.col("esize") != 0) & (F.col("_stop") == F.col("end"))
    moved = F.when(ragged | (F.col("src") < 0), F.lit(-1)).otherwise(F.col("src") + F.col("_at") - F.col("start"))
    keys = [c for c in regions.columns if c not in FIELDS]
    return pieces.select(
        *keys,
        F.col("_at").alias("start"),
        F.col("_stop").cast("long").alias("end"),
        F.when(ragged, 1).otherwise(F.col("esize")).cast("int").alias("esize"),
        F.when(ragged, BYTES).otherwise(F.col("kind")).cast("int").alias("kind"),
        moved.cast("long").alias("src"),
        F.when(ragged, -1).otherwise(F.col("btype")).cast("int").alias("btype"),
        F.when(ragged, BYTES).otherwise(F.col("ikind")).cast("int").alias("ikind"),
    )


def _usable(cuts: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Cuts of the members of which all cuts are in bounds and apart; one bad cut sets all of a member's aside."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    checked = cuts.join(members.select(*keys, "size"), keys)
    bad = (F.col("start") < F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) | (F.col("end") <= F.col("start")) | (F.col("end") > F.col("size"))
    checked = checked.withColumn("_bad", F.max(bad).over(Window.partitionBy(*keys)))
    return checked.where(~F.col("_bad")).select(*keys, "start", "end", "src")


def _pieces(regions: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Regions split where cuts begin and end, with the cut (c_start, c_src) that covers each piece."""
    cuts = cuts.select(*keys, F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.col("src").alias("c_src"))
    meets = (F.col("c_start") < F.col("end")) & (F.col("c_end") > F.col("start"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    cond = meets
    for s in same:
        cond = cond & s
    joined = regions.alias("r").join(cuts.alias("c"), cond, "left")
    found = joined.groupBy(*[F.col(f"r.{c}").alias(c) for c in [*keys, *FIELDS]]).agg(F.sort_array(F.collect_list(F.when(F.col("c_start").isNotNull(), F.struct("c_start", "c_end", "c_src")))).alias("cuts"))
    points = F.array_distinct(F.array_sort(F.concat(F.array("start", "end"), F.flatten(F.transform("cuts", lambda c: F.array(F.greatest(c.c_start, F.col("start")), F.least(c.c_end, F.col("end"))))))))
    found = found.withColumn("_points", points).withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_points") - 2)))
    found = found.withColumn("_s", F.get("_points", F.col("_i"))).withColumn("_e", F.get("_points", F.col("_i") + 1))
    return found.withColumn("_cut", F.get(F.filter("cuts", lambda c: (c.c_start <= F.col("_s")) & (c.c_end >= F.col("_e"))), F.lit(0)))


def carve_refs(regions: DataFrame, refs: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Takes the ranges that copy earlier bytes out of the regions and puts them in as copies."""
    refs = _usable(refs, members, keys)
    rest = _pieces(plain(regions), refs, keys).where(F.col("_cut").isNull()).select(*keys, F.col("_s").alias("start"), F.col("_e").alias("end"), "esize", "kind", F.lit(-1).cast("long").alias("src"), "btype", F.lit(BYTES).alias("ikind"))
    return rest.unionByName(plain(refs).withColumns({"kind": F.lit(REF), "src": F.col("src").cast("long")}).select(rest.columns))


def carve_deltas(regions: DataFrame, deltas: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Marks the ranges that are coded as differences from earlier bytes; each piece keeps its region's layout."""
    deltas = _usable(deltas, members, keys)
    free = F.col("_cut").isNotNull() & ~F.col("kind").isin(REF, DELTA)
    return _pieces(plain(regions), deltas, keys).select(
        *keys,
        F.col("_s").alias("start"),
        F.col("_e").alias("end"),
        "esize",
        F.when(free, DELTA).otherwise(F.col("kind")).alias("kind"),
        F.when(free, F.col("_cut.c_src") + F.col("_s") - F.col("_cut.c_start")).otherwise(F.when(F.col("kind").isin(REF, DELTA), F.col("src") + F.col("_s") - F.col("start")).otherwise(-1)).cast("long").alias("src"),
        "btype",
        F.when(free, F.col("kind")).otherwise(F.col("ikind")).alias("ikind"),
    )


def plan_chunks(regions: DataFrame, members: DataFrame, keys: list[str], chunk_size: int, refs: DataFrame | None = None, deltas: DataFrame | None = None) -> DataFrame:
    """Chunks that cover every member; a member with overlapping regions is plain bytes."""
    if chunk_size < 1:
        raise ValueError("a chunk has at least one byte")
    regions = plain(regions)
    if refs is not None:
        regions = carve_refs(regions, refs, members, keys)
    if deltas is not None:
        regions = carve_deltas(regions, deltas, members, keys)
    regions = regions.join(overlapping(regions, keys), keys, "left_anti")
    return slice_regions(coalesce_regions(fill_gaps(regions, members, keys), keys), chunk_size)


def coverage_faults(chunks: DataFrame, total: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dst, expected) where chunks (keys, dst, rlen), in order, leave a gap or overlap, or do not end at the total."""
    rows = chunks.select(*keys, "dst", "rlen").withColumn("_end", F.lit(False))
    rows = rows.unionByName(total.select(*keys, F.col("total").alias("dst"), F.lit(0).cast("long").alias("rlen"), F.lit(True).alias("_end")))
    rows = rows.withColumn("expected", F.coalesce(F.sum("rlen").over(Window.partitionBy(*keys).orderBy("_end", "dst", "rlen").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.where("dst != expected").select(*keys, "dst", "expected")


def in_order(chunks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, in_order): whether offsets never fall when rows are read in the order given."""
    before = F.lag("dst").over(Window.partitionBy(*keys).orderBy(*order))
    return chunks.withColumn("_up", F.coalesce(F.col("dst") >= before, F.lit(True))).groupBy(*keys).agg(F.every("_up").alias("in_order"))
