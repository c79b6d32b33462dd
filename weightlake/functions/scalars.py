"""Column functions: names, sizes, paths, bit planes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import BF16, BYTES, DTYPE_WIDTH


def normalise_name(text: Column) -> Column:
    """A name fit for a catalog; null where nothing is left."""
    s = F.regexp_replace(F.trim(text), r"[/\\]+|[^A-Za-z0-9._-]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"^[-.]+", ""), r"[-.]+$", "")
    return F.when(s != "", s)


def required_name(text: Column) -> Column:
    """``normalise_name``, which fails the query where nothing is left."""
    s = normalise_name(text)
    return F.when(s.isNotNull(), s).otherwise(F.raise_error(F.concat(F.lit("not a usable name: "), F.coalesce(text, F.lit("null")))))


def parse_size(text: Column) -> Column:
    """Bytes of a size such as 64k, 1.5 MiB or 2gb; null if it is no size."""
    s = F.lower(F.trim(text))
    number = F.regexp_extract(s, r"^([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?)(?:i?b)?$", 1)
    unit = F.regexp_extract(s, r"^([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?)(?:i?b)?$", 2)
    scale = F.when(unit == "k", 2.0**10).when(unit == "m", 2.0**20).when(unit == "g", 2.0**30).when(unit == "t", 2.0**40).otherwise(1.0)
    return F.when(number != "", F.floor(number.cast("double") * scale).cast("long"))


def human_size(n: Column) -> Column:
    """A size in the largest unit of which there is at least one, with two digits; bytes without."""
    units = [(2.0**40, "TiB"), (2.0**30, "GiB"), (2.0**20, "MiB"), (2.0**10, "KiB")]
    out = F.format_string("%d B", n)
    for scale, unit in reversed(units):
        out = F.when(n >= scale, F.format_string(f"%.2f {unit}", F.bround(n / scale, 2))).otherwise(out)
    return out


def transfer_rate(per_second: Column) -> Column:
    """Bytes a second in whole MiB, halves to even."""
    return F.format_string("%.0f MiB/s", F.bround(per_second.cast("double") / 2.0**20, 0))


def safe_path(path: Column) -> Column:
    """Whether a member path stays below its folder: relative, no drive, no empty or parent step."""
    steps = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return (path != "") & ~path.rlike(r"^[/\\]|^.:") & ~F.exists(steps, lambda s: (s == "..") | (s == ""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def logical_name(path: Column) -> Column:
    """A stored file's name without one storage suffix."""
    return F.regexp_replace(path, r"\.(wlk|wlr)$", "")


def element_width(dtype: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in DTYPE_WIDTH.items() for x in pair])
    return F.coalesce(known[dtype], F.lit(1))


def region_kind(dtype: Column) -> Column:
    return F.when(dtype == "BF16", BF16).otherwise(BYTES)


def elements(shape: Column) -> Column:
    """How many elements a shape has."""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)


def byte_plane(x: Column, k: int) -> Column:
    """Byte k of a whole number, the least first."""
    return F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255)).cast("int")


def join_planes(planes: list[Column]) -> Column:
    out = planes[0].cast("long")
    for k, p in enumerate(planes[1:], 1):
        out = out.bitwiseOR(F.shiftleft(p.cast("long"), 8 * k))
    return out


def bf16_exponent(word: Column) -> Column:
    return F.shiftright(word, 7).bitwiseAND(F.lit(255))


def bf16_rest(word: Column) -> Column:
    """Sign and mantissa of a bfloat16 word in one byte."""
    return F.shiftright(word, 8).bitwiseAND(F.lit(128)).bitwiseOR(word.bitwiseAND(F.lit(127)))


def bf16_word(exponent: Column, rest: Column) -> Column:
    sign = F.shiftleft(rest.bitwiseAND(F.lit(128)), 8)
    return sign.bitwiseOR(F.shiftleft(exponent, 7)).bitwiseOR(rest.bitwiseAND(F.lit(127)))


def windows_of(data: Column, size: Column, window: int) -> Column:
    """First, middle and last ``window`` bytes of binary data; all of it if it is no longer than the three."""
    middle = F.floor((size - window) / 2).cast("int")
    cut = F.concat(F.substring(data, F.lit(1), F.lit(window)), F.substring(data, middle + 1, F.lit(window)), F.substring(data, (size - window + 1).cast("int"), F.lit(window)))
    return F.when(size <= 3 * window, data).otherwise(cut)


def digest_windows(data: Column, size: Column, window: int) -> Column:
    """As ``windows_of``, with the middle at a multiple of 64 as duplicate search takes it."""
    middle = F.floor(size / 2).cast("int").bitwiseAND(F.lit(-64))
    cut = F.concat(F.substring(data, F.lit(1), F.lit(window)), F.substring(data, middle + 1, F.lit(window)), F.substring(data, (size - window + 1).cast("int"), F.lit(window)))
    return F.when(size <= 3 * window, data).otherwise(cut)
