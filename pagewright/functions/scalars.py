"""Scalar functions on names, texts, arrays and page sizes, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, BLANKS, "")


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def file_stem(c: Column) -> Column:
    """Base name without its last ending."""
    return F.regexp_replace(basename(c), r"\.[^.]*$", "")


def stripped_stem(c: Column) -> Column:
    """As ``file_stem`` of the stripped name; '' for null."""
    return file_stem(strip(F.coalesce(c, F.lit(""))))


def first_dot_stem(c: Column) -> Column:
    """Base name up to its first dot."""
    return F.substring_index(basename(c), ".", 1)


def has_extension(c: Column, extensions: list[str]) -> Column:
    return c.rlike(rf"(?i)\.({'|'.join(extensions)})$")


def truncated(c: Column, limit: int = 150_000, suffix: str = "…") -> Column:
    """At most ``limit`` characters, the suffix included; a limit of 0 or less changes nothing."""
    if limit <= 0:
        return c
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - len(suffix)), F.lit(suffix))).otherwise(c)


def head_middle_tail(c: Column, whole: int = 8000, ends: int = 2000, blocks: int = 8, block: int = 500) -> Column:
    """The text if short, else its head, evenly spread blocks of its middle and its tail."""
    n = F.length(c)
    room = blocks * block
    middle_n = n - 2 * ends
    start = lambda i: (F.lit(ends + 1) + F.floor(i * (middle_n - block) / (blocks - 1))).cast("int")
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.substring(c, start(i), F.lit(block))), "")
    middle = F.when(middle_n <= room, F.substring(c, F.lit(ends + 1), middle_n)).otherwise(spread)
    return F.when(n <= whole, c).otherwise(F.concat(F.substring(c, 1, ends), middle, F.substring(c, n - ends + 1, F.lit(ends))))


def page_number(c: Column) -> Column:
    """Digits after the last underscore of a stem, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"_([0-9]+)$", 1), F.lit("")).try_cast("int"), F.lit(0))


def listed(c: Column, blank_is_empty: bool = True) -> Column:
    """A scalar as a list of one; '' gives an empty list if ``blank_is_empty``. Null gives an empty list."""
    none = F.array().cast("array<string>")
    return F.when(c.isNull() | (F.lit(blank_is_empty) & (c == "")), none).otherwise(F.array(c))


def has_text(arr: Column) -> Column:
    """Whether some element has more than white space."""
    return F.coalesce(F.exists(arr, lambda x: F.coalesce(F.length(strip(x)) > 0, F.lit(False))), F.lit(False))


def distinct_in_order(arr: Column) -> Column:
    return F.array_distinct(arr)


def kept_members(arr: Column, allowed: Column) -> Column:
    """Elements of ``arr`` that ``allowed`` has, in order and with repeats. Null arrays count as empty."""
    return F.filter(F.coalesce(arr, F.array().cast("array<string>")), lambda x: F.array_contains(F.coalesce(allowed, F.array().cast("array<string>")), x))


def size_or_zero(arr: Column) -> Column:
    return F.when(arr.isNull(), 0).otherwise(F.size(arr))


def prefixed(arr: Column, category: Column) -> Column:
    """category/x for each element that is neither null nor ''."""
    return F.transform(F.filter(arr, lambda x: x.isNotNull() & (x != "")), lambda x: F.concat(category, F.lit("/"), x))


def category_and_file(c: Column) -> Column:
    """[category, file] of category/file; the file may hold further slashes."""
    return F.split(c, "/", 2)


def hash_number(c: Column, buckets: int) -> Column:
    """0 .. buckets-1 from the md5 of a string: the same in every engine and process."""
    return F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint"), F.lit(buckets).cast("bigint"))


def page_target(name: Column, seed: Column, pages: int = 4) -> Column:
    """{stem}_{i}{ending} with i from the seed."""
    ending = F.regexp_extract(basename(name), r"(\.[^.]*)$", 1)
    return F.concat(file_stem(name), F.lit("_"), hash_number(seed, pages).cast("string"), ending)


#: Page formats as (name, short side, long side) in points, in order of precedence.
PAGE_FORMATS = (("A4", 595, 842), ("Letter", 612, 792), ("Legal", 612, 1008), ("A3", 842, 1191), ("A5", 420, 595), ("Tabloid", 792, 1224), ("Executive", 522, 756))


def short_and_long(width: Column, height: Column) -> tuple[Column, Column]:
    w, h = F.round(width).cast("int"), F.round(height).cast("int")
    return F.least(w, h), F.greatest(w, h)


def page_format(short: Column, long: Column, tolerance: int = 2) -> Column:
    """The first format within the tolerance on both sides, else Other (short x long)."""
    out = F.concat(F.lit("Other ("), short.cast("string"), F.lit("x"), long.cast("string"), F.lit(")"))
    for name, s, n in reversed(PAGE_FORMATS):
        out = F.when((F.abs(short - s) <= tolerance) & (F.abs(long - n) <= tolerance), name).otherwise(out)
    return out


def page_count_group(n: Column) -> Column:
    return F.when(n <= 10, "<=10").when(n <= 20, "11-20").otherwise(">20")


def answer_json(c: Column, schema: str) -> Column:
    """A model's answer: tags removed, from the first { to the last } parsed; null where that is no JSON."""
    bare = F.regexp_replace(c, r"</?answer>", "")
    return F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")), schema)


def short_theme(c: Column, limit: int = 200) -> Column:
    return F.substring(strip(c), 1, limit)


def numbered_lines(arr: Column, limit: int) -> Column:
    """The first elements as lines "1. x"."""
    return F.array_join(F.transform(F.slice(arr, 1, limit), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def wrapped_query(c: Column, token: str, times: int = 10, prefix: str = "Query: ", end: str = "") -> Column:
    """Prefix, query and the augmentation token repeated."""
    return F.concat(F.lit(prefix), c, F.repeat(F.lit(token), F.lit(times)), F.lit(end))


def patch_grid(width: Column, height: Column, patch: int, merge: int = 1) -> tuple[Column, Column]:
    """Patches along each side."""
    return F.floor(F.floor(width / patch) / merge).cast("int"), F.floor(F.floor(height / patch) / merge).cast("int")


def resized_grid(width: Column, height: Column, patch: int = 14, merge: int = 2, min_pixels: int = 3136, max_pixels: int = 602_112) -> tuple[Column, Column]:
    """Patches of a picture that is first brought to sides divisible by ``patch * merge`` and to an area between the bounds, then merged.

    Sides are rounded (half to even) to the nearest multiple, at least one; where the area then lies outside, both shrink or grow by the
    square root of the ratio of areas, down or up to a multiple.
    """
    unit, area = float(patch * merge), width.cast("double") * height
    near = [F.greatest(F.lit(unit), F.bround(c / unit) * unit) for c in (width, height)]
    shrink, grow = F.sqrt(area / float(max_pixels)), F.sqrt(F.lit(float(min_pixels)) / area)
    less = [F.greatest(F.lit(unit), F.floor(c / shrink / unit) * unit) for c in (width, height)]
    more = [F.ceil(c * grow / unit) * unit for c in (width, height)]
    now = near[0] * near[1]
    return tuple(F.floor(F.when(now > max_pixels, s).when(now < min_pixels, m).otherwise(n) / unit).cast("int") for n, s, m in zip(near, less, more, strict=True))


def padded_to_ratio(width: Column, height: Column, ratio_w: int = 612, ratio_h: int = 792) -> tuple[Column, Column]:
    """The smallest size of the given ratio that holds the picture."""
    wide = width * ratio_h > height * ratio_w
    return F.when(wide, width).otherwise(F.round(height * ratio_w / ratio_h).cast("int")), F.when(wide, F.round(width * ratio_h / ratio_w).cast("int")).otherwise(height)


def parsed_size(c: Column) -> tuple[Column, Column]:
    """Width and height of "WxH" in any case."""
    parts = F.split(F.lower(c), "x")
    return F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")


def log_number(c: Column) -> Column:
    """Scientific below 1e-3 and from 1e4, else plain, with six decimals."""
    small = (c != 0) & ((F.abs(c) < 1e-3) | (F.abs(c) >= 1e4))
    return F.when(small, F.format_string("%.6e", c)).otherwise(F.format_string("%.6f", c))
