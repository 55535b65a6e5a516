"""All similar pairs of set-valued records: size-aware overlap join.

A pair of sets with a and b members (a <= b) overlaps by at least p/q exactly if it shares c(a, b) members. Where b is small, every
subset of c(a, b) members is written out under the key (a, b, subset) and equal keys are joined: each match is a result, so the work is
that of the result. Where b is large, the inverted lists of the sets' members are scanned instead, rare members first and hot lists
split (``setjoin``). The union is filtered by the final similarity. Equal sets are one row until the very end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm import setjoin

SMALL_SET = 6


def _subset_pairs(sets: DataFrame, ratio: setjoin.Ratio, sides: tuple[str, str] | None, small: int) -> DataFrame:
    p, q = ratio
    carry = list(sides or ())
    need = {(a, b): -(-p * (a + b) // (p + q)) for a in range(1, small + 1) for b in range(a, small + 1) if a * q >= b * p}
    plans = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"), F.lit(c).alias("c")) for (a, b), c in need.items()])
    own = sets.withColumn("size", F.size("toks")).where(F.col("size") <= small)
    planned = own.select("*", F.explode(F.filter(plans, lambda x: (x.lo == F.col("size")) | (x.hi == F.col("size")))).alias("w")).select("set_id", "toks", "size", *carry, "w.lo", "w.hi", "w.c")
    masks = F.filter(F.sequence(F.lit(1), F.lit((1 << small) - 1)), lambda m: (F.bit_count(m) == F.col("c")) & (m < F.pow(F.lit(2), F.col("size"))))
    subset = F.explode(F.transform(masks, lambda m: F.xxhash64(F.concat_ws(",", F.transform(F.filter("toks", lambda t, i: F.getbit(m, i) == 1), lambda t: t.cast("string"))))))
    keyed = planned.select("*", subset.alias("subset"))
    a, b = keyed.where("size = lo").alias("a"), keyed.where("size = hi").alias("b")
    on = (F.col("a.subset") == F.col("b.subset")) & (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi"))
    met = a.join(b, on & ((F.col("a.size") < F.col("b.size")) | (F.col("a.set_id") < F.col("b.set_id"))))
    if sides:
        left, right = sides
        met = met.where((F.col(f"a.{left}") & F.col(f"b.{right}")) | (F.col(f"a.{right}") & F.col(f"b.{left}")))
    # a pair shares several subsets where it shares more than c members: it counts in that of the first c
    both = met.withColumn("both", F.array_sort(F.array_intersect("a.toks", "b.toks")))
    first = F.xxhash64(F.concat_ws(",", F.transform(F.slice("both", F.lit(1), F.col("a.c")), lambda t: t.cast("string"))))
    kept = both.where(first == F.col("a.subset"))
    return kept.select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b"), F.size("both").alias("common"), F.col("a.size").alias("size_a"), F.col("b.size").alias("size_b"))


def overlap(common: Column, size_a: Column, size_b: Column) -> Column:
    return common / (size_a + size_b - common)


def similar_classes(sets: DataFrame, ratio: setjoin.Ratio, sides: tuple[str, str] | None = None, small: int = SMALL_SET, **kw) -> DataFrame:
    """(a, b, common, size_a, size_b): pairs of distinct sets that overlap by at least ``ratio``."""
    p, q = ratio
    large = setjoin.similar_sets(sets, ratio, sides, larger_than=small, **kw)
    found = _subset_pairs(sets, ratio, sides, small).unionByName(large)
    return found.where(F.col("common") * (p + q) >= (F.col("size_a") + F.col("size_b")) * p)


def _classed(records: DataFrame, across: bool) -> tuple[DataFrame, DataFrame, tuple[str, str] | None]:
    """Membership and distinct sets, and the names of the sides' columns."""
    if not across:
        return *setjoin.classes(records, "id", "members", ("name",)), None
    return *setjoin.classes(records, "id", "members", ("name", "side"), {"has_left": F.col("side"), "has_right": ~F.col("side")}), ("has_left", "has_right")


def similar_records(records: DataFrame, ratio: setjoin.Ratio, across: bool, small: int = SMALL_SET, **kw) -> DataFrame:
    """(id_a, id_b, overlap) with id_a < id_b: pairs of records with different names whose sets overlap by at least ``ratio``.

    ``records``: id (unique integer), name, members (array of strings or integers), and, for ``across``, side (boolean). With ``across``
    only pairs with one record of each side are given. A null name differs from every other name but equals another null. Null members
    are ignored; null and empty sets are in no pair. Records with equal sets are paired here at the end, chunk by chunk, not in the join.
    """
    member, sets, sides = _classed(records, across)
    pairs = similar_classes(sets, ratio, sides, small, **kw).select("a", "b", overlap(F.col("common"), F.col("size_a"), F.col("size_b")).alias("overlap"))
    same = sets.where("n > 1").select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.lit(1.0).alias("overlap"))
    x, y = (member.select(F.col("set_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in member.columns if c != "set_id"]) for s in "ab")
    wide = setjoin.with_copies(pairs.unionByName(same), x, y)
    wide = wide.where(~F.col("name_a").eqNullSafe(F.col("name_b")) & ((F.col("a") != F.col("b")) | (F.col("id_a") < F.col("id_b"))))
    if across:
        wide = wide.where(F.col("side_a") != F.col("side_b"))
    return wide.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "overlap")


def linked_records(records: DataFrame, ratio: setjoin.Ratio, across: bool, small: int = SMALL_SET, **kw) -> DataFrame:
    """(id, class_id, n_links): the compact form of ``similar_records``, one row for each record with a set.

    Records with equal sets are one class, named by its smallest id; ``n_links`` is the number of other classes that are similar (with
    ``across``: of which one has a record on the side that the other lacks or shares). Names play no part.
    """
    member, sets, sides = _classed(records, across)
    pairs = similar_classes(sets, ratio, sides, small, **kw)
    links = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).groupBy("set_id").agg(F.count("*").alias("n_links"))
    counted = sets.select("set_id").join(links, "set_id", "left").select("set_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return member.join(counted, "set_id").select("id", F.col("set_id").alias("class_id"), "n_links")
