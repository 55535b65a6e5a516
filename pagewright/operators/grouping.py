"""Groups of texts that share k clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import cut


def similar_groups(texts: DataFrame, ks: list[int], low: int = 3, high: int = 5, name: str = "text_name", ids: str = "cluster_ids", order: str = "record_id") -> DataFrame:
    """(k, cluster_ids, text_names): for each k the sets of ``low`` to ``high`` texts that share k clusters.

    Combinations are k of a text's distinct clusters, or all of them where it has fewer. A text is in a group if it has all of the
    combination. Of several combinations with the same texts the one met first stays: by the text's order, then by cluster ids.

    Level-wise: combinations of k + 1 are grown only from combinations of k that enough texts share, since no larger one can be shared
    by more. So the number of rows follows what is shared and not the number of combinations. Rows of one name are one text (clusters
    united, first order). Null clusters, null and empty lists make no group.
    """
    one = texts.where(F.col(name).isNotNull()).select(name, order, F.filter(F.coalesce(ids, F.array().cast("array<int>")), lambda x: x.isNotNull()).alias("c"))
    text = one.groupBy(name).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("c"), F.min(order).alias("o")).where(F.size("c") > 0)
    text = cut(text.withColumn("n", F.size("c")))
    rows = text.select(F.col(name).alias("t"), "o", "c", "n", F.explode(F.transform("c", lambda x, i: F.struct(F.array(x).alias("combo"), i.alias("last")))).alias("x")).select("t", "o", "c", "n", "x.combo", "x.last")
    top, out, whole = max(ks), None, None
    for k in range(1, top + 1):
        support = rows.groupBy("combo").agg(F.count("*").alias("support")).where(F.col("support") >= low)
        rows = cut(rows.join(support, "combo"))
        fits = rows.where(F.col("support") <= high)
        # combinations that are all clusters of a text with fewer than some later k
        full = fits.groupBy("combo").agg(F.min(F.when(F.col("n") == k, F.col("o"))).alias("first"), F.array_sort(F.collect_list("t")).alias("text_names")).where("first is not null")
        if k in ks:
            met = fits.groupBy("combo").agg(F.min("o").alias("first"), F.array_sort(F.collect_list("t")).alias("text_names"))
            met = met if whole is None else met.unionByName(whole)
            best = met.groupBy("text_names").agg(F.min(F.struct("first", "combo")).alias("b")).select(F.lit(k).alias("k"), F.col("b.combo").alias("cluster_ids"), "text_names")
            out = best if out is None else out.unionByName(best)
        whole = full if whole is None else whole.unionByName(full)
        if k < top:
            ahead = F.sequence(F.col("last") + 1, F.col("n") - 1)
            grown = F.explode(F.transform(ahead, lambda i: F.struct(F.array_append("combo", F.get("c", i)).alias("combo"), i.alias("last"))))
            rows = rows.where(F.col("last") + 1 < F.col("n")).select("t", "o", "c", "n", grown.alias("x")).select("t", "o", "c", "n", "x.combo", "x.last")
    return out


def all_groups(texts: DataFrame, ks: list[int], **kw) -> DataFrame:
    """(cluster_ids, text_names): groups of all k, each combination and set of texts once."""
    return similar_groups(texts, ks, **kw).select("cluster_ids", "text_names").distinct()


def co_members(texts: DataFrame, wanted: DataFrame, name: str = "text_name", ids: str = "cluster_ids") -> DataFrame:
    """(combo, text): texts that have every cluster of a wanted combination (relational division)."""
    have = texts.select(F.col(name).alias("text"), F.explode(F.array_distinct(ids)).alias("c")).where("c is not null").distinct()
    need = wanted.select("combo", F.explode(F.array_distinct("combo")).alias("c"))
    return need.join(have, "c").groupBy("combo", "text").agg(F.count("*").alias("n")).where(F.col("n") == F.size(F.array_distinct("combo"))).select("combo", "text")


def cluster_count(n: int, low: int = 2, high: int = 100) -> int:
    """k of k-means for n values."""
    return min(int(min(max(n**0.5, low), high)), n)
