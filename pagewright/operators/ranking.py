"""Precision, recall, MRR and NDCG at K from ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.vectors import rank_discount

KS = (1, 3, 5, 10)


def deduplicated(results: DataFrame, query: str, doc: str, rank: str = "rank") -> DataFrame:
    """Each document of a list at its first place, ranks closed up from 0."""
    first = results.groupBy(query, doc).agg(F.min(rank).alias("at"))
    return first.select(query, doc, (F.row_number().over(Window.partitionBy(query).orderBy("at", doc)) - 1).cast("int").alias("rank"))


def ideal_dcg(n: Column, k: Column) -> Column:
    """Of min(n, k) hits on top."""
    m = F.least(n, k).cast("int")
    return F.when(m > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(m, F.lit(1)) - 1), F.lit(0.0), lambda s, i: s + rank_discount(i))).otherwise(0.0)


def query_metrics(
    results: DataFrame, truth: DataFrame, query: str, doc: str, ks: tuple[int, ...] = KS, queries: DataFrame | None = None, page_docs: DataFrame | None = None, groups: tuple[str, ...] = ()
) -> DataFrame:
    """(groups, query, k, precision, recall, mrr, ndcg) from ``results`` (groups, query, doc, rank from 0, no repeats) and ``truth`` (groups, query, doc).

    Queries: those of ``queries``, or all that have a truth. A query without a truth or without results scores 0 throughout. Precision
    divides by K even where fewer documents came. ``page_docs`` (page, document): results are pages; a document counts at its first page.
    """
    keys = [*groups, query]
    truth = truth.select(*keys, doc).distinct()
    n_truth = truth.groupBy(*keys).agg(F.count("*").alias("n_truth"))
    if page_docs is not None:
        results = results.withColumnRenamed(doc, "page").join(page_docs.withColumnRenamed("document", doc), "page", "left").withColumn(doc, F.coalesce(doc, "page"))
    hit = results.join(truth.withColumn("is_hit", F.lit(True)), [*keys, doc], "left").where("is_hit")
    if page_docs is not None:
        hit = hit.groupBy(*keys, doc).agg(F.min("rank").alias("rank"))
    per_k = hit.select(*keys, "rank", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where(F.col("rank") < F.col("k"))
    sums = per_k.groupBy(*keys, "k").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(rank_discount(F.col("rank"))).alias("dcg"))
    asked = (queries if queries is not None else n_truth).select(*keys).distinct().join(n_truth, keys, "left").withColumn("n_truth", F.coalesce("n_truth", F.lit(0)))
    grid = asked.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).join(sums, [*keys, "k"], "left")
    hits, ideal = F.coalesce("hits", F.lit(0)), ideal_dcg(F.col("n_truth"), F.col("k"))
    zero = F.lit(0.0)
    return grid.select(
        *keys,
        "k",
        (hits / F.col("k")).alias("precision"),
        F.when(F.col("n_truth") > 0, hits / F.col("n_truth")).otherwise(zero).alias("recall"),
        F.coalesce(F.lit(1.0) / (F.col("first") + 1), zero).alias("mrr"),
        F.when(ideal > 0, F.coalesce("dcg", zero) / ideal).otherwise(zero).alias("ndcg"),
    )


def mean_metrics(per_query: DataFrame, by: tuple[str, ...] = ("k",)) -> DataFrame:
    """Macro means over queries, to 4 decimals."""
    return per_query.groupBy(*by).agg(*[F.round(F.avg(m), 4).alias(m) for m in ("precision", "recall", "mrr", "ndcg")])
