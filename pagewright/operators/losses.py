"""Contrastive and listwise losses as aggregates over score rows (q, d, s) and positives (q, d).

A batch is a table of score rows; a ``batch`` column is not needed since all is grouped by query. Results are one row (loss).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.vectors import rank_discount, softplus


def normalised_scores(scores: DataFrame, lengths: DataFrame, tolerances: tuple[float, ...] = (1e-3, 0.1), strict: bool = False) -> DataFrame:
    """Scores by query length; if any lies outside [-t, 1 + t] for all tolerances they stay as they are (``strict``: an error is raised)."""
    by = scores.join(lengths, "q").withColumn("n", F.col("s") / F.col("len"))
    ends = by.agg(F.min("n"), F.max("n")).first()
    t = max(tolerances if not strict else tolerances[:1])
    fits = ends[0] is None or (ends[0] >= -t and ends[1] <= 1 + t)
    if not fits and strict:
        raise ValueError(f"normalised scores reach from {ends[0]} to {ends[1]}")
    return by.select("q", "d", (F.col("n") if fits else F.col("s")).alias("s"))


def damped_negatives(scores: DataFrame, positives: DataFrame, threshold: float = 0.95, factor: float = 0.5) -> DataFrame:
    """Scores of non-positives above ``threshold`` times the query's positive score, times ``factor``."""
    pos = scores.join(positives, ["q", "d"]).select("q", F.col("d").alias("pd"), F.col("s").alias("ps"))
    high = (F.col("d") != F.col("pd")) & (F.col("s") > threshold * F.col("ps"))
    return scores.join(pos, "q").select("q", "d", F.when(high, F.col("s") * factor).otherwise(F.col("s")).alias("s"))


def log_sum_exp(df: DataFrame, keys: list[str], value: Column, name: str = "lse") -> DataFrame:
    """(keys, name) without overflow."""
    v = df.withColumn("__v", value)
    top = v.groupBy(*keys).agg(F.max("__v").alias("__top"))
    return v.join(top, keys).groupBy(*keys).agg((F.first("__top") + F.log(F.sum(F.exp(F.col("__v") - F.col("__top"))))).alias(name))


def _mean(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.avg(value).alias("loss"))


def info_nce(scores: DataFrame, positives: DataFrame, temperature: float = 0.02) -> DataFrame:
    """Mean of lse(s / T) - s_pos / T."""
    whole = log_sum_exp(scores, ["q"], F.col("s") / temperature)
    pos = scores.join(positives, ["q", "d"]).select("q", (F.col("s") / temperature).alias("p"))
    return _mean(whole.join(pos, "q"), F.col("lse") - F.col("p"))


def explicit_negatives(scores: DataFrame, positives: DataFrame, negatives: DataFrame, temperature: float = 0.02) -> DataFrame:
    """Mean of softplus((s_neg - s_pos) / T)."""
    pos = scores.join(positives, ["q", "d"]).select("q", F.col("s").alias("p"))
    neg = scores.join(negatives, ["q", "d"]).select("q", F.col("s").alias("n"))
    return _mean(pos.join(neg, "q"), softplus((F.col("n") - F.col("p")) / temperature))


def pairwise(scores: DataFrame, positives: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Mean of softplus((hardest - s_pos) / T); the hardest is the best score, or the second where the best equals the positive's."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), "d"))
    two = scores.withColumn("r", place).where("r <= 2").groupBy("q").agg(F.max(F.when(F.col("r") == 1, F.col("s"))).alias("s1"), F.max(F.when(F.col("r") == 2, F.col("s"))).alias("s2"))
    pos = scores.join(positives, ["q", "d"]).select("q", F.col("s").alias("p"))
    hardest = F.when(F.col("s1") == F.col("p"), F.col("s2")).otherwise(F.col("s1"))
    return _mean(two.join(pos, "q"), softplus((hardest - F.col("p")) / temperature))


def _weighted_sum(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    rows = [p.select((F.col("loss") * w).alias("loss")) for p, w in parts]
    return reduce(DataFrame.unionByName, rows).agg(F.sum("loss").alias("loss"))


def weighted(a: DataFrame, b: DataFrame, weight_b: float) -> DataFrame:
    """(1 - w) a + w b of two losses of one row."""
    return _weighted_sum([(a, 1 - weight_b), (b, weight_b)])


def multi_positive(scores: DataFrame, positives: DataFrame, temperature: float = 0.02) -> DataFrame:
    """Sum of lse(all) - lse(positives) over queries with a positive, divided by the number of all queries."""
    whole = log_sum_exp(scores, ["q"], F.col("s") / temperature)
    pos = log_sum_exp(scores.join(positives.distinct(), ["q", "d"]), ["q"], F.col("s") / temperature, "pos")
    return whole.join(pos, "q", "left").agg((F.sum(F.coalesce(F.col("lse") - F.col("pos"), F.lit(0.0))) / F.count("*")).alias("loss"))


def _top_labels(scores: DataFrame, positives: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), "d")) - 1
    labelled = scores.join(positives.distinct().withColumn("y", F.lit(1)), ["q", "d"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    return labelled.withColumn("r", place).where(F.col("r") < k)


def listwise_ndcg(scores: DataFrame, positives: DataFrame, k: int = 10) -> DataFrame:
    """Mean over all queries of 1 - DCG / IDCG with the labels of the k best; the ideal is of these labels only, 0 where there are none."""
    top = _top_labels(scores, positives, k)
    per = top.groupBy("q").agg(F.sum(F.col("y") * rank_discount(F.col("r"))).alias("dcg"), F.sum("y").cast("int").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(0), F.greatest(F.col("n"), F.lit(1)) - 1), F.lit(0.0), lambda s, i: s + rank_discount(i))
    return _mean(per, F.when(F.col("n") > 0, 1 - F.col("dcg") / ideal).otherwise(0.0))


def listwise_mle(scores: DataFrame, positives: DataFrame, k: int = 10, temperature: float = 1.0) -> DataFrame:
    """Mean over all queries of the sum over positives among the k best, in score order, of -log(softmax of it and those after it + 1e-8)."""
    top = _top_labels(scores, positives, k).withColumn("v", F.col("s") / temperature)
    after = F.sum(F.exp("v")).over(Window.partitionBy("q").orderBy(F.col("r")).rowsBetween(0, Window.unboundedFollowing))
    each = top.where("y = 1").withColumn("part", -F.log(F.exp("v") / after + 1e-8)).groupBy("q").agg(F.sum("part").alias("part"))
    return _mean(scores.select("q").distinct().join(each, "q", "left"), F.coalesce("part", F.lit(0.0)))


def combined(scores: DataFrame, positives: DataFrame, step: int, weight: float = 1.0, list_weight: float = 0.1, every: int = 5, k: int = 10, temperature: float = 0.02) -> DataFrame:
    """weight x multi-positive, and in every ``every``-th step beyond 200 plus list_weight x listwise NDCG."""
    a = multi_positive(scores, positives, temperature)
    if step % every or step <= 200:
        return _weighted_sum([(a, weight)])
    return _weighted_sum([(a, weight), (listwise_ndcg(scores, positives, k), list_weight)])


#: Losses by name, for jobs that take theirs from a setting.
BY_NAME = {"info_nce": info_nce, "pairwise": pairwise, "multi_positive": multi_positive, "listwise_ndcg": listwise_ndcg, "listwise_mle": listwise_mle}
