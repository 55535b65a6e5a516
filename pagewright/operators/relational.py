"""Joins, inversions and counts over record tables.

List columns are exploded before work and collected only where the result is a list. Inputs are never collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.scalars import strip


def last_wins(df: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    """One row per key with the values of its last row by ``order``."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v")).select(*keys, "v.*")


def first_wins(df: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    """One row per key with the values of its first row by ``order``."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("v")).select(*keys, "v.*")


def without_blank(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` has more than white space."""
    return df.where(F.length(strip(F.col(column))) > 0)


def exactly_once(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value occurs once in the table; of repeated values no row stays. Null is a value."""
    once = df.groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n")).where("__n = 1")
    return df.join(once, F.col(column).eqNullSafe(F.col("__v")), "left_semi")


def inverted(df: DataFrame, value: str, members: str, order: str, member: str = "member", values: str = "vals") -> DataFrame:
    """(member, vals): for each element of the lists the values of the rows that name it, in order, as often as they do."""
    rows = df.select(F.col(order).alias("o"), F.col(value).alias("v"), F.posexplode(members).alias("p", member)).where(F.col(member).isNotNull())
    return rows.groupBy(member).agg(F.array_sort(F.collect_list(F.struct("o", "p", "v"))).alias("x")).select(member, F.col("x.v").alias(values))


def attached(df: DataFrame, key: str, lists: DataFrame, member: str = "member", values: str = "vals") -> DataFrame:
    """``df`` with the list of its key, or an empty list."""
    out = df.join(lists, df[key] == lists[member], "left").drop(member)
    return out.withColumn(values, F.coalesce(values, F.array().cast(lists.schema[values].dataType)))


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def or_itself(df: DataFrame, key: str, mapping: DataFrame, source: str, target: str, out: str) -> DataFrame:
    """``df`` with ``out``: what ``mapping`` (source, target) gives for the key, else the key."""
    m = mapping.select(F.col(source).alias("__s"), F.col(target).alias("__t"))
    return df.join(m, df[key] == F.col("__s"), "left").withColumn(out, F.coalesce("__t", key)).drop("__s", "__t")


def materialised(df: DataFrame, key: str, ids: str, corpus: DataFrame, corpus_key: str, value: str, out: str = "docs") -> DataFrame:
    """(key, out): the corpus values of a row's ids, in order; unknown ids are left out and rows without any are kept as []."""
    rows = df.select(key, F.posexplode(ids).alias("p", "__id"))
    met = rows.join(corpus.select(F.col(corpus_key).alias("__id"), F.col(value).alias("v")), "__id")
    lists = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("x")).select(key, F.col("x.v").alias(out))
    return df.select(key).join(lists, key, "left").withColumn(out, F.coalesce(out, F.array().cast(lists.schema[out].dataType)))


def histogram(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """(name, n, percent): counts of values with one decimal of percent. An empty table has no rows."""
    total = float(df.count())
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n")).select(name, "n", F.round(F.col("n") * 100.0 / F.lit(total), 1).alias("percent"))


def keyword_clusters(texts: DataFrame, clusters: DataFrame, key: str, keywords: str = "keywords") -> DataFrame:
    """(key, cluster_ids): distinct sorted clusters of a text's keywords. A keyword of several clusters belongs to the last; texts without any keep []."""
    of = clusters.select("cluster_id", F.explode("keywords").alias("k")).groupBy("k").agg(F.max("cluster_id").alias("cluster_id"))
    met = texts.select(key, F.explode(F.array_distinct(keywords)).alias("k")).join(of, "k").groupBy(key).agg(F.array_sort(F.collect_set("cluster_id")).alias("cluster_ids"))
    return texts.select(key).join(met, key, "left").withColumn("cluster_ids", F.coalesce("cluster_ids", F.array().cast("array<int>")))


def merged_groups(old: DataFrame, new: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Old and new rows without repeats of ``columns``; of repeats the first stays, old before new."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    return both.groupBy(*columns).agg(F.min(F.struct("__age", order)).alias("__first")).select(*columns, F.col("__first")[order].alias(order))


def pivoted(df: DataFrame, by: str, column: str, values: list[str], value: str) -> DataFrame:
    """A row per ``by`` and a column per value."""
    return df.groupBy(by).pivot(column, values).agg(F.first(value))


def excess(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(n_changed): rows whose two arrays differ in size."""
    return df.agg(F.coalesce(F.sum((F.size(a) != F.size(b)).cast("int")), F.lit(0)).alias("n_changed"))


def ranked_within(by: list[str], *order: Column) -> Column:
    """Place from 1 within a key; for keys of bounded size. For whole tables see ``sampling.global_rank``."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
