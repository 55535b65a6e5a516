"""Training batches as long tables: examples, document columns and who is positive for whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.sampling import some_of_each


def single_positive(examples: DataFrame, batch: str, query: str, targets: str, seed: int = 42) -> DataFrame:
    """(batch, query, doc): one target per example. An example without targets has a null doc."""
    return examples.select(batch, query, F.get(some_of_each(examples, targets, query, 1, "random", seed), F.lit(0)).alias("doc"))


def multi_positive_mask(examples: DataFrame, batch: str, query: str, targets: str, limit: int, strategy: str = "all", seed: int = 42) -> DataFrame:
    """(batch, query, column, doc, is_positive): every example's targets are columns of its batch, repeats as columns of their own; an example is positive only for its own columns.

    Batches are of bounded size (a setting of the trainer), so their windows are.
    """
    chosen = examples.select(batch, query, F.posexplode(some_of_each(examples, targets, query, limit, strategy, seed)).alias("p", "doc"))
    columns = chosen.withColumn("column", F.row_number().over(Window.partitionBy(batch).orderBy(query, "p")) - 1).select(batch, F.col(query).alias("owner"), "column", "doc")
    return examples.select(batch, query).join(columns, batch).select(batch, query, "column", "doc", (F.col(query) == F.col("owner")).alias("is_positive"))


def shared_positive_mask(examples: DataFrame, batch: str, query: str, targets: str, limit: int, strategy: str = "all", seed: int = 42) -> DataFrame:
    """(batch, query, column, doc, is_positive): a document is one column of a batch, positive for all examples that have it."""
    chosen = examples.select(batch, query, F.posexplode(some_of_each(examples, targets, query, limit, strategy, seed)).alias("p", "doc"))
    first = chosen.groupBy(batch, "doc").agg(F.min(F.struct(query, "p")).alias("at"))
    columns = first.withColumn("column", F.row_number().over(Window.partitionBy(batch).orderBy("at")) - 1).select(batch, "column", "doc")
    positive = chosen.select(batch, query, "doc").distinct().withColumn("is_positive", F.lit(True))
    grid = examples.select(batch, query).join(columns, batch)
    return grid.join(positive, [batch, query, "doc"], "left").select(batch, query, "column", "doc", F.coalesce("is_positive", F.lit(False)).alias("is_positive"))


def routed(items: DataFrame, batch: str, order: str, kind: Column, known: tuple[str, ...] = ("text", "image")) -> DataFrame:
    """``items`` with ``route``: the kind of the first item of their batch, by which all of it is processed. A kind that is not known raises.

    Null kinds count as not known. Batches may be of any size: the first item is an aggregate, not a window.
    """
    first = items.groupBy(batch).agg(F.min_by(kind, order).alias("__kind"))
    checked = F.when(F.col("__kind").isin(*known), F.col("__kind")).otherwise(F.raise_error(F.concat(F.lit("unsupported kind of batch: "), F.coalesce("__kind", F.lit("none")))))
    return items.join(first.select(batch, checked.alias("route")), batch)
