"""Connected groups by minimum-label propagation over a bipartite graph of records and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagewright.session import cut, drop


def min_labels(ties: DataFrame, record: str = "record", entity: str = "entity") -> DataFrame:
    """(record, label): the smallest record reachable from each record over shared entities. ``ties`` has a row per record and entity.

    Each round an entity takes the smallest label among its records, and every label the smallest of its entities'; labels are then
    followed twice more, which shortens long chains. Records of one label move together, so the graph kept is that of labels and
    entities: it shrinks by the round, and entities with one label left are dropped. Rounds end when none is left. A hot entity or label
    is one row after the partial aggregate, and joins that bring values back have one row per key on one side. Lineage is cut each round;
    what becomes of the records' labels is the chain of the rounds' tables.
    Rows with a null record or entity tie nothing; entities of a single record neither. Empty input gives no rows.
    """
    ties = ties.select(F.col(record).alias("l"), F.col(entity).alias("e")).where("l is not null and e is not null")
    active, left = _shared(ties.distinct())
    labels, first = active.select(F.col("l").alias("r"), "l").distinct(), active
    while left:
        hook = active.groupBy("l").agg(F.min("m").alias("h"))
        for _ in range(2):
            onward = hook.select(F.col("l").alias("h"), F.col("h").alias("h2"))
            hook = hook.join(onward, "h", "left").select("l", F.coalesce("h2", "h").alias("h"))
        hook = cut(hook)
        labels = labels.join(hook, "l", "left").select("r", F.coalesce("h", "l").alias("l"))
        before = active
        active, left = _shared(active.join(hook, "l").select(F.col("h").alias("l"), "e").distinct())
        if before is not first:
            drop(before)
    return labels.select(F.col("r").alias(record), F.col("l").alias("label"))


def _shared(graph: DataFrame) -> tuple[DataFrame, int]:
    """The rows (l, e) of entities that have more than one label, with the smallest label m of each; written. And how many there are."""
    shared = graph.groupBy("e").agg(F.min("l").alias("m"), F.max("l").alias("x")).where("m < x").select("e", "m")
    seen = Observation()
    active = cut(graph.join(shared, "e").observe(seen, F.count(F.lit(1)).alias("n")))
    return active, seen.get["n"]
