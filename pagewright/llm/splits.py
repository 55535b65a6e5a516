"""Splits that keep related records together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import text as tx
from pagewright.llm import graph
from pagewright.operators.sampling import global_rank
from pagewright.session import cut

#: So many labels, the most frequent ones, are balanced each by itself. With more, each of the rest has less than 1 / LABELS of the records; those are balanced as one.
LABELS = 1000
#: So many label profiles, those of the largest and then the most groups, are placed exactly. Groups with rarer ones, if there are any, are hashed to REST_UNITS units.
PROFILES, REST_UNITS = 100_000, 1024


def related_groups(df: DataFrame, key: str, entities: str, text: str) -> DataFrame:
    """(group_id, key): records connected through a shared entity stem or the same normalised text; group_id is the smallest key.

    One row for each record of a group of two or more. Null and blank entities and texts without words tie nothing. Repeated entities
    of a record count once. ``key`` must be a unique integer.
    """
    by_entity = df.select(F.col(key).alias("record"), F.explode(tx.stem_set(F.col(entities))).alias("e")).select("record", F.xxhash64(F.lit("entity"), "e").alias("entity"))
    by_text = df.select(F.col(key).alias("record"), tx.norm(F.col(text)).alias("e")).where("e <> ''").select("record", F.xxhash64(F.lit("text"), "e").alias("entity"))
    return graph.min_labels(by_entity.unionByName(by_text)).select(F.col("label").alias("group_id"), F.col("record").alias(key))


def place(profiles: list[tuple[list[int], list[int]]], groups: list[int], fractions: np.ndarray, labels: int) -> np.ndarray:
    """(profiles x splits): how many groups of each profile each split gets.

    A profile is the labels and their counts that all its groups have alike. Largest groups go first. m groups are shared out in
    proportion to what the splits still lack of their labels, in whole groups; the few left go one by one to where the labels then deviate least.
    """
    sizes = np.array([sum(c) for _, c in profiles], dtype=float)
    totals = np.zeros(labels)
    for (at, n), m in zip(profiles, groups, strict=True):
        totals[at] += np.array(n) * m
    wanted = fractions[:, None] * totals[None, :]
    gap, overall = -wanted, -wanted.sum(axis=1)  # held less wanted
    out = np.zeros((len(profiles), len(fractions)), np.int64)
    for u in np.lexsort((np.arange(len(profiles)), -sizes)):
        at, n = np.array(profiles[u][0]), np.array(profiles[u][1], dtype=float)
        lack = np.maximum(-(gap[:, at] @ n), 0.0)
        share = lack / lack.sum() if lack.any() else fractions
        out[u] = np.floor(share * groups[u] + 1e-9)
        gap[:, at] += out[u][:, None] * n[None, :]
        overall += out[u] * sizes[u]
        for _ in range(groups[u] - int(out[u].sum())):
            change = (np.abs(gap[:, at] + n) - np.abs(gap[:, at])).sum(axis=1)
            k = np.lexsort((np.arange(len(fractions)), overall, change))[0]
            out[u, k] += 1
            gap[k, at] += n
            overall[k] += sizes[u]
    return out


def grouped_split(df: DataFrame, key: str, groups: DataFrame, label: Column, targets: DataFrame) -> DataFrame:
    """(key, group_id, split_name) for every row of ``df``: groups stay whole, proportions follow ``targets`` (split_name, fraction) by label.

    ``groups`` is (group_id, key); records without a row there are groups of their own. Groups with equal label counts have one profile and
    stand for each other: how many of them each split gets is reckoned on the driver, from at most PROFILES profiles, and groups take their
    split by their place within the profile. Null and empty labels are one label. With one group, all is in one split.
    """
    goals = sorted((r["split_name"], float(r["fraction"])) for r in targets.select("split_name", "fraction").collect())  # a fixed small table
    if not goals or len(goals) > 1000:
        raise ValueError("targets must have 1 to 1000 rows")
    fractions = np.array([f for _, f in goals]) / sum(f for _, f in goals)
    spark = df.sparkSession
    labelled = df.select(F.col(key).alias("k"), F.coalesce(label, F.lit("")).alias("label"))
    frequent = labelled.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS).collect()
    numbers = spark.createDataFrame([(r["label"], i) for i, r in enumerate(frequent)], "label string, stratum int")  # at most LABELS rows
    rows = labelled.join(F.broadcast(numbers), "label", "left").select("k", F.coalesce("stratum", F.lit(len(frequent))).alias("stratum"))
    g = groups.select(F.col(key).alias("k"), "group_id")
    rows = cut(rows.join(g, "k", "left").withColumn("group_id", F.coalesce("group_id", F.col("k"))))
    by_label = rows.groupBy("group_id", "stratum").agg(F.count("*").alias("n"))
    profiled = by_label.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("stratum", "n"))).alias("p"), F.sum("n").alias("size"))
    profiled = cut(profiled.withColumn("profile", F.md5(F.to_json("p"))))
    kinds = profiled.groupBy("profile").agg(F.first("p").alias("p"), F.first("size").alias("size"), F.count("*").alias("m"))
    kept = kinds.orderBy(F.desc("size"), F.desc("m"), "profile").limit(PROFILES).collect()  # at most PROFILES rows, a few numbers each
    rest = profiled.join(spark.createDataFrame([(r["profile"],) for r in kept], "profile string"), "profile", "left_anti")
    unit = F.pmod(F.xxhash64("group_id"), F.lit(REST_UNITS)).cast("int")
    lumps = rows.join(rest.select("group_id"), "group_id").groupBy(unit.alias("unit"), "stratum").agg(F.count("*").alias("n")).toArrow()  # at most REST_UNITS x (LABELS + 1) rows
    held: dict[int, tuple[list[int], list[int]]] = {}
    for u, s, n in zip(*(lumps[c].to_pylist() for c in ("unit", "stratum", "n")), strict=True):
        held.setdefault(u, ([], []))[0].append(s)
        held[u][1].append(n)
    profiles = [([x["stratum"] for x in r["p"]], [x["n"] for x in r["p"]]) for r in kept] + list(held.values())
    given = place(profiles, [r["m"] for r in kept] + [1] * len(held), fractions, len(frequent) + 1)
    names = [r["profile"] for r in kept] + [f"unit {u}" for u in held]
    ends = given.cumsum(axis=1)
    bounds = [(name, goals[s][0], int(ends[i, s] - given[i, s]), int(ends[i, s])) for i, name in enumerate(names) for s in np.nonzero(given[i])[0]]
    placed = spark.createDataFrame(bounds, T.StructType([T.StructField("profile", T.StringType()), T.StructField("split_name", T.StringType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]))
    known = profiled.join(rest.select("group_id"), "group_id", "left_anti").select("group_id", "profile")
    in_order = global_rank(known, [F.xxhash64("group_id"), F.col("group_id")], by=["profile"]).unionByName(rest.select("group_id", F.concat(F.lit("unit "), unit.cast("string")).alias("profile"), F.lit(0).cast("bigint").alias("rank")))
    # at most (PROFILES + REST_UNITS) rows with a bound for each split
    chosen = in_order.join(placed, "profile").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select("group_id", "split_name")
    return rows.join(chosen, "group_id").select(F.col("k").alias(key), "group_id", "split_name")


def deviations(df: DataFrame, key: str, placed: DataFrame, label: Column, targets: DataFrame) -> DataFrame:
    """(split_name, label, n, wanted, deviation): records of each label in each split, how many its fraction wants, and the difference as a share of the label."""
    rows = df.select(F.col(key), F.coalesce(label, F.lit("")).alias("label"))
    n = rows.groupBy("label").agg(F.count("*").alias("total"))
    goals = targets.select("split_name", "fraction").collect()  # a fixed small table
    shares = F.explode(F.array(*[F.struct(F.lit(r["split_name"]).alias("split_name"), F.lit(r["fraction"] / sum(x["fraction"] for x in goals)).alias("fraction")) for r in goals]))
    held = rows.join(placed.select(key, "split_name"), key).groupBy("split_name", "label").agg(F.count("*").alias("n"))
    wanted = n.select("label", "total", shares.alias("x")).select("x.split_name", "label", "total", (F.col("total") * F.col("x.fraction")).alias("wanted"))
    out = wanted.join(held, ["split_name", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("split_name", "label", "n", F.round("wanted", 3).alias("wanted"), F.round((F.col("n") - F.col("wanted")) / F.col("total"), 6).alias("deviation"))
