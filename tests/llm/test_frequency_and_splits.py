"""Frequencies, groups over shared entities and splits."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import frequency, graph, splits


def brute(rows, depth):
    occurrences, records = collections.Counter(), collections.defaultdict(set)
    for record, values in rows:
        vs = [v for v in values or [] if v]
        for i in range(len(vs)):
            for n in range(1, depth + 1):
                if i + n <= len(vs):
                    g = tuple(vs[i : i + n])
                    occurrences[g] += 1
                    records[g].add(record)
    return {g: (c, len(records[g] - {None})) for g, c in occurrences.items()}


@pytest.mark.parametrize("depth", [1, 3])
@pytest.mark.parametrize("batch", ["3", "10000"])
def test_frequencies(spark, depth, batch):
    rnd = random.Random(1)
    rows = [(f"t{rnd.randint(0, 40)}" if rnd.random() < 0.95 else None, [rnd.choice(["hot", "hot", "a", "b b", "c", "", None, "ü"]) for _ in range(rnd.randint(0, 9))]) for _ in range(150)]
    rows += [("t1", None), ("t2", []), ("t3", ["hot"] * 50)]
    df = spark.createDataFrame(rows, "name string, vs array<string>").withColumn("weight", F.lit(7)).withColumn("suffix", F.lit("x")).withColumn("record", F.lit("r"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {tuple(r.gram.split(frequency.SEPARATOR)): (r.occurrences, r.records) for r in frequency.gram_frequencies(df, "name", "vs", depth).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == brute(rows, depth)
    assert frequency.gram_frequencies(df.limit(0), "name", "vs", depth).count() == 0


def test_bands(spark):
    f = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 5), ("e", 4)], "gram string, records long")
    got = {r.gram: r.band for r in frequency.mark_bands(f, 100).collect()}
    assert got == {"a": "rare", "b": "rare", "c": None, "d": "common", "e": None}


def test_min_labels(spark):
    rnd = random.Random(4)
    ids = list(range(1, 400))
    chain = list(range(1000, 1200))
    rnd.shuffle(chain)
    ties = [(r, rnd.randint(0, 500)) for r in ids] + [(a, 10_000 + i) for i, p in enumerate(zip(chain, chain[1:])) for a in p] + [(5, None), (None, 7), (999, 77_777)]
    ties += [(r, 90_000) for r in range(2000, 2300)] + [(2000, 90_000)] * 3
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r, e in ties:
        if r is not None and e is not None:
            a, b = root(("r", r)), root(("e", e))
            if a != b:
                parent[a] = b
    label = collections.defaultdict(list)
    for r in {r for r, e in ties if r is not None and e is not None}:
        label[root(("r", r))].append(r)
    want = {(r, min(m)) for m in label.values() if len(m) > 1 for r in m}
    df = spark.createDataFrame(ties, "record long, entity long").withColumn("l", F.lit(0)).withColumn("e", F.lit(0))
    assert {(r.record, r.label) for r in graph.min_labels(df).collect()} == want
    assert graph.min_labels(df.limit(0)).count() == 0


def test_related_groups(spark):
    rows = [(5, ["A/x.txt", None], "one"), (3, ["x.PDF "], "two"), (9, None, "One!"), (7, [" "], None), (8, [], ""), (1, ["y.txt", "y.txt"], "??"), (2, ["z"], "?")]
    df = spark.createDataFrame(rows, "k long, ts array<string>, q string").withColumn("record", F.lit(1)).withColumn("entity", F.lit(1))
    assert {(r.group_id, r.k) for r in splits.related_groups(df, "k", "ts", "q").collect()} == {(3, 3), (3, 5), (3, 9)}
    assert splits.related_groups(df.limit(0), "k", "ts", "q").count() == 0


def test_grouped_split(spark):
    """One group holds a third of the rows; groups stay whole, proportions and labels are close."""
    rows = [(i, ["a", "b", "c", None][i % 4]) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, label string").withColumn("unit", F.lit(1)).withColumn("group_id", F.lit(0))
    groups = spark.range(1000).select(F.lit(0).cast("long").alias("group_id"), F.col("id").alias("k")).unionByName(spark.range(1000, 1500).select((F.floor(F.col("id") / 5) * 5).alias("group_id"), F.col("id").alias("k")))
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, fraction double")
    out = splits.grouped_split(df, "k", groups, F.col("label"), targets).toPandas()
    assert len(out) == 3000 and out.k.is_unique
    assert out.groupby("group_id").split_name.nunique().max() == 1
    share = out.split_name.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02
    labels = out.assign(label=[rows[k][1] or "none" for k in out.k]).groupby("split_name").label.value_counts(normalize=True)
    assert all(abs(labels["train"][x] - 0.25) < 0.05 for x in ("a", "b", "c", "none"))
    assert splits.grouped_split(df.limit(0), "k", groups.limit(0), F.col("label"), targets).count() == 0


def test_place_gives_each_profile_its_share():
    profiles = [([0], [10]), ([1], [10]), ([0, 1], [1, 1]), ([1], [1])]
    out = splits.place(profiles, [1, 1, 2, 7], np.array([0.5, 0.5]), 2)
    assert out.sum(axis=1).tolist() == [1, 1, 2, 7]
    held = [sum(out[u, k] * dict(zip(at, n)).get(1, 0) for u, (at, n) in enumerate(profiles)) for k in range(2)]
    assert abs(held[0] - held[1]) <= 3  # of the second label; a group of ten goes to one side
    assert splits.place([([0], [1])], [10], np.array([0.8, 0.2]), 1).tolist() == [[8, 2]]


@pytest.mark.parametrize("profiles", [2, 100_000])
def test_split_deviation(spark, monkeypatch, profiles):
    """Small groups of many label mixtures; with few profiles placed exactly the rest goes by units."""
    monkeypatch.setattr(splits, "PROFILES", profiles)
    df = spark.range(6000).select(F.col("id").alias("k"), F.concat(F.lit("l"), F.pmod(F.xxhash64("id"), F.lit(7)).cast("string")).alias("label"))
    groups = df.select((F.floor(F.col("k") / 3) * 3).alias("group_id"), "k")
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, fraction double")
    placed = splits.grouped_split(df, "k", groups, F.col("label"), targets)
    assert placed.count() == 6000 and placed.groupBy("group_id").agg(F.count_distinct("split_name").alias("n")).where("n > 1").count() == 0
    out = splits.deviations(df, "k", placed, F.col("label"), targets).collect()
    assert len(out) == 21 and sum(r.n for r in out) == 6000
    assert max(abs(r.deviation) for r in out) < 0.02
