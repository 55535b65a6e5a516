"""Labels are balanced each by itself."""

import pytest
from pyspark.sql import functions as F

from pagewright.llm import splits


@pytest.mark.parametrize("a, b", [("government", "biology"), ("biology", "finance"), ("education", "research")])
def test_labels_that_hash_alike_are_kept_apart(spark, a, b):
    """Ten groups of 100 records, of one label each, the labels by turns."""
    df = spark.range(1000).select(F.col("id").alias("k"), F.when(F.floor(F.col("id") / 100) % 2 == 0, a).otherwise(b).alias("label"))
    groups = df.select((F.floor(F.col("k") / 100) * 100).alias("group_id"), "k")
    targets = spark.createDataFrame([("test", 0.4), ("train", 0.6)], "split_name string, fraction double")
    out = splits.grouped_split(df, "k", groups, F.col("label"), targets).join(df, "k").groupBy("label", "split_name").count().collect()
    assert {(r.label, r.split_name): r["count"] for r in out} == {(x, s): n for x in (a, b) for s, n in (("test", 200), ("train", 300))}


def test_rare_labels_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(splits, "LABELS", 2)
    rows = [(i, "a" if i < 400 else "b" if i < 700 else f"rare {i}" if i < 980 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, label string")
    groups = spark.createDataFrame([], "group_id long, k long")
    targets = spark.createDataFrame([("test", 0.5), ("train", 0.5)], "split_name string, fraction double")
    out = {r.k: r.split_name for r in splits.grouped_split(df, "k", groups, F.col("label"), targets).collect()}
    assert set(out) == set(range(1000))
    for keys in (range(400), range(400, 700), range(700, 1000)):
        assert abs(sum(out[k] == "train" for k in keys) - len(keys) / 2) <= 3
