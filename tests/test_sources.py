"""Readers, writers, stand-ins and incremental work on files."""

import json

import numpy as np
from pyspark.sql import functions as F

from pagewright.sources import external as E
from pagewright.sources import records as I
from pagewright.streaming import incremental as inc


def test_records(spark, tmp_path):
    (tmp_path / "many.json").write_text(json.dumps([{"query": "a", "pos_target": ["x"], "extra": 1}, {"query": None}], indent=1))
    (tmp_path / "one.json").write_text(json.dumps({"query": "b", "pos_target": []}))
    (tmp_path / "bad.json").write_text("{")
    rows = I.read_records(spark, str(tmp_path), I.QUERY_RECORD).collect()
    assert sorted((r.query, r.pos_target) for r in rows) == [("a", ["x"]), ("b", [])]
    I.write_records(spark.createDataFrame([("q", ["r"])], I.RESULT), str(tmp_path / "out"))
    assert I.read_record_lines(spark, str(tmp_path / "out"), I.RESULT).collect()[0].results == ["r"]


def test_texts_and_listing(spark, tmp_path):
    (tmp_path / "b.txt").write_text("\n two\nlines \n")
    (tmp_path / "a.txt").write_text(" \n")
    (tmp_path / "none.txt").write_text("")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "c.PNG").write_bytes(b"x")
    (tmp_path / "d.md").write_text("no")
    assert {r.text_name: r.text for r in I.read_texts(spark, str(tmp_path)).collect()} == {"a.txt": "", "b.txt": "two\nlines"}
    assert [(r.file_name, r.stem) for r in I.list_files(spark, str(tmp_path), ["png", "jpg"]).collect()] == [("c.PNG", "c")]


def test_categories_results_and_parts(spark, tmp_path):
    for c in ("law", "bio"):
        (tmp_path / c).mkdir()
        (tmp_path / c / "train.json").write_text(json.dumps([{"query": c}]))
    (tmp_path / "query_list_text_law_with_pos_target_retrieved.json").write_text(json.dumps([{"query": "q", "results": ["r"]}]))
    assert {(r.query, r.category) for r in I.read_by_category(spark, str(tmp_path), "train.json", "query string").collect()} == {("law", "law"), ("bio", "bio")}
    assert [(r.query, r.category) for r in I.read_retrieved(spark, str(tmp_path), I.RESULT).collect()] == [("q", "law")]
    spark.range(3).write.parquet(str(tmp_path / "parts" / "train-0.parquet"))
    spark.range(4).write.parquet(str(tmp_path / "parts" / "other.parquet"))
    assert I.read_train_parts(spark, str(tmp_path / "parts")).count() == 3


def test_collections_and_names(spark, tmp_path):
    I.save_collection(spark.range(3).withColumn("path", F.lit("x")), "vectors_under_test")
    I.save_collection(spark.range(2), "vectors_under_test")
    assert spark.table("vectors_under_test").count() == 2
    I.drop_collection(spark, "vectors_under_test")
    assert not spark.catalog.tableExists("vectors_under_test")
    I.write_vectors(spark.createDataFrame([("p", [[1.0]])], "image_path string, image_embeddings array<array<double>>"), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1
    assert I.metrics_name("metrics", "t", "7") == "metrics_t.json" and I.metrics_name("eval", None, "7") == "eval_7.json"
    assert I.example_set(spark).where("part = 'train'").count() == 2


def test_external(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "")], "id long, t string")
    got = {r.id: r.vectors for r in E.encoded(df, "id", "t", batch=2).collect()}
    assert [len(got[i]) for i in (1, 2, 3)] == [2, 1, 1] and np.isclose(np.linalg.norm(got[1][0]), 1)
    assert len(E.encoded(df, "id", "t", "single_vector").first().vectors) == 1

    @E.generator("broken")
    def broken(prompts):
        raise RuntimeError("no service")

    assert {r.answer for r in E.generated(df, "id", "t", "broken").collect()} == {None}
    c = df.withColumn("cs", F.array(F.lit("q1"), F.lit("q2"), F.lit("q1")))
    assert {tuple(r.kept) for r in E.judged(c, "id", "t", "cs", lambda t, q: ["q1", "other"]).collect()} == {("q1", "q1")}
    assert {tuple(r.kept) for r in E.judged(c, "id", "t", "cs", lambda t, q: 1 / 0, on_failure="all").collect()} == {("q1", "q2", "q1")}
    assert {tuple(r.kept) for r in E.judged(c, "id", "t", "cs", lambda t, q: 1 / 0).collect()} == {()}


def test_resume(spark, tmp_path):
    todo, out = spark.range(10).withColumnRenamed("id", "k"), str(tmp_path / "out")
    work = lambda df: df.withColumn("v", F.col("k") * 2)
    assert inc.resume(todo.where("k < 4"), out, "k", work) == 4
    assert inc.resume(todo, out, "k", work) == 6 and inc.resume(todo, out, "k", work) == 0
    assert spark.read.parquet(out).count() == 10


def test_stream_of_new_rows(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    row = lambda k: (k, f"2025-01-{k % 28 + 1:02d} 00:00:00")
    make = lambda ks: spark.createDataFrame([row(k) for k in ks], "k long, t string").select("k", F.to_timestamp("t").alias("ingested_at"))
    run = lambda: inc.stream_new_rows(spark, src, "k long, ingested_at timestamp", out, check, "k", lambda df: df.select("k")).awaitTermination()
    make([1, 2, 2, 3]).write.mode("append").parquet(src)
    run()
    make([3, 4]).write.mode("append").parquet(src)
    run()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_stream_counts_equal_batch(spark, tmp_path):
    df = spark.range(200).select(F.timestamp_seconds(F.col("id") * 9000).alias("t"), (F.col("id") % 3).cast("string").alias("c"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = inc.stream_counts(stream, "t", "c").writeStream.format("memory").queryName("counts_under_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("counts_under_test").collect()} == {tuple(r) for r in inc.stream_counts(df, "t", "c").collect()}
