"""References to records that do not exist."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pagewright.operators import references as refs


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(hours=n)


SPANS = "name string, born timestamp_ntz, died timestamp_ntz"
PROBES = "name string, at timestamp_ntz"


def sound(spans, name, at):
    return any(n == name and (at is None or (b is not None and b <= at and (d is None or d > at))) for n, b, d in spans if n is not None)


def test_alive_equals_brute_force(spark):
    rnd = random.Random(3)
    names = ["hot"] * 6 + ["a", "b", "c", ""]
    spans = [(rnd.choice(names), day(rnd.randint(0, 200)) if rnd.random() < 0.9 else None, day(rnd.randint(0, 200)) if rnd.random() < 0.6 else None) for _ in range(60)] + [(None, day(1), None), ("dead", day(5), day(5)), ("back", day(9), day(3))]
    probes = [(rnd.choice(names + ["none", "dead", "back"]), day(rnd.randint(0, 210)) if rnd.random() < 0.9 else None) for _ in range(400)]
    probes += [("a", None), ("none", None), ("hot", day(0)), ("hot", day(0))]
    got = refs.alive(spark.createDataFrame(probes, PROBES), spark.createDataFrame(spans, SPANS)).collect()
    want = {(n, at) for n, at in probes if sound(spans, n, at)}
    assert len(got) == len(want) and {(r.name, r.at) for r in got} == want
    empty = spark.createDataFrame([], SPANS)
    assert refs.alive(spark.createDataFrame(probes, PROBES), empty).count() == 0
    assert refs.alive(spark.createDataFrame([], PROBES), spark.createDataFrame(spans, SPANS)).count() == 0


def tables(spark):
    files = [(1, " A/x.TXT ", day(10), day(20)), (2, "x.txt", day(30), None), (3, None, day(0), None), (4, "y_1.pdf", None, None), (5, "", day(0), None)]
    pages = [(1, "x_3.png", "x.png", day(15)), (2, "x_3.png", "x.png", day(25)), (3, None, " ", day(15)), (4, "y_1_2.png", "y_1.png", None), (5, "z.png", "z.png", day(15)), (6, "z_4.png", "Z.png", day(15)), (7, "x.png", "x.png", day(25)), (8, "x_9.png", "x.png", day(35)), (5, "z.png", "z.png", day(15))]
    queries = [(1, ["x.txt", None, " ", "x.txt", "q"], day(12)), (2, None, None), (3, [], day(1)), (4, ["y_1"], None), (5, ["z"], None)]
    f = spark.createDataFrame(files, "file_id long, text_name string, registered_at timestamp_ntz, deleted_at timestamp_ntz")
    p = spark.createDataFrame(pages, "page_id long, page_name string, document_name string, rendered_at timestamp_ntz").withColumns({"name": F.lit("clash"), "found": F.lit(1), "category": F.lit(None).cast("string")})
    q = spark.createDataFrame(queries, "query_id long, pos_target_for_deepseek array<string>, created_at timestamp_ntz").withColumn("at", F.lit("clash"))
    return q.withColumn("query", F.when(F.col("query_id") < 5, F.concat(F.lit("Query no. "), F.col("query_id").cast("string")))), p, f


def texts(spark):
    """Clustered texts and the queries they list."""
    rows = [(1, ["query NO 1!", None, ""]), (2, ["query no 4"]), (3, None), (4, [])]
    return spark.createDataFrame(rows, "record_id long, querys array<string>").withColumn("parent", F.lit("clash"))


def test_orphans_and_cascade(spark):
    q, p, f = tables(spark)
    found = refs.orphan_references(refs.text_references(q, p), refs.text_spans(f))
    got = sorted((r.src_field, r.row_id, r.ref_name) for r in found.collect())
    assert got == [
        ("document_name", 2, "x"), ("document_name", 5, "z"), ("document_name", 6, "z"), ("document_name", 7, "x"), ("page_name", 2, "x_3"), ("page_name", 5, "z"), ("page_name", 6, "z_4"), ("page_name", 7, "x"),
        ("pos_target_for_deepseek", 1, "q"), ("pos_target_for_deepseek", 5, "z"),
    ]
    reached = {r.node: r.depth for r in refs.cascade(refs.orphan_nodes(found), refs.record_edges(q, p, texts(spark))).collect()}
    assert reached["image_page_metadata:7"] == 0 and reached["document:x"] == 1
    assert reached["query:query no 1"] == 1 and reached["data_text_with_cluster_ids:1"] == 2 and "data_text_with_cluster_ids:2" not in reached
    assert reached["image_page_metadata:1"] == 2 and reached["image_page_metadata:8"] == 2  # sound themselves, but their document is an orphan
    assert reached["query_list:1"] == 0 and "query_list:4" not in reached and "image_page_metadata:3" not in reached


def test_cascade_ends_on_cycles(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "x"), ("b", "a"), (None, "a"), ("e", None)], "child string, parent string").withColumn("node", F.lit(1))
    direct = spark.createDataFrame([("a",), ("a",)], "node string")
    assert {(r.node, r.depth) for r in refs.cascade(direct, edges.where("child is not null")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert refs.cascade(direct.limit(0), edges).count() == 0


def test_empty_tables(spark):
    q, p, f = tables(spark)
    found = refs.orphan_references(refs.text_references(q.limit(0), p.limit(0)), refs.text_spans(f))
    assert found.count() == 0
    assert refs.orphan_references(refs.text_references(q, p), refs.text_spans(f.limit(0))).count() == 18
    assert refs.cascade(refs.orphan_nodes(found), refs.record_edges(q, p, texts(spark))).count() == 0


def test_month_key(spark):
    got = spark.createDataFrame([(day(0),), (None,)], "t timestamp_ntz").select(refs.month_key(F.col("t"))).collect()
    assert [r[0] for r in got] == ["2025-01", "unknown"]
