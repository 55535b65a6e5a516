"""Filters, joins, aggregates and set operations over the record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import scalars as S
from pagewright.operators import relational as R
from pagewright.operators.sampling import global_rank
from pagewright.plans.registry import Registry
from pagewright.plans.scalar_queries import FORMATTED, STEM, STRIP, fn_page_format
from pagewright.session import table

REGISTRY = Registry()
NO_TEXT = "[]::VARCHAR[]"


# filters


@REGISTRY("filter_named_rows", f"SELECT query_id, query FROM query_list WHERE length({STRIP.format('query')}) > 0", "F1 F10")
def filter_named_rows(spark: SparkSession, d: str) -> DataFrame:
    return R.without_blank(table(spark, d, "query_list").select("query_id", "query"), "query")


@REGISTRY("filter_queries_once", "SELECT query_id FROM query_list WHERE (SELECT count(*) FROM query_list b WHERE b.query IS NOT DISTINCT FROM query_list.query) = 1", "F2")
def filter_queries_once(spark: SparkSession, d: str) -> DataFrame:
    return R.exactly_once(table(spark, d, "query_list").select("query_id", "query"), "query").select("query_id")


@REGISTRY("filter_group_sizes", "SELECT query_id FROM query_list WHERE len(pos_target) BETWEEN 3 AND 5 AND len(cluster_ids) >= 5", "F3 F4 F9")
def filter_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_list").where(F.size("pos_target").between(3, 5) & (F.size("cluster_ids") >= 5)).select("query_id")


@REGISTRY("filter_own_rows", "SELECT page_id FROM image_page_metadata WHERE page_name <> document_name", "F5")
def filter_own_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "image_page_metadata").where("page_name <> document_name").select("page_id")


TARGETS = "SELECT query_id, ord, v FROM (SELECT query_id, unnest(pos_target) AS v, generate_subscripts(pos_target, 1) AS ord FROM query_list)"


@REGISTRY("filter_pool_queries", f"SELECT query_id FROM query_list SEMI JOIN (SELECT DISTINCT query_id FROM ({TARGETS}) WHERE {STEM.format('v')} IN (SELECT {STEM.format('text_name')} FROM text_files WHERE file_id % 5 = 0)) USING (query_id)", "F6 F7 J6")
def filter_pool_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries with a target in a pool of texts."""
    pool = table(spark, d, "text_files").where("file_id % 5 = 0").select(S.file_stem(F.col("text_name")).alias("stem")).distinct()
    asked = table(spark, d, "query_list").select("query_id", F.explode("pos_target").alias("v")).select("query_id", S.file_stem(F.col("v")).alias("stem"))
    return asked.join(pool, "stem", "left_semi").select("query_id").distinct()


@REGISTRY("filter_flag_column", "SELECT query_id FROM query_list WHERE list_contains(pos_target, pos_target_for_deepseek[1])", "F8")
def filter_flag_column(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose own flag holds; here: the first judged target is a target."""
    flag = F.array_contains("pos_target", F.get("pos_target_for_deepseek", F.lit(0)))
    return table(spark, d, "query_list").withColumn("gold", flag).where("gold").select("query_id")


@REGISTRY("filter_judge_route", f"SELECT record_id, CASE WHEN len(querys) > 0 AND length({STRIP.format('text_name')}) > 0 THEN 'judge' ELSE 'empty' END AS route, CASE WHEN len(querys) > 0 AND length({STRIP.format('text_name')}) > 0 THEN coalesce(querys_for_deepseek, {NO_TEXT}) ELSE {NO_TEXT} END AS kept FROM data_text_with_cluster_ids", "F12 J14")
def filter_judge_route(spark: SparkSession, d: str) -> DataFrame:
    """Rows that need a judgement and rows that are [] without one, back in one table."""
    t = table(spark, d, "data_text_with_cluster_ids").withColumn("row", F.col("record_id"))
    needs = F.coalesce((F.size("querys") > 0) & (F.length(S.strip(F.col("text_name"))) > 0), F.lit(False))
    judged = t.where(needs).select("row", F.coalesce("querys_for_deepseek", F.array().cast("array<string>")).alias("judged"))
    return t.join(judged, "row", "left").select("record_id", F.when(needs, "judge").otherwise("empty").alias("route"), F.coalesce("judged", F.array().cast("array<string>")).alias("kept"))


@REGISTRY("filter_bad_rows", "SELECT query_id, try_cast(regexp_extract(query, '([0-9]+)', 1) AS INTEGER) AS number FROM query_list WHERE try_cast(regexp_extract(query, '([0-9]+)', 1) AS INTEGER) IS NOT NULL", "F11")
def filter_bad_rows(spark: SparkSession, d: str) -> DataFrame:
    """A row that cannot be worked on is left out and the others go on."""
    return table(spark, d, "query_list").select("query_id", F.nullif(F.regexp_extract("query", "([0-9]+)", 1), F.lit("")).try_cast("int").alias("number")).where("number IS NOT NULL")


# joins

KEYWORD_CLUSTERS = "SELECT t.record_id, list_sort(coalesce(list(DISTINCT c.cluster_id) FILTER (c.cluster_id IS NOT NULL), [])) AS cluster_ids FROM data_text_keywords t LEFT JOIN (SELECT record_id, unnest(keywords) AS k FROM data_text_keywords) x USING (record_id) LEFT JOIN (SELECT k, max(cluster_id) AS cluster_id FROM (SELECT cluster_id, unnest(keywords) AS k FROM keywords_clusters) GROUP BY k) c ON c.k = x.k GROUP BY t.record_id"


@REGISTRY("join_keyword_clusters", KEYWORD_CLUSTERS, "J1 G3 S24")
def join_keyword_clusters(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_clusters(table(spark, d, "data_text_keywords"), table(spark, d, "keywords_clusters"), "record_id")


def _doc_queries(spark: SparkSession, d: str) -> DataFrame:
    q = R.without_blank(table(spark, d, "query_list"), "query").withColumn("q", S.strip(F.col("query")))
    return R.inverted(q, "q", "pos_target", "query_id", "text_name", "querys")


@REGISTRY("join_text_queries", f"SELECT t.record_id, coalesce(list(q ORDER BY query_id, ord) FILTER (q IS NOT NULL), {NO_TEXT}) AS querys FROM data_text_with_cluster_ids t LEFT JOIN (SELECT query_id, {STRIP.format('query')} AS q, ord, v FROM ({TARGETS}) JOIN query_list USING (query_id) WHERE length({STRIP.format('query')}) > 0) ON v = t.text_name GROUP BY t.record_id", "J2")
def join_text_queries(spark: SparkSession, d: str) -> DataFrame:
    """Each text with the queries that aim at it."""
    t = table(spark, d, "data_text_with_cluster_ids").select("record_id", "text_name")
    return R.attached(t, "text_name", _doc_queries(spark, d).withColumnRenamed("text_name", "member"), "member", "querys").select("record_id", "querys")


@REGISTRY("join_query_texts", f"SELECT q.query_id, coalesce(list(t.text_name ORDER BY t.record_id, t.ord) FILTER (t.text_name IS NOT NULL), {NO_TEXT}) AS pos_judged FROM query_list q LEFT JOIN (SELECT record_id, text_name, unnest(querys_for_deepseek) AS v, generate_subscripts(querys_for_deepseek, 1) AS ord FROM data_text_with_cluster_ids) t ON {STRIP.format('t.v')} = {STRIP.format('q.query')} GROUP BY q.query_id", "J3")
def join_query_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each query with the texts judged to answer it; a text that names it twice is there twice."""
    texts = table(spark, d, "data_text_with_cluster_ids").withColumn("qs", F.transform("querys_for_deepseek", S.strip))
    q = table(spark, d, "query_list").select("query_id", S.strip(F.col("query")).alias("q"))
    return R.attached(q, "q", R.inverted(texts, "text_name", "qs", "record_id", "member", "pos_judged"), "member", "pos_judged").select("query_id", "pos_judged")


@REGISTRY("join_first_truth", "SELECT q.query_id, f.pos_target FROM query_list q JOIN (SELECT query, arg_min(pos_target, query_id) FILTER (pos_target IS NOT NULL) AS pos_target FROM query_list WHERE query IS NOT NULL AND pos_target IS NOT NULL GROUP BY query) f USING (query)", "J4")
def join_first_truth(spark: SparkSession, d: str) -> DataFrame:
    """Results joined with the first truth of their query."""
    q = table(spark, d, "query_list").where("query IS NOT NULL")
    return q.select("query_id", "query").join(R.first_wins(q.where("pos_target IS NOT NULL"), ["query"], ["pos_target"], "query_id"), "query").select("query_id", "pos_target")


@REGISTRY("join_not_done", "SELECT record_id FROM data_text_keywords WHERE text_name NOT IN (SELECT text_name FROM data_text_with_cluster_ids WHERE text_name IS NOT NULL)", "J5 S22")
def join_not_done(spark: SparkSession, d: str) -> DataFrame:
    return R.not_done(table(spark, d, "data_text_keywords").select("record_id", "text_name"), table(spark, d, "data_text_with_cluster_ids"), "text_name").select("record_id")


PAGE_DOC = f"SELECT page, arg_max(doc, page_id) AS document FROM (SELECT page_id, {STEM.format('page_name')} AS page, {STEM.format('document_name')} AS doc FROM image_page_metadata) WHERE page <> '' AND doc <> '' GROUP BY page"


def page_documents(spark: SparkSession, d: str) -> DataFrame:
    """(page, document) by stems; of repeats the last wins."""
    t = table(spark, d, "image_page_metadata").select("page_id", S.file_stem(F.col("page_name")).alias("page"), S.file_stem(F.col("document_name")).alias("document"))
    return R.last_wins(t.where("page <> '' AND document <> ''"), ["page"], ["document"], "page_id")


@REGISTRY("join_page_documents", PAGE_DOC, "S17 U6")
def join_page_documents(spark: SparkSession, d: str) -> DataFrame:
    return page_documents(spark, d)


@REGISTRY("join_page_or_itself", f"SELECT t.query_id, t.ord, coalesce(m.document, t.page) AS document FROM (SELECT query_id, ord, {STEM.format('v')} || '_1' AS page FROM ({TARGETS}) WHERE v IS NOT NULL) t LEFT JOIN ({PAGE_DOC}) m USING (page)", "J7")
def join_page_or_itself(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_list").select("query_id", F.posexplode("pos_target").alias("p", "v")).where("v IS NOT NULL")
    t = q.select("query_id", (F.col("p") + 1).cast("bigint").alias("ord"), F.concat(S.file_stem(F.col("v")), F.lit("_1")).alias("page"))
    return R.or_itself(t, "page", page_documents(spark, d), "page", "document", "document").select("query_id", "ord", "document")


@REGISTRY("join_target_pages", f"WITH p AS (SELECT {STEM.format('document_name')} AS doc, page_name FROM image_page_metadata WHERE page_name <> document_name) SELECT DISTINCT t.query_id, coalesce(p.page_name, t.doc) AS page FROM (SELECT query_id, {STEM.format('v')} AS doc FROM ({TARGETS}) WHERE v IS NOT NULL) t LEFT JOIN p USING (doc)", "J8 S20 U4")
def join_target_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each query's targets; a target without pages stands for itself."""
    p = table(spark, d, "image_page_metadata").where("page_name <> document_name").select(S.file_stem(F.col("document_name")).alias("doc"), "page_name").distinct()
    t = table(spark, d, "query_list").select("query_id", F.explode("pos_target").alias("v")).where("v IS NOT NULL").select("query_id", S.file_stem(F.col("v")).alias("doc")).distinct()
    return R.or_itself(t, "doc", p, "doc", "page_name", "page").select("query_id", "page").distinct()


@REGISTRY("join_materialised", f"SELECT q.query_id, coalesce(list(f.category ORDER BY t.ord) FILTER (f.file_id IS NOT NULL), {NO_TEXT}) AS docs FROM query_list q LEFT JOIN ({TARGETS}) t USING (query_id) LEFT JOIN (SELECT text_name, arg_min(coalesce(category, 'none'), file_id) AS category, min(file_id) AS file_id FROM text_files GROUP BY 1) f ON f.text_name = t.v GROUP BY q.query_id", "J9 L6 S23")
def join_materialised(spark: SparkSession, d: str) -> DataFrame:
    """Each query with what the corpus has for its target names, in order."""
    corpus = table(spark, d, "text_files").where("text_name IS NOT NULL").withColumn("category", F.coalesce("category", F.lit("none")))
    return R.materialised(table(spark, d, "query_list"), "query_id", "pos_target", R.first_wins(corpus, ["text_name"], ["category"], "file_id"), "text_name", "category")


@REGISTRY("join_category_truth", f"WITH g AS (SELECT coalesce(category, 'none') AS cat, {STEM.format('v')} AS doc, query FROM (SELECT category, query, unnest(pos_target) AS v FROM query_list) WHERE v IS NOT NULL AND query IS NOT NULL) SELECT cat, query, list_sort(list(DISTINCT doc)) AS docs FROM g GROUP BY ALL", "J11")
def join_category_truth(spark: SparkSession, d: str) -> DataFrame:
    """Targets by category and query."""
    t = table(spark, d, "query_list").where("query IS NOT NULL").select(F.coalesce("category", F.lit("none")).alias("cat"), "query", F.explode("pos_target").alias("v")).where("v IS NOT NULL")
    return t.groupBy("cat", "query").agg(F.array_sort(F.collect_set(S.file_stem(F.col("v")))).alias("docs"))


@REGISTRY("join_missing_results", "SELECT coalesce(q.category, 'none') AS category, count(*) FILTER (t.text_name IS NULL) AS missing, count(*) AS asked FROM (SELECT category, pos_target[1] AS name FROM query_list) q LEFT JOIN (SELECT DISTINCT text_name FROM data_text_with_cluster_ids) t ON t.text_name = q.name GROUP BY 1", "J12 A7")
def join_missing_results(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "data_text_with_cluster_ids").select("text_name").distinct()
    q = table(spark, d, "query_list").select(F.coalesce("category", F.lit("none")).alias("category"), F.get("pos_target", F.lit(0)).alias("name"))
    return q.join(have, q["name"] == have["text_name"], "left").groupBy("category").agg(F.count_if(F.col("text_name").isNull()).alias("missing"), F.count("*").alias("asked"))


# aggregates


@REGISTRY("agg_inverted_clusters", "SELECT c AS cluster_id, list_sort(list(DISTINCT text_name)) AS texts FROM (SELECT text_name, unnest(cluster_ids) AS c FROM data_text_with_cluster_ids) WHERE c IS NOT NULL GROUP BY c", "A1")
def agg_inverted_clusters(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "data_text_with_cluster_ids").select("text_name", F.explode("cluster_ids").alias("cluster_id")).where("cluster_id IS NOT NULL")
    return t.groupBy("cluster_id").agg(F.array_sort(F.collect_set("text_name")).alias("texts"))


@REGISTRY("agg_target_sizes", "SELECT size, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS percent FROM (SELECT coalesce(len(pos_target), 0)::INTEGER AS size FROM query_list) GROUP BY size", "A2")
def agg_target_sizes(spark: SparkSession, d: str) -> DataFrame:
    return R.histogram(table(spark, d, "query_list"), S.size_or_zero(F.col("pos_target")), "size")


@REGISTRY("agg_page_formats", f"SELECT format, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS percent FROM ({FORMATTED}) GROUP BY format", "A3")
def agg_page_formats(spark: SparkSession, d: str) -> DataFrame:
    return R.histogram(fn_page_format(spark, d), F.col("format"), "format")


@REGISTRY("agg_page_ranges", "SELECT page_group, min(n) || '~' || max(n) AS page_range, count(*) AS n_docs FROM (SELECT n, CASE WHEN n <= 10 THEN '<=10' WHEN n <= 20 THEN '11-20' ELSE '>20' END AS page_group FROM (SELECT count(*) AS n FROM image_page_metadata WHERE page_name <> document_name GROUP BY document_name)) GROUP BY page_group", "A8")
def agg_page_ranges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "image_page_metadata").where("page_name <> document_name").groupBy("document_name").agg(F.count("*").alias("n"))
    return n.groupBy(S.page_count_group(F.col("n")).alias("page_group")).agg(F.concat(F.min("n"), F.lit("~"), F.max("n")).alias("page_range"), F.count("*").alias("n_docs"))


@REGISTRY("agg_positive_docs", f"SELECT DISTINCT {STEM.format('v')} AS doc FROM ({TARGETS}) WHERE v IS NOT NULL", "A9 T4")
def agg_positive_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_list").select(F.explode("pos_target").alias("v")).where("v IS NOT NULL").select(S.file_stem(F.col("v")).alias("doc")).distinct().orderBy("doc")


@REGISTRY("agg_distinct_keywords", "SELECT DISTINCT k FROM (SELECT unnest(keywords) AS k FROM data_text_keywords) WHERE k IS NOT NULL", "A10")
def agg_distinct_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "data_text_keywords").select(F.explode("keywords").alias("k")).where("k IS NOT NULL").distinct()


@REGISTRY("agg_positive_stats", "SELECT count(*) AS n, round(avg(coalesce(len(pos_target), 0)), 6) AS mean, min(coalesce(len(pos_target), 0))::INTEGER AS low, max(coalesce(len(pos_target), 0))::INTEGER AS high, sum(coalesce(len(pos_target), 0))::BIGINT AS total FROM query_list", "A11 A15")
def agg_positive_stats(spark: SparkSession, d: str) -> DataFrame:
    n = S.size_or_zero(F.col("pos_target"))
    return table(spark, d, "query_list").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), F.min(n).alias("low"), F.max(n).alias("high"), F.sum(n).alias("total"))


@REGISTRY("agg_cluster_members", f"SELECT c.i AS cluster_id, coalesce(list(k ORDER BY k) FILTER (k IS NOT NULL), {NO_TEXT}) AS keywords FROM (SELECT unnest(range(100)) AS i) c LEFT JOIN (SELECT DISTINCT k, length(k) AS i FROM (SELECT unnest(keywords) AS k FROM data_text_keywords)) m USING (i) GROUP BY c.i", "A12")
def agg_cluster_members(spark: SparkSession, d: str) -> DataFrame:
    """Members by cluster number, clusters without any kept (here: keywords by length)."""
    k = table(spark, d, "data_text_keywords").select(F.explode("keywords").alias("k")).distinct().select("k", F.length("k").cast("bigint").alias("cluster_id"))
    lists = k.groupBy("cluster_id").agg(F.array_sort(F.collect_list("k")).alias("keywords"))
    return spark.range(100).withColumnRenamed("id", "cluster_id").join(lists, "cluster_id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


@REGISTRY(
    "agg_cleaning_counters",
    f"""WITH k AS (SELECT query_id, {STRIP.format('query')} AS q, pos_target AS a, list_filter(coalesce(pos_target, {NO_TEXT}), lambda x: list_contains(coalesce(pos_target_for_deepseek, {NO_TEXT}), x)) AS f FROM query_list)
SELECT count(*) FILTER (coalesce(len(a), 0) <> len(f)) AS n_filtered, count(*) FILTER (len(f) <> len(list_distinct(f))) AS n_deduplicated FROM k""",
    "A14",
)
def agg_cleaning_counters(spark: SparkSession, d: str) -> DataFrame:
    """How many lists filtering and removing repeats would change."""
    f = S.kept_members(F.col("pos_target"), F.col("pos_target_for_deepseek"))
    t = table(spark, d, "query_list").select(S.size_or_zero(F.col("pos_target")).alias("a"), f.alias("f"))
    return t.agg(F.count_if(F.col("a") != F.size("f")).alias("n_filtered"), F.count_if(F.size("f") != F.size(F.array_distinct("f"))).alias("n_deduplicated"))


@REGISTRY("agg_mapping_totals", "SELECT count(*) AS n_docs, sum(coalesce(len(q), 0))::BIGINT AS n_pairs FROM (SELECT text_name, arg_max(coalesce(querys, []), record_id) AS q FROM data_text_with_cluster_ids WHERE text_name IS NOT NULL GROUP BY text_name)", "A17")
def agg_mapping_totals(spark: SparkSession, d: str) -> DataFrame:
    """Texts and text-query pairs; of repeated texts the last entry counts."""
    t = table(spark, d, "data_text_with_cluster_ids").where("text_name IS NOT NULL").withColumn("querys", F.coalesce("querys", F.array().cast("array<string>")))
    return R.last_wins(t, ["text_name"], ["querys"], "record_id").agg(F.count("*").alias("n_docs"), F.sum(F.size("querys")).alias("n_pairs"))


@REGISTRY("agg_category_pivot", "SELECT category, count(*) FILTER (lower(trim(split_name)) = 'train') AS train, count(*) FILTER (lower(trim(split_name)) = 'test') AS test FROM query_list WHERE category IS NOT NULL GROUP BY category", "A13 K7")
def agg_category_pivot(spark: SparkSession, d: str) -> DataFrame:
    """A comparison table: a column per value."""
    t = table(spark, d, "query_list").where("category IS NOT NULL").groupBy("category", F.lower(F.trim("split_name")).alias("s")).agg(F.count("*").alias("n"))
    return R.pivoted(t, "category", "s", ["train", "test"], "n").select("category", F.coalesce("train", F.lit(0)).alias("train"), F.coalesce("test", F.lit(0)).alias("test"))


# sets


@REGISTRY("set_merged_groups", "WITH g AS (SELECT cluster_ids AS c, record_id % 2 AS age, record_id AS o FROM data_text_with_cluster_ids WHERE len(cluster_ids) > 0) SELECT c, arg_min(o, [age, o]) AS o FROM g GROUP BY c", "U1 U8")
def set_merged_groups(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "data_text_with_cluster_ids").where(F.size("cluster_ids") > 0).select(F.col("cluster_ids").alias("c"), F.col("record_id").alias("o"))
    return R.merged_groups(t.where("o % 2 = 0"), t.where("o % 2 = 1"), ["c"], "o")


NAMES = "SELECT text_name FROM data_text_keywords WHERE text_name IS NOT NULL"
NAMES_B = "SELECT text_name FROM data_text_with_cluster_ids WHERE text_name IS NOT NULL"


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(table(spark, d, t).where("text_name IS NOT NULL").select("text_name") for t in ("data_text_keywords", "data_text_with_cluster_ids"))


@REGISTRY("set_union_all", f"{NAMES} UNION ALL {NAMES_B}", "U2")
def set_union_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = _names(spark, d)
    return a.unionByName(b)


@REGISTRY("set_algebra", f"SELECT 'union' AS op, text_name FROM ({NAMES} UNION {NAMES_B}) UNION ALL SELECT 'difference', text_name FROM ({NAMES} EXCEPT {NAMES_B}) UNION ALL SELECT 'intersection', text_name FROM ({NAMES} INTERSECT {NAMES_B})", "U3")
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    a, b = _names(spark, d)
    parts = {"union": a.unionByName(b).distinct(), "difference": a.subtract(b), "intersection": a.intersect(b)}
    out = None
    for op, p in parts.items():
        p = p.select(F.lit(op).alias("op"), "text_name")
        out = p if out is None else out.unionByName(p)
    return out


@REGISTRY("set_first_by_key", "SELECT text_name, arg_min(record_id, record_id) AS record_id FROM data_text_keywords WHERE text_name IS NOT NULL GROUP BY text_name", "U5 U7")
def set_first_by_key(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "data_text_keywords").where("text_name IS NOT NULL").withColumn("o", F.col("record_id"))
    return R.first_wins(t, ["text_name"], ["record_id"], "o")


@REGISTRY("top_sorted_names", "SELECT text_name, row_number() OVER (ORDER BY text_name, file_id) - 1 AS place FROM text_files", "T4")
def top_sorted_names(spark: SparkSession, d: str) -> DataFrame:
    """Names in order with their places, sorted by ranges and not in one task."""
    t = table(spark, d, "text_files").select("text_name", "file_id")
    return global_rank(t, [F.coalesce("text_name", F.lit("\U0010ffff")), F.col("file_id")], name="place").select("text_name", "place")


@REGISTRY("top_first_rows", "SELECT file_id, text_name FROM text_files ORDER BY text_name, file_id LIMIT 25", "T5")
def top_first_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_files").select("file_id", "text_name").orderBy(F.col("text_name").asc_nulls_last(), "file_id").limit(25)
