"""Queries on references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import references as refs
from pagewright.plans.registry import Registry
from pagewright.session import cut, table

REGISTRY = Registry()

STEM = r"regexp_replace(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^(.|\n)*[/\\]', ''), '\.(txt|png|pdf)$', '')"
FOUND = f"""
WITH t AS (SELECT {STEM.format('text_name')} AS name, registered_at AS born, deleted_at AS died FROM text_files),
raw AS (
  SELECT 'query_list' AS src_table, 'pos_target_for_deepseek' AS src_field, query_id AS row_id, v, created_at AS tm FROM (SELECT query_id, created_at, unnest(pos_target_for_deepseek) AS v FROM query_list)
  UNION ALL SELECT 'image_page_metadata', 'page_name', page_id, page_name, rendered_at FROM image_page_metadata
  UNION ALL SELECT 'image_page_metadata', 'document_name', page_id, document_name, rendered_at FROM image_page_metadata),
r AS (SELECT DISTINCT src_table, src_field, row_id, {STEM.format('v')} AS ref_name, tm FROM raw WHERE v IS NOT NULL AND regexp_replace(v, '^\\s+|\\s+$', '', 'g') <> ''),
n AS (SELECT *, ref_name AS name FROM r UNION SELECT *, regexp_replace(ref_name, '_[0-9]+$', '') FROM r WHERE src_field = 'page_name'),
s AS (SELECT DISTINCT src_table, src_field, row_id, ref_name FROM n JOIN t USING (name) WHERE tm IS NULL OR (born <= tm AND (died IS NULL OR died > tm)))
SELECT src_table, src_field, row_id, ref_name, coalesce(strftime(tm, '%Y-%m'), 'unknown') AS month_key FROM r ANTI JOIN s USING (src_table, src_field, row_id, ref_name)
"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    queries, pages, files = (table(spark, d, t) for t in ("query_list", "image_page_metadata", "text_files"))
    return refs.orphan_references(refs.text_references(queries, pages), refs.text_spans(files))


@REGISTRY("p6_found", FOUND)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Direct orphan references."""
    return _found(spark, d).select("src_table", "src_field", "row_id", "ref_name", refs.month_key(F.col("at")).alias("month_key"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    """(src_table, row_id, month_key, kind, depth): rows that hold an orphan reference (direct) or hang on one that does (inherited), and how many steps away."""
    queries, pages, texts = (table(spark, d, t) for t in ("query_list", "image_page_metadata", "data_text_with_cluster_ids"))
    reached = refs.cascade(refs.orphan_nodes(_found(spark, d)), refs.record_edges(queries, pages, texts))

    def rows(df: DataFrame, name: str, key: str, at: str | None) -> DataFrame:
        return df.select(F.lit(name).alias("src_table"), F.col(key).alias("row_id"), (F.col(at) if at else F.lit(None).cast("timestamp_ntz")).alias("at"))

    every = rows(queries, "query_list", "query_id", "created_at").unionByName(rows(pages, "image_page_metadata", "page_id", "rendered_at")).unionByName(rows(texts, "data_text_with_cluster_ids", "record_id", None))
    every = every.withColumn("node", refs.node(F.col("src_table"), F.col("row_id")))
    kind = F.when(F.col("depth") == 0, "direct").otherwise("inherited").alias("kind")
    return every.join(reached, "node").select("src_table", "row_id", refs.month_key(F.col("at")).alias("month_key"), kind, "depth")


NORM = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
ROWS = f"""
WITH RECURSIVE found AS ({FOUND}),
pg AS (SELECT 'image_page_metadata:' || page_id AS row, {STEM.format('page_name')} AS page, {STEM.format('document_name')} AS doc FROM image_page_metadata WHERE document_name IS NOT NULL),
edge AS (
  SELECT 'document:' || doc AS child, row AS parent FROM pg WHERE doc <> '' AND page = doc
  UNION SELECT row, 'document:' || doc FROM pg WHERE doc <> '' AND (page IS NULL OR page <> doc)
  UNION SELECT 'query_list:' || query_id, 'document:' || {STEM.format('v')} FROM (SELECT query_id, unnest(pos_target_for_deepseek) AS v FROM query_list) WHERE v IS NOT NULL
  UNION SELECT 'query:' || {NORM.format('query')}, 'query_list:' || query_id FROM query_list WHERE {NORM.format('query')} <> ''
  UNION SELECT 'data_text_with_cluster_ids:' || record_id, 'query:' || {NORM.format('v')} FROM (SELECT record_id, unnest(querys) AS v FROM data_text_with_cluster_ids) WHERE {NORM.format('v')} <> ''),
reach(node, depth) AS (SELECT DISTINCT src_table || ':' || row_id, 0 FROM found UNION SELECT child, depth + 1 FROM reach JOIN edge ON parent = node WHERE depth < 12),
least_depth AS (SELECT node, min(depth)::INTEGER AS depth FROM reach GROUP BY node),
rws AS (SELECT 'query_list' AS src_table, query_id AS row_id, created_at AS tm FROM query_list UNION ALL SELECT 'image_page_metadata', page_id, rendered_at FROM image_page_metadata UNION ALL SELECT 'data_text_with_cluster_ids', record_id, NULL FROM data_text_with_cluster_ids)
SELECT src_table, row_id, coalesce(strftime(tm, '%Y-%m'), 'unknown') AS month_key, CASE depth WHEN 0 THEN 'direct' ELSE 'inherited' END AS kind, depth FROM rws JOIN least_depth ON node = src_table || ':' || row_id
"""


@REGISTRY("p6_orphan_rows", ROWS)
def p6_orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


@REGISTRY("p6_report", f"SELECT src_table, month_key, count(*) FILTER (kind = 'direct') AS direct_rows, count(*) FILTER (kind = 'inherited') AS inherited_rows, max(depth) AS deepest FROM ({ROWS}) GROUP BY ALL")
def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per table and month, and the most steps from a direct one."""
    counts = [F.count_if(F.col("kind") == k).alias(f"{k}_rows") for k in ("direct", "inherited")]
    return _orphans(spark, d).groupBy("src_table", "month_key").agg(*counts, F.max("depth").alias("deepest"))
