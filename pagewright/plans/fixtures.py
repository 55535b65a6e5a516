"""Views of the tables that stand for encoded pages, queries and truths; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import vector as X
from pagewright.session import table

TOKENS = """doc_tok AS (SELECT vec_id // 10 AS doc_id, vec_id % 10 AS tok, label, embedding::DOUBLE[] AS e FROM embeddings),
query_tok AS (SELECT vec_id // 4 AS qid, vec_id % 4 AS tok, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id // 4 % 20 = 0),
gt AS (SELECT q.qid, t.doc_id FROM query_tok q JOIN doc_tok t ON q.tok = 0 AND t.tok = 0 AND q.label = t.label)"""
SCORES = f"""{TOKENS},
best AS (SELECT q.qid, q.tok, t.doc_id, max(list_inner_product(q.e, t.e)) AS m FROM query_tok q, doc_tok t GROUP BY ALL),
score AS (SELECT qid, doc_id, sum(m) AS s FROM best GROUP BY ALL),
ranked AS (SELECT qid, doc_id, s, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, doc_id) - 1 AS rank FROM score)"""
PAGE_MAP = "page_map AS (SELECT DISTINCT vec_id // 10 AS doc_id, floor(sqrt((vec_id // 10)::DOUBLE))::BIGINT AS document FROM embeddings)"


def _ints(n: int) -> F.Column:
    return F.floor(F.col("vec_id") / n).cast("bigint")


def doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(_ints(10).alias("doc_id"), (F.col("vec_id") % 10).alias("tok"), "label", F.col("embedding").cast("array<double>").alias("e"))


def query_tokens(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    """Four rows are a query. Searches ask those whose number is divisible by 20, against all rows; with ``every`` all queries."""
    t = table(spark, d, "embeddings")
    return (t if every else t.where(F.floor(F.col("vec_id") / 4) % 20 == 0)).select(_ints(4).alias("qid"), (F.col("vec_id") % 4).alias("tok"), "label", F.col("embedding").cast("array<double>").alias("e"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    q = query_tokens(spark, d).where("tok = 0").select("qid", "label")
    return q.join(doc_tokens(spark, d).where("tok = 0").select("doc_id", "label"), "label").select("qid", "doc_id")


def page_map(spark: SparkSession, d: str) -> DataFrame:
    return doc_tokens(spark, d).select("doc_id").distinct().withColumn("document", F.floor(F.sqrt(F.col("doc_id").cast("double"))).cast("bigint"))


def scores(spark: SparkSession, d: str, top_k: int | None = None) -> DataFrame:
    docs, queries = X.pack(doc_tokens(spark, d), "doc_id", "tok", "e"), X.pack(query_tokens(spark, d), "qid", "tok", "e")
    return X.maxsim(docs, queries, "doc_id", "qid", top_k)
