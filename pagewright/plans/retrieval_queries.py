"""Scoring, ranking, page strategies and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import scalars as S
from pagewright.functions import vectors as V
from pagewright.operators import index as N
from pagewright.operators import pages as P
from pagewright.operators import ranking as M
from pagewright.operators import relational as R
from pagewright.operators import sampling as B
from pagewright.operators import vector as X
from pagewright.plans import fixtures as fx
from pagewright.plans.fixtures import PAGE_MAP, SCORES, TOKENS
from pagewright.plans.registry import Registry
from pagewright.plans.scalar_queries import STEM
from pagewright.session import table

REGISTRY = Registry()
K = "(SELECT unnest([1, 3, 5, 10]) AS k)"


def _metrics(results: str, truth: str, keys: str = "qid", asked: str | None = None) -> str:
    """SQL of the metrics per query from CTE names; results (keys, doc_id, rank), truth (keys, doc_id)."""
    asked = asked or f"SELECT DISTINCT {keys} FROM {truth}"
    return f"""pq AS (SELECT {keys}, k, coalesce(n_truth, 0) AS n_truth, coalesce(hits, 0) AS hits, first, coalesce(dcg, 0) AS dcg FROM ({asked}) CROSS JOIN {K}
  LEFT JOIN (SELECT {keys}, count(DISTINCT doc_id) AS n_truth FROM {truth} GROUP BY {keys}) USING ({keys})
  LEFT JOIN (SELECT {keys}, k, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 2)) AS dcg FROM {results} SEMI JOIN {truth} USING ({keys}, doc_id) JOIN {K} ON rank < k GROUP BY {keys}, k) USING ({keys}, k)),
metric AS (SELECT {keys}, k, hits / k AS precision, CASE WHEN n_truth > 0 THEN hits / n_truth ELSE 0 END AS recall, coalesce(1 / (first + 1), 0) AS mrr,
  CASE WHEN n_truth > 0 THEN dcg / list_sum(list_transform(range(least(n_truth, k)), lambda i: 1 / log2(i + 2))) ELSE 0 END AS ndcg FROM pq)"""


MEANS = "round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg"


FLAGSHIP = f"WITH {SCORES}, top AS (SELECT * FROM ranked WHERE rank < 10), {_metrics('top', 'gt')} SELECT k, {MEANS} FROM metric GROUP BY k"


@REGISTRY("flagship_retrieval_metrics", FLAGSHIP, "M1 M2 M3 M4 M7 A5 A16 V1 P24")
def flagship_retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """MaxSim top 10 per query and its macro-averaged metrics."""
    ranked = X.top(fx.scores(spark, d, 10), ["qid"], F.col("score"), [F.col("doc_id")], 10)
    return M.mean_metrics(M.query_metrics(ranked, fx.truth(spark, d), "qid", "doc_id"))


@REGISTRY("vec_maxsim_top10", f"WITH {SCORES} SELECT qid, doc_id, round(s, 6) AS score, rank FROM ranked WHERE rank < 10", "V1 V6 V12 J13 A16 T1")
def vec_maxsim_top10(spark: SparkSession, d: str) -> DataFrame:
    ranked = X.top(fx.scores(spark, d, 10), ["qid"], F.col("score"), [F.col("doc_id")], 10)
    return ranked.select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _singles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "embeddings").select("vec_id", F.array(V.normalised(V.as_double(F.col("embedding")))).alias("vectors"))
    return t, t.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")


UNIT = "u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"


@REGISTRY("vec_cosine_top10", f"WITH {UNIT}, s AS (SELECT a.vec_id AS qid, b.vec_id, list_inner_product(a.v, b.v) AS s FROM u a, u b WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, vec_id) - 1 AS rank FROM s) SELECT qid, vec_id, round(s, 6) AS score, rank FROM r WHERE rank < 10", "V2 T2")
def vec_cosine_top10(spark: SparkSession, d: str) -> DataFrame:
    docs, queries = _singles(spark, d)
    top = X.maxsim(docs, queries, "vec_id", "qid", 10)
    return X.top(top, ["qid"], F.col("score"), [F.col("vec_id")], 10).select("qid", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@REGISTRY("vec_score_matrix", f"WITH {SCORES} SELECT qid, doc_id, round(s, 6) AS score FROM score", "V3")
def vec_score_matrix(spark: SparkSession, d: str) -> DataFrame:
    return fx.scores(spark, d).select("qid", "doc_id", F.round("score", 6).alias("score"))


SHORT = "s AS (SELECT * FROM doc_tok WHERE tok < 3 + doc_id % 5)"


@REGISTRY("vec_padded_scores", f"WITH {TOKENS}, {SHORT}, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT doc_id, max(n) OVER (PARTITION BY (row_number - 1) // 8) > n AS padded FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS row_number FROM n)), m AS (SELECT q.qid, q.tok, t.doc_id, max(list_inner_product(q.e, t.e)) AS m FROM query_tok q, s t GROUP BY ALL) SELECT qid, doc_id, round(sum(CASE WHEN padded THEN greatest(m, 0) ELSE m END), 6) AS score FROM m JOIN p USING (doc_id) GROUP BY qid, doc_id", "V3")
def vec_padded_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores as blocks of 8 zero-padded documents give them."""
    docs = X.pack(fx.doc_tokens(spark, d).where("tok < 3 + doc_id % 5"), "doc_id", "tok", "e")
    return X.maxsim(docs, X.pack(fx.query_tokens(spark, d), "qid", "tok", "e"), "doc_id", "qid", zero_pad_block=8).select("qid", "doc_id", F.round("score", 6).alias("score"))


@REGISTRY("vec_single_scores", f"WITH {UNIT} SELECT a.vec_id AS qid, b.vec_id, round(list_inner_product(a.v, b.v), 6) AS score FROM u a, u b WHERE a.vec_id % 20 = 0", "V4")
def vec_single_scores(spark: SparkSession, d: str) -> DataFrame:
    docs, queries = _singles(spark, d)
    return X.maxsim(docs, queries, "vec_id", "qid").select("qid", "vec_id", F.round("score", 6).alias("score"))


@REGISTRY("vec_page_documents", f"WITH {SCORES}, {PAGE_MAP}, a AS (SELECT qid, document, max(s) AS best, avg(s) AS mean FROM ranked JOIN page_map USING (doc_id) WHERE rank < 300 GROUP BY ALL) SELECT qid, document, round(best, 6) AS best, round(mean, 6) AS mean, row_number() OVER (PARTITION BY qid ORDER BY round(best, 6) DESC, document) - 1 AS rank FROM a QUALIFY rank < 10", "T3 A4 V8")
def vec_page_documents(spark: SparkSession, d: str) -> DataFrame:
    """The best 300 pages of each query, then their documents by best score; the mean sees those pages only."""
    cut, pages = fx.scores(spark, d, 300), fx.page_map(spark, d)
    both = X.pages_to_documents(cut, pages, "qid", "doc_id", best="max", mean="avg")
    ranked = X.top(both, ["qid"], F.col("best"), [F.col("document")], 10)
    return ranked.select("qid", "document", F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean"), F.col("rank").cast("bigint").alias("rank"))


@REGISTRY("vec_similarity_map", f"WITH {TOKENS} SELECT q.tok AS q_tok, t.pos % 8 AS x, t.pos // 8 AS y, round(list_inner_product(q.e, t.e), 6) AS sim FROM query_tok q, (SELECT vec_id AS pos, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 64) t WHERE q.qid = 0", "V9 K8")
def vec_similarity_map(spark: SparkSession, d: str) -> DataFrame:
    q = fx.query_tokens(spark, d).where("qid = 0").select(F.col("tok").alias("q_tok"), "e")
    patches = table(spark, d, "embeddings").where("vec_id < 64").select(F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("e"))
    return X.similarity_map(q, patches, 8).select("q_tok", "x", "y", F.round("sim", 6).alias("sim"))


@REGISTRY("vec_exploded_tokens", "SELECT vec_id // 10 AS doc_id, (vec_id % 10)::SMALLINT AS seq_id, embedding[1] AS first FROM embeddings", "K3 S21 S11")
def vec_exploded_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Packed documents as one row per token, as a vector table holds them."""
    packed = X.pack(fx.doc_tokens(spark, d), "doc_id", "tok", "e")
    return packed.select("doc_id", F.posexplode("vectors").alias("p", "v")).select("doc_id", F.col("p").cast("smallint").alias("seq_id"), F.col("v")[0].cast("float").alias("first"))


STRATEGIES = """n AS (SELECT document_name AS doc, count(DISTINCT page_name)::INTEGER AS n FROM image_page_metadata WHERE page_name <> document_name GROUP BY 1),
i AS (SELECT doc, n, unnest(range(n)) AS i FROM n),
chosen AS (
  SELECT 'first4' AS strategy, doc, i FROM i WHERE i < 4 UNION ALL SELECT 'first9', doc, i FROM i WHERE i < 9 UNION ALL SELECT 'all_pages', doc, i FROM i
  UNION ALL SELECT 'first2_last2', doc, i FROM i WHERE n < 4 OR i < 2 OR i >= n - 2 UNION ALL SELECT 'last4', doc, i FROM i WHERE i >= n - 4
  UNION ALL SELECT 'uniform4', doc, i FROM i WHERE n < 4 OR list_contains([round(0.0), round((n - 1) / 3), round(2 * (n - 1) / 3), n - 1], i::DOUBLE)
  UNION ALL SELECT 'random4', doc, i FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY md5(doc || ':' || i)) AS r FROM i) WHERE r <= 4)"""


@REGISTRY("page_strategies", f"WITH {STRATEGIES} SELECT strategy, doc, i::INTEGER AS page_index FROM chosen", "PS1 PS2 PS3 PS4 PS5 PS6")
def page_strategies(spark: SparkSession, d: str) -> DataFrame:
    docs = P.page_counts(table(spark, d, "image_page_metadata"), "document_name", "page_name").withColumnRenamed("document_name", "doc")
    return P.strategy_table(docs, "doc", "n_pages")


def _tile_sql(s: str) -> str:
    short = "CASE n WHEN 1 THEN [0, 0, 0, 0] WHEN 2 THEN [0, 1, 1, 0] WHEN 3 THEN [0, 1, 2, 2] ELSE {0} END"
    return {
        "first4": "list_transform(range(4), lambda i: CASE WHEN i < n THEN i END)", "first1": "[0]", "first9": "list_transform(range(9), lambda i: i % n)", "first16": "list_transform(range(16), lambda i: i % n)",
        "last4": short.format("[n - 4, n - 3, n - 2, n - 1]"), "first2_last2": short.format("[0, 1, n - 2, n - 1]"), "uniform4": "list_transform(range(4), lambda i: least(round(i * (n - 1) / 3), n - 1))",
        "random4": "CASE WHEN n >= 4 THEN list_transform(list_sort(list_transform(range(n), lambda i: {'h': md5(doc || ':' || i), 'i': i}))[1:4], lambda s: s.i) ELSE list_transform(range(4), lambda i: ('0x' || substr(md5(doc || ':' || i), 1, 8))::BIGINT % 1073741824 % n) END",
    }[s]


TILES = " UNION ALL ".join(f"SELECT '{s}' AS strategy, doc, {c} AS columns, {_tile_sql(s)}::INTEGER[] AS t FROM n" for s, (_, c) in P.COMPOSED.items())


@REGISTRY(
    "page_tiles",
    f"WITH n AS (SELECT document_name AS doc, count(DISTINCT page_name)::INTEGER AS n FROM image_page_metadata WHERE page_name <> document_name GROUP BY 1), x AS (SELECT strategy, doc, columns, unnest(t) AS page_index, unnest(range(len(t)))::INTEGER AS tile FROM ({TILES})) SELECT strategy, doc, tile, page_index, ((tile % columns) * 1275)::INTEGER AS x, ((tile // columns) * 1650)::INTEGER AS y FROM x",
    "PS7 PS8 PS9 PS10 PS11 PS12 PS14",
)
def page_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of composed pictures; a null page is a blank tile."""
    docs = P.page_counts(table(spark, d, "image_page_metadata"), "document_name", "page_name").withColumnRenamed("document_name", "doc")
    plans = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(c).alias("columns"), P.composed_tiles(s, F.col("n_pages"), F.col("doc")).alias("t")) for s, (_, c) in P.COMPOSED.items()])
    t = docs.select("doc", F.explode(plans).alias("x")).select("x.strategy", "doc", "x.columns", F.posexplode("x.t").alias("tile", "page_index"))
    _, _, left, above = P.tile_place(F.col("tile"), F.col("columns"))
    return t.select("strategy", "doc", "tile", "page_index", left.alias("x"), above.alias("y"))


NUMBER = f"coalesce(try_cast(nullif(regexp_extract({STEM.format('page_name')}, '_([0-9]+)$', 1), '') AS INTEGER), 0)"


@REGISTRY("scan_ordered_pages", f"SELECT document_name, page_name, (row_number() OVER (PARTITION BY document_name ORDER BY {NUMBER}, page_id) - 1)::INTEGER AS page_index FROM image_page_metadata WHERE page_name <> document_name", "S19")
def scan_ordered_pages(spark: SparkSession, d: str) -> DataFrame:
    return P.ordered_pages(table(spark, d, "image_page_metadata"), "document_name", "page_name", S.page_number(S.file_stem(F.col("page_name"))), "page_id")


@REGISTRY("scan_document_pages", "SELECT document_name, list(page_name ORDER BY page_id) AS pages FROM image_page_metadata WHERE document_name <> '' AND page_name IS NOT NULL GROUP BY 1", "S18")
def scan_document_pages(spark: SparkSession, d: str) -> DataFrame:
    """All pages of a document in order of arrival, own rows and empty names kept."""
    t = table(spark, d, "image_page_metadata").where("document_name <> '' AND page_name IS NOT NULL")
    return t.groupBy("document_name").agg(F.array_sort(F.collect_list(F.struct("page_id", "page_name"))).alias("x")).select("document_name", F.col("x.page_name").alias("pages"))


PAGED = f"""{SCORES}, {PAGE_MAP}, np AS (SELECT document, count(*) AS n FROM page_map GROUP BY 1),
pg AS (SELECT doc_id, document, row_number() OVER (PARTITION BY document ORDER BY doc_id) - 1 AS i, n FROM page_map JOIN np USING (document)),
strat AS (SELECT 'first4' AS strategy, doc_id, document FROM pg WHERE i < 4 UNION ALL SELECT 'last4', doc_id, document FROM pg WHERE i >= n - 4 UNION ALL SELECT 'first2_last2', doc_id, document FROM pg WHERE n < 4 OR i < 2 OR i >= n - 2
  UNION ALL SELECT 'uniform4', doc_id, document FROM pg WHERE n < 4 OR list_contains([0.0, round((n - 1) / 3), round(2 * (n - 1) / 3), n - 1], i::DOUBLE)),
sd AS (SELECT strategy, qid, document AS doc_id, max(s) AS s FROM score JOIN strat USING (doc_id) GROUP BY ALL),
sr AS (SELECT strategy, qid, doc_id, s, row_number() OVER (PARTITION BY strategy, qid ORDER BY round(s, 6) DESC, doc_id) - 1 AS rank FROM sd QUALIFY rank < 10)"""
PAGED_STRATEGIES = ("first4", "last4", "first2_last2", "uniform4")


def _strategy_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Pages know the strategies that choose them; of each batch only the best score per strategy, query and document leaves the worker."""
    pages = fx.page_map(spark, d)
    docs = pages.groupBy("document").agg(F.count("*").cast("int").alias("n"))
    place = (F.row_number().over(Window.partitionBy("document").orderBy("doc_id")) - 1).cast("int")
    chosen = P.strategy_table(docs, "document", "n", PAGED_STRATEGIES).join(pages.withColumn("page_index", place), ["document", "page_index"])
    of = chosen.groupBy("doc_id", "document").agg(F.collect_list("strategy").alias("groups"))
    packed = X.pack(fx.doc_tokens(spark, d), "doc_id", "tok", "e").join(of, "doc_id").select(F.col("document").alias("doc_id"), "vectors", "groups")
    by_doc = X.maxsim(packed, X.pack(fx.query_tokens(spark, d), "qid", "tok", "e"), "doc_id", "qid", group="strategy")
    return X.top(by_doc, ["strategy", "qid"], F.col("score"), [F.col("doc_id")], 10)


@REGISTRY("page_strategy_search", f"WITH {PAGED} SELECT strategy, qid, doc_id, round(s, 6) AS score, rank FROM sr", "V7 V11")
def page_strategy_search(spark: SparkSession, d: str) -> DataFrame:
    """Every page is scored once; strategies are a table that says whose pages count."""
    return _strategy_ranks(spark, d).select("strategy", "qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@REGISTRY("page_strategy_metrics", f"WITH {PAGED}, dt AS (SELECT DISTINCT strategy, qid, document AS doc_id FROM gt JOIN page_map USING (doc_id), (SELECT DISTINCT strategy FROM strat)), {_metrics('sr', 'dt', 'strategy, qid')} SELECT strategy, k, {MEANS} FROM metric GROUP BY strategy, k", "A13 M7 K7")
def page_strategy_metrics(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.truth(spark, d).join(fx.page_map(spark, d), "doc_id").select("qid", F.col("document").alias("doc_id")).distinct()
    truth = docs.select("*", F.explode(F.array(*[F.lit(s) for s in PAGED_STRATEGIES])).alias("strategy"))
    return M.mean_metrics(M.query_metrics(_strategy_ranks(spark, d), truth, "qid", "doc_id", groups=("strategy",)), ("strategy", "k"))


PAGE_RANKS = "pr AS (SELECT qid, doc_id AS page, rank FROM ranked WHERE rank < 30), dgt AS (SELECT DISTINCT qid, document AS doc_id FROM gt JOIN page_map USING (doc_id)), fr AS (SELECT qid, document AS doc_id, min(rank) AS rank FROM pr JOIN page_map ON page = page_map.doc_id GROUP BY ALL)"


@REGISTRY("metric_page_aware", f"WITH {SCORES}, {PAGE_MAP}, {PAGE_RANKS}, {_metrics('fr', 'dgt')} SELECT k, {MEANS} FROM metric GROUP BY k", "M5")
def metric_page_aware(spark: SparkSession, d: str) -> DataFrame:
    """Results are pages; a document counts at its first page."""
    pages = fx.page_map(spark, d)
    truth = fx.truth(spark, d).join(pages, "doc_id").select("qid", F.col("document").alias("doc_id")).distinct()
    ranked = X.top(fx.scores(spark, d, 30), ["qid"], F.col("score"), [F.col("doc_id")], 30).drop("score")
    return M.mean_metrics(M.query_metrics(ranked, truth, "qid", "doc_id", page_docs=pages.withColumnRenamed("doc_id", "page")))


@REGISTRY("metric_deduplicated", f"WITH {SCORES}, twice AS (SELECT qid, doc_id, rank FROM ranked WHERE rank < 10 UNION ALL SELECT qid, doc_id, rank + 10 FROM ranked WHERE rank < 3), dd AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY at_rank) - 1 AS rank FROM (SELECT qid, doc_id, min(rank) AS at_rank FROM twice GROUP BY qid, doc_id)), {_metrics('dd', 'gt')} SELECT qid, k, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM metric", "M6 P8")
def metric_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Repeated predictions count at their first place; here the first three come again at the end."""
    ten = X.top(fx.scores(spark, d, 10), ["qid"], F.col("score"), [F.col("doc_id")], 10).select("qid", "doc_id", "rank")
    twice = ten.unionByName(ten.where("rank < 3").withColumn("rank", F.col("rank") + 10))
    per = M.query_metrics(M.deduplicated(twice, "qid", "doc_id"), fx.truth(spark, d), "qid", "doc_id")
    return per.select("qid", "k", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "mrr", "ndcg")])


SOME = "fewer AS (SELECT * FROM gt WHERE qid % 3 <> 0)"


@REGISTRY("metric_empty_truth", f"WITH {SCORES}, {SOME}, t AS (SELECT * FROM ranked WHERE rank < 10), {_metrics('t', 'fewer', 'qid', 'SELECT DISTINCT qid FROM query_tok')} SELECT k, {MEANS}, count(*) FILTER (n = 0) AS without_truth FROM metric LEFT JOIN (SELECT q.qid, count(s.doc_id) AS n FROM (SELECT DISTINCT qid FROM query_tok) q LEFT JOIN fewer s USING (qid) GROUP BY 1) USING (qid) GROUP BY k", "M7 A7 F6")
def metric_empty_truth(spark: SparkSession, d: str) -> DataFrame:
    """Queries without a truth count as zero and are reported."""
    some, queries = fx.truth(spark, d).where("qid % 3 <> 0"), fx.query_tokens(spark, d).select("qid").distinct()
    per = M.query_metrics(X.top(fx.scores(spark, d, 10), ["qid"], F.col("score"), [F.col("doc_id")], 10), some, "qid", "doc_id", queries=queries)
    n = queries.join(some.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left")
    return per.join(n, "qid").groupBy("k").agg(*[F.round(F.avg(m), 4).alias(m) for m in ("precision", "recall", "mrr", "ndcg")], F.count_if(F.col("n").isNull()).alias("without_truth"))


@REGISTRY("metric_by_page_group", f"WITH {SCORES}, {PAGE_MAP}, np AS (SELECT document, count(*) AS n FROM page_map GROUP BY 1), grp AS (SELECT document, CASE WHEN n <= 3 THEN 'short' WHEN n <= 9 THEN 'middle' ELSE 'long' END AS page_group FROM np), dr AS (SELECT qid, document, max(s) AS s FROM score JOIN page_map USING (doc_id) GROUP BY ALL), rk AS (SELECT qid, document AS doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, document) - 1 AS rank FROM dr), gg AS (SELECT DISTINCT page_group, qid, document AS doc_id FROM gt JOIN page_map USING (doc_id) JOIN grp USING (document)), rr AS (SELECT page_group, qid, doc_id, rank FROM rk, (SELECT DISTINCT page_group FROM grp)), {_metrics('rr', 'gg', 'page_group, qid')} SELECT page_group, k, {MEANS}, count(*) AS n_queries FROM metric GROUP BY page_group, k", "M8 J11 J12")
def metric_by_page_group(spark: SparkSession, d: str) -> DataFrame:
    """Truth restricted to documents of a page-count group; the ranking stays that of all."""
    pages = fx.page_map(spark, d)
    grouped = pages.groupBy("document").agg(F.count("*").alias("n")).select("document", F.when(F.col("n") <= 3, "short").when(F.col("n") <= 9, "middle").otherwise("long").alias("page_group"))
    ranked = X.top(X.pages_to_documents(fx.scores(spark, d), pages, "qid", "doc_id", score="max"), ["qid"], F.col("score"), [F.col("document")], 10).select("qid", F.col("document").alias("doc_id"), "rank")
    truth = fx.truth(spark, d).join(pages, "doc_id").join(grouped, "document").select("page_group", "qid", F.col("document").alias("doc_id")).distinct()
    results = ranked.select("*", F.explode(F.array(*[F.lit(g) for g in ("short", "middle", "long")])).alias("page_group"))
    per = M.query_metrics(results, truth, "qid", "doc_id", groups=("page_group",))
    return per.groupBy("page_group", "k").agg(*[F.round(F.avg(m), 4).alias(m) for m in ("precision", "recall", "mrr", "ndcg")], F.count("*").alias("n_queries"))


RATIOS = (0.2, 0.4, 0.6, 0.8, 1.0)
POOLS = "docs AS (SELECT DISTINCT doc_id FROM doc_tok), sh AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS r, count(*) OVER () AS n FROM docs), pool AS (SELECT ratio, doc_id FROM sh, (SELECT unnest([0.2, 0.4, 0.6, 0.8, 1.0]::DOUBLE[]) AS ratio) WHERE r < CASE WHEN ratio >= 1 THEN n ELSE greatest(1, floor(n * ratio)) END)"


@REGISTRY("sample_nested_pools", f"WITH {TOKENS}, {POOLS} SELECT ratio, doc_id FROM pool", "B2")
def sample_nested_pools(spark: SparkSession, d: str) -> DataFrame:
    return B.nested_pools(fx.doc_tokens(spark, d).select("doc_id").distinct(), "doc_id", list(RATIOS))


@REGISTRY("metric_scale_gradient", f"WITH {SCORES}, {POOLS}, sp AS (SELECT ratio, qid, doc_id, row_number() OVER (PARTITION BY ratio, qid ORDER BY round(s, 6) DESC, doc_id) - 1 AS rank FROM score JOIN pool USING (doc_id)), pg AS (SELECT ratio, qid, doc_id FROM gt JOIN pool USING (doc_id)), {_metrics('sp', 'pg', 'ratio, qid')} SELECT ratio, k, {MEANS}, count(*) AS valid_queries FROM metric GROUP BY ratio, k", "M9 A15 F7")
def metric_scale_gradient(spark: SparkSession, d: str) -> DataFrame:
    """Metrics over nested pools; documents are scored once and know their pools, and only the best of each pool leave the workers."""
    pool = B.nested_pools(fx.doc_tokens(spark, d).select("doc_id").distinct(), "doc_id", list(RATIOS))
    of = pool.groupBy("doc_id").agg(F.collect_list(F.col("ratio").cast("string")).alias("groups"))
    packed = X.pack(fx.doc_tokens(spark, d), "doc_id", "tok", "e").join(of, "doc_id")
    scored = X.maxsim(packed, X.pack(fx.query_tokens(spark, d), "qid", "tok", "e"), "doc_id", "qid", top_k=10, group="ratio").withColumn("ratio", F.col("ratio").cast("double"))
    ranked = X.top(scored, ["ratio", "qid"], F.col("score"), [F.col("doc_id")], 10)
    per = M.query_metrics(ranked, fx.truth(spark, d).join(pool, "doc_id"), "qid", "doc_id", groups=("ratio",))
    return per.groupBy("ratio", "k").agg(*[F.round(F.avg(m), 4).alias(m) for m in ("precision", "recall", "mrr", "ndcg")], F.count("*").alias("valid_queries"))


@REGISTRY("metric_two_rankings", f"WITH {SCORES}, o AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY md5(qid || '/' || doc_id)) - 1 AS rank FROM score), both_r AS (SELECT 'maxsim' AS method, qid, doc_id, rank FROM ranked WHERE rank < 10 UNION ALL SELECT 'shuffled', qid, doc_id, rank FROM o WHERE rank < 10), mg AS (SELECT method, qid, doc_id FROM gt, (SELECT unnest(['maxsim', 'shuffled']) AS method)), {_metrics('both_r', 'mg', 'method, qid')}, cat AS (SELECT method, qid % 3 AS category, k, {MEANS} FROM metric GROUP BY ALL) SELECT method, k, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM cat GROUP BY method, k", "M10 A6")
def metric_two_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings side by side: means per category, rounded, and their unweighted mean."""
    scored = fx.scores(spark, d)
    a = X.top(fx.scores(spark, d, 10), ["qid"], F.col("score"), [F.col("doc_id")], 10).select(F.lit("maxsim").alias("method"), "qid", "doc_id", "rank")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.md5(F.concat(F.col("qid").cast("string"), F.lit("/"), F.col("doc_id").cast("string")))))
    b = scored.withColumn("place", place).where("place <= 10").withColumn("rank", F.col("place") - 1).select(F.lit("shuffled").alias("method"), "qid", "doc_id", "rank")
    truth = fx.truth(spark, d).select("*", F.explode(F.array(F.lit("maxsim"), F.lit("shuffled"))).alias("method"))
    per = M.query_metrics(a.unionByName(b), truth, "qid", "doc_id", groups=("method",))
    return M.mean_metrics(M.mean_metrics(per.withColumn("category", F.col("qid") % 3), ("method", "category", "k")), ("method", "k"))


@REGISTRY("sample_sized_pool", f"WITH {TOKENS}, pos AS (SELECT DISTINCT doc_id FROM gt WHERE qid < 60), docs AS (SELECT DISTINCT doc_id FROM doc_tok), neg AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r FROM docs ANTI JOIN pos USING (doc_id)) SELECT doc_id, true AS positive FROM pos UNION ALL SELECT doc_id, false FROM neg WHERE r <= least(greatest(30, (SELECT count(*) FROM pos)), (SELECT count(*) FROM docs)) - (SELECT count(*) FROM pos)", "B3 V10")
def sample_sized_pool(spark: SparkSession, d: str) -> DataFrame:
    pos = fx.truth(spark, d).where("qid < 60").select("doc_id").distinct().withColumn("p", F.lit(True))
    docs = fx.doc_tokens(spark, d).select("doc_id").distinct().join(pos, "doc_id", "left").select("doc_id", F.coalesce("p", F.lit(False)).alias("positive"))
    return B.sized_pool(docs, "doc_id", "positive", 30)


@REGISTRY("vec_indexed_top10", None, "V5")
def vec_indexed_top10(spark: SparkSession, d: str) -> DataFrame:
    """Top 10 of every query over candidates of a centroid index; its recall against brute force is tested."""
    tokens, queries = fx.doc_tokens(spark, d), X.pack(fx.query_tokens(spark, d, every=True), "qid", "tok", "e")
    index = N.build(tokens, "doc_id", "tok", "e", 16)
    return N.search(index, X.pack(tokens, "doc_id", "tok", "e"), queries, "doc_id", "qid", 10)


@REGISTRY("scan_last_results", "SELECT coalesce(category, 'none') AS category, query, arg_max(pos_target, query_id) AS results FROM query_list WHERE query IS NOT NULL AND pos_target IS NOT NULL GROUP BY 1, 2", "S15")
def scan_last_results(spark: SparkSession, d: str) -> DataFrame:
    """Results per category and query; of repeats the last, rows without either left out."""
    t = table(spark, d, "query_list").where("query IS NOT NULL AND pos_target IS NOT NULL").select(F.coalesce("category", F.lit("none")).alias("category"), "query", F.col("pos_target").alias("results"), "query_id")
    return R.last_wins(t, ["category", "query"], ["results"], "query_id")
