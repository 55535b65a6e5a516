"""Sampling, batches, losses, clusters and groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import vectors as V
from pagewright.functions.scalars import has_extension
from pagewright.operators import cluster as C
from pagewright.operators import collate as L
from pagewright.operators import grouping as G
from pagewright.operators import losses as X
from pagewright.operators import sampling as B
from pagewright.operators.vector import pack
from pagewright.operators.vector import pair_scores
from pagewright.plans import fixtures as fx
from pagewright.plans.fixtures import TOKENS
from pagewright.plans.registry import Registry
from pagewright.session import cut, table

REGISTRY = Registry()


def _md5(key: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || {key})"


# sampling


@REGISTRY("sample_train_eval", f"SELECT query_id, CASE WHEN row_number() OVER (ORDER BY {_md5('query_id')}, query_id) > count(*) OVER () - floor(count(*) OVER () * 0.1) THEN 'eval' ELSE 'train' END AS part FROM query_list", "B1")
def sample_train_eval(spark: SparkSession, d: str) -> DataFrame:
    return B.train_eval(table(spark, d, "query_list").select("query_id"), "query_id", 0.1)


CHOICE = "list_transform(list_sort(list_transform(list_sort(list_transform(range(1, len(pos_target) + 1), lambda i: {{'h': md5('42:' || query_id || ':' || (i - 1)), 'i': i}}))[1:{n}], lambda s: s.i)), lambda i: pos_target[i])"
LISTED = "SELECT query_id, pos_target FROM query_list WHERE len(pos_target) > 0"


@REGISTRY("sample_some_positives", f"SELECT query_id, {CHOICE.format(n=2)} AS few, pos_target[1:2] AS first_ones FROM ({LISTED})", "B4")
def sample_some_positives(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "query_list").where(F.size("pos_target") > 0)
    return t.select("query_id", B.some_of_each(t, "pos_target", "query_id", 2).alias("few"), B.some_of_each(t, "pos_target", "query_id", 2, "all").alias("first_ones"))


BATCHED = f"""n AS (SELECT source, query_id, row_number() OVER (PARTITION BY source ORDER BY {_md5('query_id', 8)}, query_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM query_list WHERE source IS NOT NULL),
f AS (SELECT source, query_id, r % 16 AS slot, r // 16 AS batch FROM n WHERE r < n // 16 * 16),
o AS (SELECT source, batch, row_number() OVER (ORDER BY {_md5("source || '/' || batch", 8)}, source, batch) - 1 AS batch_order FROM (SELECT DISTINCT source, batch FROM f))"""


@REGISTRY("sample_source_batches", f"WITH {BATCHED} SELECT batch_order, source, query_id, slot::INTEGER AS slot FROM f JOIN o USING (source, batch)", "B5")
def sample_source_batches(spark: SparkSession, d: str) -> DataFrame:
    return B.single_source_batches(table(spark, d, "query_list").where("source IS NOT NULL"), "source", "query_id", 16, 7, epoch=1)


@REGISTRY("sample_whole_batches", "SELECT source, query_id FROM (SELECT source, query_id, row_number() OVER (PARTITION BY source ORDER BY query_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM query_list WHERE source IS NOT NULL) WHERE r < n // 32 * 32", "B6")
def sample_whole_batches(spark: SparkSession, d: str) -> DataFrame:
    return B.whole_batches(table(spark, d, "query_list").where("source IS NOT NULL").select("source", "query_id"), "source", "query_id", 32)


@REGISTRY("sample_holdout", "SELECT query_id, CASE WHEN row_number() OVER (ORDER BY query_id) <= 100 THEN 'eval' ELSE 'train' END AS part FROM query_list", "B7")
def sample_holdout(spark: SparkSession, d: str) -> DataFrame:
    return B.holdout(table(spark, d, "query_list").select("query_id"), "query_id", 100)


@REGISTRY("sample_few_groups", f"SELECT record_id FROM data_text_with_cluster_ids WHERE len(cluster_ids) >= 5 ORDER BY {_md5('record_id')}, record_id LIMIT 50", "B8")
def sample_few_groups(spark: SparkSession, d: str) -> DataFrame:
    return B.few_rows(table(spark, d, "data_text_with_cluster_ids").where(F.size("cluster_ids") >= 5).select("record_id"), "record_id", 50, 42)


@REGISTRY("sample_worker_slices", "SELECT file_id, ((row_number() OVER (ORDER BY file_id) - 1) // ceil(count(*) OVER () / 6)::BIGINT)::INTEGER AS worker FROM text_files", "B11")
def sample_worker_slices(spark: SparkSession, d: str) -> DataFrame:
    return B.slices(table(spark, d, "text_files").select("file_id"), "file_id", 6)


# batches of training examples

EXAMPLES = "ex AS (SELECT query_id // 8 AS batch, query_id, pos_target FROM query_list WHERE len(pos_target) > 0)"


def _examples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_list").where(F.size("pos_target") > 0).select(F.floor(F.col("query_id") / 8).cast("bigint").alias("batch"), "query_id", "pos_target")


@REGISTRY("collate_single", f"WITH {EXAMPLES} SELECT batch, query_id, {CHOICE.format(n=1)}[1] AS doc FROM ex", "L1")
def collate_single(spark: SparkSession, d: str) -> DataFrame:
    return L.single_positive(_examples(spark, d), "batch", "query_id", "pos_target")


OWNED = f"{EXAMPLES}, c AS (SELECT batch, query_id, unnest(pos_target[1:3]) AS doc, generate_subscripts(pos_target[1:3], 1) AS p FROM ex)"


@REGISTRY("collate_multi", f"WITH {OWNED}, col AS (SELECT batch, query_id AS owner, doc, (row_number() OVER (PARTITION BY batch ORDER BY query_id, p) - 1)::INTEGER AS \"column\" FROM c) SELECT ex.batch, ex.query_id, \"column\", doc, query_id = owner AS is_positive FROM ex JOIN col USING (batch)", "L2")
def collate_multi(spark: SparkSession, d: str) -> DataFrame:
    return L.multi_positive_mask(_examples(spark, d), "batch", "query_id", "pos_target", 3)


@REGISTRY(
    "collate_shared",
    f"WITH {OWNED}, col AS (SELECT batch, doc, (row_number() OVER (PARTITION BY batch ORDER BY q, pp) - 1)::INTEGER AS \"column\" FROM (SELECT batch, doc, arg_min(query_id, [query_id, p]) AS q, arg_min(p, [query_id, p]) AS pp FROM c WHERE doc IS NOT NULL GROUP BY batch, doc)), own AS (SELECT DISTINCT batch, query_id, doc FROM c) SELECT ex.batch, ex.query_id, \"column\", col.doc, own.doc IS NOT NULL AS is_positive FROM ex JOIN col USING (batch) LEFT JOIN own ON own.batch = ex.batch AND own.query_id = ex.query_id AND own.doc = col.doc",
    "L3",
)
def collate_shared(spark: SparkSession, d: str) -> DataFrame:
    e = _examples(spark, d).withColumn("pos_target", F.filter(F.slice("pos_target", 1, 3), lambda x: x.isNotNull()))
    return L.shared_positive_mask(e, "batch", "query_id", "pos_target", 3)


# losses: batches of 10 queries and the 10 documents of the same numbers, scores a quarter of MaxSim; all batches that the documents fill

NUMBERED = """docs AS (SELECT DISTINCT doc_id FROM doc_tok), every AS (SELECT vec_id // 4 AS q, vec_id % 4 AS tok, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id // 4 IN (SELECT doc_id FROM docs)),
pos AS (SELECT DISTINCT q, q AS d FROM every), neg AS (SELECT q, (q + 17) % (SELECT count(*) FROM docs) AS d FROM pos),
inner_p AS (SELECT a.q, b.d FROM pos a JOIN pos b ON a.q // 10 = b.q // 10)"""
BATCH = f"""{TOKENS}, {NUMBERED}, best_p AS (SELECT p.q, p.d, x.tok, max(list_inner_product(x.e, t.e)) AS m FROM (SELECT * FROM inner_p UNION SELECT * FROM neg) p JOIN every x USING (q) JOIN doc_tok t ON t.doc_id = p.d GROUP BY ALL),
alls AS (SELECT q, d, sum(m) / 4 AS s FROM best_p GROUP BY ALL), sc AS (SELECT * FROM alls SEMI JOIN inner_p USING (q, d)),
truth AS (SELECT p.q, p.d FROM inner_p p JOIN every x ON x.q = p.q AND x.tok = 0 JOIN doc_tok t ON t.doc_id = p.d AND t.tok = 0 WHERE x.label = t.label)"""


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Queries (q, tok, label, e) that have a document of their number; positive, explicit negative and all pairs (q, d) of the batches."""
    docs = fx.doc_tokens(spark, d).select(F.col("doc_id").alias("q")).distinct()
    every = fx.query_tokens(spark, d, every=True).withColumnRenamed("qid", "q").join(docs, "q", "left_semi")
    pos = every.select("q", F.col("q").alias("d")).distinct()
    neg = pos.select("q", ((F.col("q") + 17) % max(1, docs.count())).alias("d"))
    batch = F.floor(F.col("q") / 10).alias("batch")
    inner = pos.select("q", batch).join(pos.select("d", batch), "batch").select("q", "d")
    return every, pos, neg, inner


def _batch(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    every, pos, neg, inner = _pairs(spark, d)
    docs = fx.doc_tokens(spark, d)
    packed = pack(docs.withColumnRenamed("doc_id", "d"), "d", "tok", "e"), pack(every, "q", "tok", "e")
    alls = cut(pair_scores(inner.unionByName(neg).distinct(), *packed).withColumn("s", F.col("s") / 4))
    labels = every.where("tok = 0").select("q", "label").join(docs.where("tok = 0").select(F.col("doc_id").alias("d"), "label"), "label")
    return {"sc": alls.join(inner, ["q", "d"], "left_semi"), "alls": alls, "pos": pos, "neg": neg, "truth": labels.join(inner, ["q", "d"], "left_semi").select("q", "d")}


ROUTED = "CASE WHEN regexp_matches(coalesce(page_name, ''), '(?i)\\.(png|jpg|jpeg|webp)$') THEN 'image' ELSE 'text' END"


@REGISTRY("collate_routed", f"WITH i AS (SELECT page_id, page_id // 16 AS batch, {ROUTED} AS kind FROM image_page_metadata) SELECT page_id, batch, route FROM i JOIN (SELECT batch, arg_min(kind, page_id) AS route FROM i GROUP BY batch) USING (batch)", "L5")
def collate_routed(spark: SparkSession, d: str) -> DataFrame:
    """Batches of items that go the way of pictures or of texts, by their first item."""
    name = F.coalesce("page_name", F.lit(""))
    t = table(spark, d, "image_page_metadata").select("page_id", F.floor(F.col("page_id") / 16).alias("batch"), F.when(has_extension(name, ["png", "jpg", "jpeg", "webp"]), "image").otherwise("text").alias("kind"))
    return L.routed(t, "batch", "page_id", F.col("kind")).select("page_id", "batch", "route")


def _lse(value: str, source: str = "sc", name: str = "l") -> str:
    return f"(SELECT q, max({value}) + ln(sum(exp({value} - m))) AS {name} FROM {source} JOIN (SELECT q, max({value}) AS m FROM {source} GROUP BY q) USING (q) GROUP BY q)"


SOFTPLUS = "greatest({0}, 0) + ln(1 + exp(-abs({0})))"
NCE = f"SELECT avg(l - p) AS loss FROM {_lse('s / 0.02')} JOIN (SELECT q, s / 0.02 AS p FROM sc JOIN pos USING (q, d)) USING (q)"
NEG = f"SELECT avg({SOFTPLUS.format('((n - p) / 0.02)')}) AS loss FROM (SELECT q, s AS p FROM sc JOIN pos USING (q, d)) JOIN (SELECT q, s AS n FROM alls JOIN neg USING (q, d)) USING (q)"
HARD = "(SELECT q, p, CASE WHEN s1 = p THEN s2 ELSE s1 END AS h FROM (SELECT q, list_sort(list(s), 'DESC')[1] AS s1, list_sort(list(s), 'DESC')[2] AS s2 FROM sc GROUP BY q) JOIN (SELECT q, s AS p FROM sc JOIN pos USING (q, d)) USING (q))"
PAIR = f"SELECT avg({SOFTPLUS.format('(h - p)')}) AS loss FROM {HARD}"
MULTI = f"SELECT sum(coalesce(l - pl, 0)) / count(*) AS loss FROM {_lse('s / 0.02')} LEFT JOIN {_lse('s / 0.02', '(SELECT sc.* FROM sc SEMI JOIN truth USING (q, d))', 'pl')} USING (q)"
TOP = "(SELECT sc.q, sc.s, CASE WHEN t.q IS NULL THEN 0 ELSE 1 END AS y, row_number() OVER (PARTITION BY sc.q ORDER BY sc.s DESC, sc.d) - 1 AS r FROM sc LEFT JOIN truth t ON t.q = sc.q AND t.d = sc.d)"
NDCG = f"SELECT avg(CASE WHEN n > 0 THEN 1 - dcg / list_sum(list_transform(range(n), lambda i: 1 / log2(i + 2))) ELSE 0 END) AS loss FROM (SELECT q, sum(y / log2(r + 2)) AS dcg, sum(y)::BIGINT AS n FROM {TOP} WHERE r < 10 GROUP BY q)"
MLE = f"SELECT sum(part) / (SELECT count(DISTINCT q) FROM sc) AS loss FROM (SELECT -ln(exp(s) / sum(exp(s)) OVER (PARTITION BY q ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 1e-8) AS part FROM {TOP} WHERE y = 1 AND r < 10)"


def _rows(parts: dict[str, str]) -> str:
    return f"WITH {BATCH} " + " UNION ALL ".join(f"SELECT '{n}' AS name, round(loss, 6) AS loss FROM ({s})" for n, s in parts.items())


def _named(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, p in parts.items():
        p = p.select(F.lit(name).alias("name"), F.round("loss", 6).alias("loss"))
        out = p if out is None else out.unionByName(p)
    return out


def _mix(a: str, b: str, w: float) -> str:
    return f"SELECT (SELECT loss FROM ({a})) * {1 - w} + (SELECT loss FROM ({b})) * {w} AS loss"


@REGISTRY("loss_contrastive", _rows({"info_nce": NCE, "explicit_negative": NEG, "explicit_and_batch": _mix(NEG, NCE, 0.5), "pairwise": PAIR, "pairwise_explicit": _mix(NEG, PAIR, 0.5)}), "X1 X4 X5 X6 X7 T6")
def loss_contrastive(spark: SparkSession, d: str) -> DataFrame:
    """Late-interaction losses over all batches; T = 0.02, pairwise T = 1."""
    b = _batch(spark, d)
    nce, neg, pair = X.info_nce(b["sc"], b["pos"]), X.explicit_negatives(b["alls"], b["pos"], b["neg"]), X.pairwise(b["sc"], b["pos"])
    return _named({"info_nce": nce, "explicit_negative": neg, "explicit_and_batch": X.weighted(neg, nce, 0.5), "pairwise": pair, "pairwise_explicit": X.weighted(neg, pair, 0.5)})


@REGISTRY("loss_listwise", _rows({"multi_positive": MULTI, "listwise_ndcg": NDCG, "listwise_mle": MLE, "combined_205": f"SELECT (SELECT loss FROM ({MULTI})) + 0.1 * (SELECT loss FROM ({NDCG})) AS loss", "combined_206": MULTI}), "X8 X9 X10 X11 P25")
def loss_listwise(spark: SparkSession, d: str) -> DataFrame:
    b = _batch(spark, d)
    s, t = b["sc"], b["truth"]
    return _named({"multi_positive": X.multi_positive(s, t), "listwise_ndcg": X.listwise_ndcg(s, t), "listwise_mle": X.listwise_mle(s, t), "combined_205": X.combined(s, t, 205), "combined_206": X.combined(s, t, 206)})


@REGISTRY("loss_filtered", f"WITH {BATCH}, pp AS (SELECT q, d AS pd, s AS ps FROM sc JOIN pos USING (q, d)) SELECT q, d, round(CASE WHEN d <> pd AND s > 0.95 * ps THEN s * 0.5 ELSE s END, 6) AS s, round(s / 4, 6) AS by_length FROM sc JOIN pp USING (q)", "X2 X3")
def loss_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Damped high negatives; and scores by query length where all lie within the bounds."""
    b = _batch(spark, d)
    damped = X.damped_negatives(b["sc"], b["pos"])
    lengths = b["pos"].select("q", F.lit(4).alias("len"))
    normed = X.normalised_scores(b["sc"].select("q", "d", "s"), lengths).withColumnRenamed("s", "by_length")
    return damped.join(normed, ["q", "d"]).select("q", "d", F.round("s", 6).alias("s"), F.round("by_length", 6).alias("by_length"))


SINGLE = f"""{TOKENS}, {NUMBERED}, alls AS (SELECT p.q, p.d, list_inner_product(x.e, t.e) AS s FROM (SELECT * FROM inner_p UNION SELECT * FROM neg) p JOIN every x ON x.q = p.q AND x.tok = 0 JOIN doc_tok t ON t.doc_id = p.d AND t.tok = 0),
sc AS (SELECT * FROM alls SEMI JOIN inner_p USING (q, d))"""
BI_PAIR = f"SELECT avg({SOFTPLUS.format('((h - p) / 0.02)')}) AS loss FROM {HARD}"


@REGISTRY("loss_single_vector", f"WITH {SINGLE} " + " UNION ALL ".join(f"SELECT '{n}' AS name, round(loss, 6) AS loss FROM ({s})" for n, s in {"info_nce": NCE, "explicit_and_batch": _mix(NEG, NCE, 0.5), "pairwise": BI_PAIR, "pairwise_explicit": _mix(NEG, BI_PAIR, 0.5)}.items()), "X12 X13 X14 X15")
def loss_single_vector(spark: SparkSession, d: str) -> DataFrame:
    """The same losses on dot products of one vector each."""
    every, pos, negative, inner = _pairs(spark, d)
    one = [t.where("tok = 0").select(k, F.array("e").alias("vectors")) for t, k in ((fx.doc_tokens(spark, d).withColumnRenamed("doc_id", "d"), "d"), (every, "q"))]
    alls = cut(pair_scores(inner.unionByName(negative).distinct(), *one))
    s = alls.join(inner, ["q", "d"], "left_semi")
    neg = X.explicit_negatives(alls, pos, negative)
    nce, pair = X.info_nce(s, pos), X.pairwise(s, pos, 0.02)
    return _named({"info_nce": nce, "explicit_and_batch": X.weighted(neg, nce, 0.5), "pairwise": pair, "pairwise_explicit": X.weighted(neg, pair, 0.5)})


# clusters

CENTRES = "cen AS (SELECT label AS c, list(m ORDER BY p) AS v FROM (SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY label, p) GROUP BY label)"


def _label_centres(spark: SparkSession, d: str) -> np.ndarray:
    t = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    means = t.groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("p", "m"))).alias("v"))
    return np.array([r["m"] for r in means.select("label", F.col("v.m").alias("m")).orderBy("label").collect()])  # ten labels


@REGISTRY("cluster_assigned", f"WITH {CENTRES}, di AS (SELECT vec_id, c, list_sum(list_transform(list_zip(embedding::DOUBLE[], v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM embeddings, cen) SELECT vec_id, arg_min(c, d2)::INTEGER AS cluster_id, round(min(d2), 6) AS distance2 FROM di GROUP BY vec_id", "C1 C2 G3")
def cluster_assigned(spark: SparkSession, d: str) -> DataFrame:
    """Nearest of given centres, and the squared distances that add up to the error."""
    return C.assign(table(spark, d, "embeddings"), "vec_id", "embedding", _label_centres(spark, d)).withColumn("distance2", F.round("distance2", 6))


@REGISTRY("cluster_kmeans", None, "C1 C2 A12")
def cluster_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """k-means over all vectors; k from their number."""
    t = table(spark, d, "embeddings")
    centres, _ = C.kmeans(t, "vec_id", "embedding", G.cluster_count(t.count()))
    return C.assign(t, "vec_id", "embedding", centres)


@REGISTRY("cluster_elbow", None, "C2 K8")
def cluster_elbow(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(C.elbow(table(spark, d, "embeddings"), "vec_id", "embedding", [2, 4, 6, 8]), "k int, error double")


@REGISTRY("cluster_count", "SELECT n, least(floor(least(greatest(sqrt(n), 2), 100)), n)::INTEGER AS k FROM (SELECT unnest([1, 2, 3, 10, 100, 500, 20000]) AS n)", "C3")
def cluster_count(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, G.cluster_count(n)) for n in (1, 2, 3, 10, 100, 500, 20000)], "n int, k int")


@REGISTRY("cluster_medoid_pages", None, "C4 PS13")
def cluster_medoid_pages(spark: SparkSession, d: str) -> DataFrame:
    t = fx.doc_tokens(spark, d).select("doc_id", "tok", V.normalised(F.col("e")).alias("e"))
    return C.medoid_pages(t, "doc_id", "tok", "e")


@REGISTRY("cluster_first_medoid", f"WITH {TOKENS}, di AS (SELECT a.doc_id, a.tok, sum(CASE WHEN a.tok = b.tok THEN 0 ELSE 1 - list_inner_product(a.e, b.e) END) AS s FROM doc_tok a JOIN doc_tok b USING (doc_id) GROUP BY ALL) SELECT doc_id, arg_min(tok, s) AS tok FROM di GROUP BY doc_id", "C4 P22")
def cluster_first_medoid(spark: SparkSession, d: str) -> DataFrame:
    """Where k-medoids begins: the page with the least sum of distances in its document."""
    t = fx.doc_tokens(spark, d).select("doc_id", "tok", "e")
    other = t.select("doc_id", F.col("tok").alias("o"), F.col("e").alias("f"))
    sums = t.join(other, "doc_id").groupBy("doc_id", "tok").agg(F.sum(V.cosine_distance(F.col("e"), F.col("f"), F.col("tok") == F.col("o"))).alias("s"))
    return sums.groupBy("doc_id").agg(F.min_by("tok", "s").alias("tok"))


@REGISTRY("cluster_pooled_tokens", None, "C5 C6 D22")
def cluster_pooled_tokens(spark: SparkSession, d: str) -> DataFrame:
    return C.pooled(fx.doc_tokens(spark, d), "doc_id", "tok", "e", lambda t: C.pool_hierarchically(t, 3)[0])


@REGISTRY("cluster_pooled_by_function", None, "C7 E13")
def cluster_pooled_by_function(spark: SparkSession, d: str) -> DataFrame:
    return C.pooled(fx.doc_tokens(spark, d), "doc_id", "tok", "e", lambda t: t.mean(axis=0, keepdims=True))


@REGISTRY("cluster_pooled_pairs", f"WITH {TOKENS}, m AS (SELECT doc_id, tok // 2 AS tok, p, avg(x) AS x FROM (SELECT doc_id, tok, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM doc_tok) GROUP BY ALL), v AS (SELECT doc_id, tok, list(x ORDER BY p) AS v FROM m GROUP BY ALL) SELECT doc_id, tok, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(v[64] / sqrt(list_inner_product(v, v)), 6) AS last FROM v", "C8")
def cluster_pooled_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = C.pool_pairs(fx.doc_tokens(spark, d), "doc_id", "tok", "e")
    return p.select("doc_id", "tok", F.round(F.col("e")[0], 6).alias("first"), F.round(F.col("e")[63], 6).alias("last"))


# groups of texts

CLUSTERED = "tx AS (SELECT text_name AS t, list_sort(list_distinct(list_filter(flatten(list(cluster_ids) FILTER (cluster_ids IS NOT NULL)), lambda x: x IS NOT NULL))) AS c, min(record_id) AS o FROM data_text_with_cluster_ids GROUP BY 1), tc AS (SELECT t, o, unnest(c) AS c, len(c) AS n FROM tx)"


def _groups_sql(k: int) -> str:
    joins = " ".join(f"JOIN tc c{i} ON c{i}.t = c1.t AND c{i}.c > c{i - 1}.c" for i in range(2, k + 1))
    combo = "[" + ", ".join(f"c{i}.c" for i in range(1, k + 1)) + "]"
    return f"""cb{k} AS (SELECT {combo} AS combo, c1.o AS o FROM tc c1 {joins} UNION ALL SELECT c, o FROM tx WHERE len(c) BETWEEN 1 AND {k - 1}),
fo{k} AS (SELECT combo, min(o) AS o FROM cb{k} GROUP BY combo),
mb{k} AS (SELECT combo, any_value(o) AS o, list_sort(list(t)) AS text_names FROM (SELECT combo, f.o, tc.t FROM (SELECT combo, o, unnest(combo) AS c FROM fo{k}) f JOIN tc USING (c) GROUP BY combo, f.o, tc.t HAVING count(*) = len(combo)) GROUP BY combo HAVING count(*) BETWEEN 3 AND 5),
gr{k} AS (SELECT {k} AS k, combo AS cluster_ids, text_names FROM mb{k} QUALIFY row_number() OVER (PARTITION BY text_names ORDER BY o, combo) = 1)"""


@REGISTRY("group_similar_texts", f"WITH {CLUSTERED}, {_groups_sql(2)}, {_groups_sql(3)} SELECT * FROM gr2 UNION ALL SELECT * FROM gr3", "G1 J10 U7")
def group_similar_texts(spark: SparkSession, d: str) -> DataFrame:
    return G.similar_groups(table(spark, d, "data_text_with_cluster_ids"), [2, 3])


ALL_SIZES = f"""
WITH RECURSIVE {CLUSTERED}, cb(t, o, n, combo, last, k) AS (
  SELECT t, o, n, [c], c, 1 FROM tc UNION ALL SELECT r.t, r.o, r.n, list_append(r.combo, tc.c), tc.c, r.k + 1 FROM cb r JOIN tc ON tc.t = r.t AND tc.c > r.last WHERE r.k < 10),
sup AS (SELECT combo, k, list_sort(list(t)) AS text_names, min(o) AS o, min(o) FILTER (n = k) AS whole FROM cb GROUP BY combo, k HAVING count(*) BETWEEN 3 AND 5),
ks AS (SELECT unnest(range(2, 11)) AS size),
met AS (SELECT size, combo, o AS first, text_names FROM sup JOIN ks ON k = size UNION ALL SELECT size, combo, whole, text_names FROM sup JOIN ks ON k < size WHERE whole IS NOT NULL)
SELECT DISTINCT combo AS cluster_ids, text_names FROM (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY size, text_names ORDER BY first, combo) = 1)
"""


@REGISTRY("group_all_sizes", ALL_SIZES, "G2 U1")
def group_all_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Groups for all k from 2 to 10."""
    return G.all_groups(table(spark, d, "data_text_with_cluster_ids"), list(range(2, 11)))


@REGISTRY("group_co_members", "WITH w AS (SELECT cluster_ids AS combo FROM data_text_with_cluster_ids WHERE len(cluster_ids) BETWEEN 2 AND 3 AND len(list_filter(cluster_ids, lambda x: x IS NULL)) = 0 GROUP BY 1), h AS (SELECT DISTINCT text_name AS text, unnest(cluster_ids) AS c FROM data_text_with_cluster_ids) SELECT combo, text FROM (SELECT combo, unnest(list_distinct(combo)) AS c FROM w) JOIN h USING (c) GROUP BY combo, text HAVING count(*) = len(list_distinct(combo))", "J10")
def group_co_members(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "data_text_with_cluster_ids")
    wanted = t.where(F.size("cluster_ids").between(2, 3) & ~F.exists("cluster_ids", lambda x: x.isNull())).select(F.col("cluster_ids").alias("combo")).distinct()
    return G.co_members(t, wanted)
