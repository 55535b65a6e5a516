"""Sources, sinks, external functions and incremental work over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import scalars as S
from pagewright.operators import grouping as G
from pagewright.operators import relational as R
from pagewright.plans import fixtures as fx
from pagewright.plans.fixtures import TOKENS
from pagewright.plans.registry import Registry
from pagewright.plans.retrieval_queries import FLAGSHIP, flagship_retrieval_metrics
from pagewright.plans.scalar_queries import STEM, STRIP
from pagewright.session import scratch, table
from pagewright.sources import external as E
from pagewright.sources import records as I
from pagewright.streaming.incremental import stream_counts, stream_counts_to

REGISTRY = Registry()
ITEMS = "SELECT doc_id AS i, CASE WHEN doc_id % 4 = 0 THEN '0' WHEN doc_id % 4 = 1 THEN NULL ELSE doc_id::VARCHAR END AS id, CASE WHEN doc_id % 8 = 1 THEN '' ELSE text_name END AS name, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS text, source AS content FROM documents"


@REGISTRY("scan_text_items", f"SELECT i, coalesce(CASE WHEN id NOT IN ('', '0') THEN id END, nullif(name, ''), 'text_' || i) AS text_name, coalesce(nullif(text, ''), nullif(content, ''), '') AS text FROM ({ITEMS})", "S4")
def scan_text_items(spark: SparkSession, d: str) -> DataFrame:
    """Text lists whose items may lack an id, a name or a text."""
    k = F.col("doc_id")
    cols = {
        "i": k, "id": F.when(k % 4 == 0, "0").when(k % 4 == 1, None).otherwise(k.cast("string")), "name": F.when(k % 8 == 1, "").otherwise(F.col("text_name")),
        "text": F.when(k % 5 == 0, "").otherwise(F.col("lang")), "content": F.col("source"),
    }
    return I.text_items(table(spark, d, "documents").select(*[c.alias(n) for n, c in cols.items()]), "i")


FIRST_TEXT = "SELECT text_name, arg_min(text, doc_id) FILTER (text IS NOT NULL) AS text FROM documents WHERE text_name IS NOT NULL AND text IS NOT NULL GROUP BY text_name"
ASKED = "SELECT query_id, ord, v FROM (SELECT query_id, unnest(pos_target[1:5]) AS v, generate_subscripts(pos_target[1:5], 1) - 1 AS ord FROM query_list)"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return R.first_wins(table(spark, d, "documents").where("text_name IS NOT NULL AND text IS NOT NULL"), ["text_name"], ["text"], "doc_id")


@REGISTRY("scan_partial_texts", f"SELECT query_id, ord::INTEGER AS place, v AS text_name, length(text) AS n_chars FROM ({ASKED}) JOIN ({FIRST_TEXT}) t ON t.text_name = v WHERE length({STRIP.format('text')}) > 0", "S5")
def scan_partial_texts(spark: SparkSession, d: str) -> DataFrame:
    got = I.partial_texts(table(spark, d, "query_list"), "query_id", "pos_target", _texts(spark, d))
    return got.select("query_id", "place", "text_name", F.length("text").cast("bigint").alias("n_chars"))


@REGISTRY("scan_whole_text", f"SELECT record_id, CASE WHEN length(t) > 300 THEN substr(t, 1, 299) || '…' ELSE t END AS text FROM (SELECT record_id, coalesce(text, '') AS t FROM data_text_keywords k LEFT JOIN ({FIRST_TEXT}) f USING (text_name))", "S6")
def scan_whole_text(spark: SparkSession, d: str) -> DataFrame:
    return I.whole_text(table(spark, d, "data_text_keywords").select("record_id", "text_name"), "text_name", _texts(spark, d), 300).select("record_id", "text")


@REGISTRY("scan_pictures", f"SELECT page_id, {STEM.format('page_name')} AS stem FROM image_page_metadata WHERE regexp_matches(page_name, '(?i)\\.(png|jpg|jpeg|webp)$')", "S7")
def scan_pictures(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_name")
    return table(spark, d, "image_page_metadata").where(S.has_extension(n, ["png", "jpg", "jpeg", "webp"])).select("page_id", S.file_stem(n).alias("stem"))


@REGISTRY("scan_joined_pages", "SELECT document_name, array_to_string(list(coalesce(category, '') ORDER BY page_id), '') AS text FROM image_page_metadata WHERE document_name IS NOT NULL GROUP BY 1", "S9 S10")
def scan_joined_pages(spark: SparkSession, d: str) -> DataFrame:
    """Page texts (here: categories) of a document put together in order."""
    return I.joined_pages(table(spark, d, "image_page_metadata").where("document_name IS NOT NULL"), "document_name", "page_id", "category")


PLAIN = "category IS NOT NULL AND regexp_matches(category, '^[a-z]+$')"


def _by_category(spark: SparkSession, d: str, name: str) -> str:
    """A folder with root/<category>/``name`` for each plain category; the categories are a fixed handful."""
    root, t = scratch(spark), table(spark, d, "query_list").where(F.col("category").rlike("^[a-z]+$"))
    for (c,) in t.select("category").distinct().collect():
        I.write_named(t.where(F.col("category") == c).select("query_id", "query", "pos_target"), f"{root}/{c}", name)
    return root


@REGISTRY("scan_by_category", f"SELECT category, query_id, list_transform(list_filter(pos_target, lambda x: x IS NOT NULL AND x <> ''), lambda x: category || '/' || x) AS pos_target FROM query_list WHERE {PLAIN} AND len(list_filter(pos_target, lambda x: x IS NOT NULL AND x <> '')) > 0", "S13 F9 P11")
def scan_by_category(spark: SparkSession, d: str) -> DataFrame:
    """A file of each category's folder, written and read again, with prefixed targets; rows without any target left out."""
    rows = I.read_by_category(spark, _by_category(spark, d, "train.json"), "train.json", "query_id long, query string, pos_target array<string>")
    t = rows.select("category", "query_id", S.prefixed(F.col("pos_target"), F.col("category")).alias("pos_target"))
    return t.where(F.size("pos_target") > 0)


@REGISTRY("scan_categories", f"SELECT DISTINCT category FROM query_list WHERE {PLAIN}", "S14")
def scan_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories by the folders that have the file."""
    return I.categories(spark, _by_category(spark, d, "train.json"), "train.json")


@REGISTRY("scan_result_category", f"SELECT category, query_id, query FROM query_list WHERE {PLAIN}", "S16 K1")
def scan_result_category(spark: SparkSession, d: str) -> DataFrame:
    """Result files whose names hold their category, written beside others that are not to be read."""
    folder, t = scratch(spark), table(spark, d, "query_list").where(F.col("category").rlike("^[a-z]+$")).select("category", "query_id", "query")
    for (c,) in t.select("category").distinct().collect():
        own = t.where(F.col("category") == c).drop("category")
        I.write_named(own, folder, f"query_list_text_{c}_with_pos_target_retrieved.json")
        I.write_named(own.limit(1), folder, f"query_list_text_{c}.json")
    return I.read_retrieved(spark, folder, "query_id long, query string").select("category", "query_id", "query")


@REGISTRY("scan_record_files", "SELECT query_id, query, pos_target FROM query_list", "S1 S2 K1")
def scan_record_files(spark: SparkSession, d: str) -> DataFrame:
    """A table as JSON files of one array each, and one that holds a single object, read again."""
    folder, t = scratch(spark), table(spark, d, "query_list").select("query_id", "query", "pos_target")
    array = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*t.columns))), ","), F.lit("]")).alias("value")
    number = F.pmod(F.xxhash64("query_id"), F.lit(max(1, t.count() // 1000))).alias("file")
    first = t.agg(F.min("query_id")).first()[0]
    t.where(F.col("query_id") != first).groupBy(number).agg(array).write.partitionBy("file").text(f"{folder}/arrays")
    t.where(F.col("query_id") == first).coalesce(1).write.json(f"{folder}/object/file=0")
    return I.read_records(spark, f"{folder}/*/*", "query_id long, query string, pos_target array<string>")


@REGISTRY("scan_train_columns", "SELECT query_id, query, pos_target FROM query_list WHERE query_id % 4 <> 3 AND category = 'biology'", "S11 P30")
def scan_train_columns(spark: SparkSession, d: str) -> DataFrame:
    """Parts named train-*, beside one that is not, with filter and columns pushed down."""
    folder, t = scratch(spark), table(spark, d, "query_list")
    for i in range(4):
        t.where(F.col("query_id") % 4 == i).write.parquet(f"{folder}/{'train' if i < 3 else 'eval'}-{i}.parquet")
    return I.read_train_parts(spark, folder).where("category = 'biology'").select("query_id", "query", "pos_target")


@REGISTRY("sink_page_records", "WITH p AS (SELECT vec_id // 10 AS doc, vec_id % 10 AS i FROM embeddings) SELECT doc || '_' || i || '.png' AS page_name, doc || '.png' AS document_name FROM p UNION ALL SELECT DISTINCT doc || '.png', doc || '.png' FROM p", "K5")
def sink_page_records(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.doc_tokens(spark, d).select(F.col("doc_id").cast("string").alias("doc"), F.col("tok").alias("i"))
    return I.page_records(pages, "doc", "i")


@REGISTRY("sink_missing_outputs", "SELECT DISTINCT document_name FROM image_page_metadata WHERE document_name IS NOT NULL AND document_name NOT IN (SELECT page_name FROM image_page_metadata WHERE page_name IS NOT NULL)", "K6 J5")
def sink_missing_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose own picture is still to be made."""
    t = table(spark, d, "image_page_metadata")
    return I.missing_only(t.where("document_name IS NOT NULL").select("document_name").distinct(), t.select(F.col("page_name").alias("document_name")), "document_name")


NAMED = " UNION ALL ".join(f"SELECT '{n}@' || k AS name, {c} AS v FROM f" for n, c in (("P", "precision"), ("R", "recall"), ("MRR", "mrr"), ("NDCG", "ndcg")))


@REGISTRY("sink_metrics_map", f"WITH f AS ({FLAGSHIP}) {NAMED}", "K1 K2 P28")
def sink_metrics_map(spark: SparkSession, d: str) -> DataFrame:
    """The flagship's metrics as named values, written to the result file of a run and read again."""
    folder, m = scratch(spark), flagship_retrieval_metrics(spark, d)
    named = F.array(*[F.struct(F.concat(F.lit(f"{n}@"), "k").alias("name"), F.col(c).alias("v")) for n, c in (("P", "precision"), ("R", "recall"), ("MRR", "mrr"), ("NDCG", "ndcg"))])
    name = I.metrics_name("metrics", "maxsim", "1")
    I.write_named(m.select(F.explode(named).alias("x")).select("x.name", "x.v"), folder, name)
    return I.read_records(spark, f"{folder}/{name}", "name string, v double")


@REGISTRY("sink_collection", "SELECT vec_id // 10 AS doc_id, count(*) AS tokens, round(sum(embedding[1]::DOUBLE), 6) AS first FROM embeddings GROUP BY 1", "K9 K4 K3")
def sink_collection(spark: SparkSession, d: str) -> DataFrame:
    """A vector collection's life: made, filled, dropped, made again and read by document."""
    path, t = f"{scratch(spark)}/collection", fx.doc_tokens(spark, d)
    I.write_vectors(t.where("tok = 0").select("doc_id", "tok", "e"), path)
    I.drop_vectors(spark, path)
    for parity in (0, 1):  # two inserts
        I.write_vectors(t.where(F.col("doc_id") % 2 == parity).select("doc_id", "tok", "e"), path, "append")
    return spark.read.parquet(path).groupBy("doc_id").agg(F.count("*").alias("tokens"), F.round(F.sum(F.col("e")[0]), 6).alias("first"))


# external functions


@REGISTRY("ext_unit_tokens", f"WITH {TOKENS} SELECT doc_id, tok, round(CASE WHEN tok < 8 THEN e[1] / sqrt(list_inner_product(e, e)) ELSE 0 END, 6) AS first FROM doc_tok", "E9 P20")
def ext_unit_tokens(spark: SparkSession, d: str) -> DataFrame:
    """What follows a model: token vectors at unit length, masked ones zero."""
    t = fx.doc_tokens(spark, d).withColumn("mask", (F.col("tok") < 8).cast("double"))
    return E.masked_unit_vectors(t, "e", "mask").select("doc_id", "tok", F.round(F.col("e")[0], 6).alias("first"))


@REGISTRY("ext_pooled_vectors", f"WITH {TOKENS}, m AS (SELECT doc_id, list(x ORDER BY p) AS v FROM (SELECT doc_id, p, avg(x) AS x FROM (SELECT doc_id, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM doc_tok) GROUP BY doc_id, p) GROUP BY doc_id), a AS (SELECT 'mean' AS how, doc_id, v FROM m UNION ALL SELECT 'cls', doc_id, e FROM doc_tok WHERE tok = 0 UNION ALL SELECT 'last', doc_id, e FROM doc_tok WHERE tok = 9) SELECT how, doc_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first FROM a", "E10")
def ext_pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for how in ("mean", "cls", "last"):
        p = E.pooled_vector(fx.doc_tokens(spark, d), "doc_id", "tok", "e", how).select(F.lit(how).alias("how"), "doc_id", F.round(F.col("e")[0], 6).alias("first"))
        out = p if out is None else out.unionByName(p)
    return out


@REGISTRY("ext_encoded_queries", None, "E1 E2 E3 E4 E11")
def ext_encoded_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries through the registered encoder; the default is a hash of each word."""
    return E.encoded(table(spark, d, "query_list"), "query_id", "query").select("query_id", F.size("vectors").alias("n_vectors"))


@REGISTRY("ext_generated_keywords", None, "E5 P4 P17 F10")
def ext_generated_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Sampled texts through the keyword generator, answers parsed, rows without keywords left out."""
    t = table(spark, d, "documents").where(F.length(S.strip(F.col("text"))) > 0).select("doc_id", S.head_middle_tail(F.col("text")).alias("sample"))
    a = E.generated(t, "doc_id", "sample", "keywords").select("doc_id", S.answer_json(F.col("answer"), "keywords array<string>, category string").alias("a"))
    return a.select("doc_id", "a.keywords", "a.category").where(F.size("keywords") > 0)


@REGISTRY("ext_generated_queries", None, "E6 E8 P18 P19")
def ext_generated_queries(spark: SparkSession, d: str) -> DataFrame:
    """Groups of texts to prompts, prompts to queries and themes."""
    groups = G.similar_groups(table(spark, d, "data_text_with_cluster_ids"), [3]).withColumn("id", F.xxhash64(F.array_join("text_names", "|")))
    prompts = groups.select("id", "text_names", "cluster_ids", S.numbered_lines(F.col("text_names"), 20).alias("prompt"))
    answers = E.generated(prompts, "id", "prompt", "query").select("id", S.answer_json(F.col("answer"), "query string")["query"].alias("query")).where(F.length(S.strip(F.col("query"))) > 0)
    themes = E.generated(prompts, "id", "prompt", "theme").select("id", S.short_theme(F.col("answer")).alias("group_theme"))
    return prompts.join(answers, "id").join(themes, "id").select("query", F.col("text_names").alias("pos_target"), "cluster_ids", "group_theme")


@REGISTRY("ext_judged_queries", None, "E7 P3 P9 F12 J14")
def ext_judged_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries of a text that a judge keeps."""
    texts = _texts(spark, d)
    asked = table(spark, d, "data_text_with_cluster_ids").where(F.size("querys") > 0).select("record_id", "text_name", "querys")
    return E.judged(I.whole_text(asked, "text_name", texts, 150_000), "record_id", "text", "querys", E.shares_word)


# incremental


@REGISTRY("stream_daily_counts", "SELECT date_trunc('day', ingested_at) AS begin, category, count(*) AS n FROM image_page_metadata WHERE ingested_at IS NOT NULL GROUP BY 1, 2", "K9")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """The table as a stream of files, counted by day with a watermark and read from where the stream has put its counts."""
    out, source = scratch(spark), table(spark, d, "image_page_metadata")
    folder, file_name = source.inputFiles()[0].rsplit("/", 1)
    own = folder.endswith(".parquet")  # the table may be a file among others or a folder of its own
    rows = spark.readStream.schema(source.schema).option("pathGlobFilter", "*" if own else file_name).parquet(folder)
    zoned = rows.where("ingested_at IS NOT NULL").withColumn("ingested_at", F.concat(F.col("ingested_at").cast("string"), F.lit("Z")).cast("timestamp"))  # watermarks need times with a zone
    stream_counts_to(stream_counts(zoned, "ingested_at", "category"), f"{out}/counts", f"{out}/state")
    begin = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_seconds(begin))")
    return spark.read.parquet(f"{out}/counts").withColumn("begin", begin)
