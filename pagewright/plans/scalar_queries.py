"""Scalar functions over the tables' names, texts, arrays and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import scalars as S
from pagewright.functions import vectors as V
from pagewright.plans.registry import Registry
from pagewright.session import table

REGISTRY = Registry()

BASE = "regexp_extract({0}, '([^/]*)$', 1)"
STEM = "regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '\\.[^.]*$', '')"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
EMPTY = "[]::VARCHAR[]"


@REGISTRY("fn_name_parts", f"SELECT page_id, {STEM.format('page_name')} AS stem, {STEM.format(STRIP.format('coalesce(page_name, chr(32))'))} AS stripped_stem, split_part({BASE.format('page_name')}, '.', 1) AS first_dot_stem, coalesce(try_cast(nullif(regexp_extract({STEM.format('page_name')}, '_([0-9]+)$', 1), '') AS INTEGER), 0) AS page_number FROM image_page_metadata", "P1 P2 P5")
def fn_name_parts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_name")
    return table(spark, d, "image_page_metadata").select("page_id", S.file_stem(n).alias("stem"), S.stripped_stem(n).alias("stripped_stem"), S.first_dot_stem(n).alias("first_dot_stem"), S.page_number(S.file_stem(n)).alias("page_number"))


@REGISTRY("fn_truncated_text", "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 499) || '…' ELSE text END AS short FROM documents", "P3")
def fn_truncated_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.truncated(F.col("text"), 500).alias("short"))


@REGISTRY(
    "fn_sampled_text",
    """SELECT doc_id, CASE WHEN length(text) <= 8000 THEN text ELSE substr(text, 1, 2000) ||
  CASE WHEN length(text) - 4000 <= 4000 THEN substr(text, 2001, length(text) - 4000) ELSE array_to_string(list_transform(range(8), lambda i: substr(text, 2001 + (i * (length(text) - 4500)) // 7, 500)), '') END
  || substr(text, length(text) - 1999, 2000) END AS sample FROM documents""",
    "P4",
)
def fn_sampled_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.head_middle_tail(F.col("text")).alias("sample"))


@REGISTRY("fn_listed_query", f"SELECT query_id, CASE WHEN query IS NULL OR query = '' THEN {EMPTY} ELSE [query] END AS targets, CASE WHEN query IS NULL THEN {EMPTY} ELSE [query] END AS kept FROM query_list", "P6")
def fn_listed_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_list").select("query_id", S.listed(F.col("query")).alias("targets"), S.listed(F.col("query"), False).alias("kept"))


ORDERED = "list_filter({0}, lambda x, i: x IS NOT NULL AND list_position({0}, x) = i)"


@REGISTRY(
    "fn_target_lists",
    f"""SELECT query_id, coalesce(list_bool_or(list_transform(pos_target, lambda x: coalesce(length({STRIP.format('x')}) > 0, false))), false) AS has_text,
  {ORDERED.format('list_filter(coalesce(pos_target, []), lambda v: v IS NOT NULL)')} AS distinct_targets, list_filter(coalesce(pos_target, {EMPTY}), lambda x: list_contains(coalesce(pos_target_for_deepseek, {EMPTY}), x)) AS kept,
  coalesce(len(pos_target), 0)::INTEGER AS n, pos_target[1:2] AS first_two FROM query_list""",
    "P7 P8 P9 P10 P31",
)
def fn_target_lists(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("pos_target")
    present = F.filter(F.coalesce(t, F.array().cast("array<string>")), lambda x: x.isNotNull())
    kept = S.kept_members(t, F.col("pos_target_for_deepseek"))
    return table(spark, d, "query_list").select("query_id", S.has_text(t).alias("has_text"), S.distinct_in_order(present).alias("distinct_targets"), kept.alias("kept"), S.size_or_zero(t).alias("n"), F.slice(t, 1, 2).alias("first_two"))


@REGISTRY("fn_category_prefix", "SELECT query_id, v, v[1:strpos(v, '/') - 1] AS category, v[strpos(v, '/') + 1:] AS file FROM (SELECT query_id, unnest(list_transform(list_filter(pos_target, lambda x: x IS NOT NULL AND x <> ''), lambda x: coalesce(category, 'none') || '/' || x)) AS v FROM query_list)", "P11 P12")
def fn_category_prefix(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "query_list").select("query_id", F.explode(S.prefixed(F.col("pos_target"), F.coalesce("category", F.lit("none")))).alias("v"))
    return v.select("query_id", "v", S.category_and_file(F.col("v"))[0].alias("category"), S.category_and_file(F.col("v"))[1].alias("file"))


@REGISTRY("fn_page_target", f"SELECT query_id, {STEM.format('pos_target[1]')} || '_' || (('0x' || substr(md5(query_id::VARCHAR), 1, 8))::BIGINT % 4)::VARCHAR || regexp_extract({BASE.format('pos_target[1]')}, '(\\.[^.]*)$', 1) AS target FROM query_list WHERE len(pos_target) > 0", "P13 B9")
def fn_page_target(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_list").where(F.size("pos_target") > 0).select("query_id", S.page_target(F.col("pos_target")[0], F.col("query_id").cast("string")).alias("target"))


SIZES = "SELECT p_partkey, (590 + p_partkey % 30)::DOUBLE AS w, (785 + p_partkey % 65)::DOUBLE AS h FROM part"
FORMATS = "CASE " + " ".join(f"WHEN abs(s - {a}) <= 2 AND abs(l - {b}) <= 2 THEN '{n}'" for n, a, b in S.PAGE_FORMATS) + " ELSE 'Other (' || s || 'x' || l || ')' END"
FORMATTED = f"SELECT p_partkey, s AS short_side, l AS long_side, {FORMATS} AS format FROM (SELECT p_partkey, least(round(w), round(h))::INTEGER AS s, greatest(round(w), round(h))::INTEGER AS l FROM ({SIZES}))"


def page_sizes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", (590 + k % 30).cast("double").alias("w"), (785 + k % 65).cast("double").alias("h"))


@REGISTRY("fn_page_format", FORMATTED, "P14 P15")
def fn_page_format(spark: SparkSession, d: str) -> DataFrame:
    s, n = S.short_and_long(F.col("w"), F.col("h"))
    return page_sizes(spark, d).select("p_partkey", s.alias("short_side"), n.alias("long_side")).withColumn("format", S.page_format(F.col("short_side"), F.col("long_side")))


@REGISTRY("fn_page_count_group", "SELECT doc, n, CASE WHEN n <= 10 THEN '<=10' WHEN n <= 20 THEN '11-20' ELSE '>20' END AS page_group FROM (SELECT document_name AS doc, count(*) AS n FROM image_page_metadata WHERE page_name <> document_name GROUP BY 1)", "P16 S8")
def fn_page_count_group(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "image_page_metadata").where("page_name <> document_name").groupBy(F.col("document_name").alias("doc")).agg(F.count("*").alias("n"))
    return n.withColumn("page_group", S.page_count_group(F.col("n")))


ANSWERS = """VALUES (1, '<answer>{"query":"q1","n":3}</answer>'), (2, 'noise {"query":"q2"} tail'), (3, '{"query":'), (4, ''), (5, NULL)"""


@REGISTRY("fn_answer_json", f"SELECT id, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.query') END AS query FROM (SELECT id, nullif(regexp_extract(regexp_replace(a, '</?answer>', '', 'g'), '\\{{(.|\\n)*\\}}', 0), '') AS j FROM ({ANSWERS}) t(id, a))", "P17")
def fn_answer_json(spark: SparkSession, d: str) -> DataFrame:
    t = spark.sql(f"SELECT * FROM ({ANSWERS}) t(id, a)")
    return t.select("id", S.answer_json(F.col("a"), "query string, n int")["query"].alias("query"))


@REGISTRY(
    "fn_prompt_text",
    f"""SELECT cluster_id, substr({STRIP.format("array_to_string(keywords, ' ')")}, 1, 200) AS theme, array_to_string(list_transform(keywords[1:15], lambda x, i: i::VARCHAR || '. ' || x), chr(10)) AS lines,
  'Query: ' || keywords[1] || repeat('<pad>', 10) || chr(10) AS wrapped FROM keywords_clusters""",
    "P18 P19 P32",
)
def fn_prompt_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("keywords")
    return table(spark, d, "keywords_clusters").select("cluster_id", S.short_theme(F.array_join(k, " ")).alias("theme"), S.numbered_lines(k, 15).alias("lines"), S.wrapped_query(F.get(k, F.lit(0)), "<pad>", end="\n").alias("wrapped"))


E = "embedding::DOUBLE[]"
PAIR = f"SELECT a.vec_id, a.{E} AS x, b.{E} AS y FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 7) % (SELECT count(*) FROM embeddings)"


@REGISTRY(
    "fn_vector_math",
    f"""SELECT vec_id, round(list_inner_product(x, y), 9) AS dot, round(CASE WHEN vec_id = (vec_id + 7) % (SELECT count(*) FROM embeddings) THEN 0 ELSE 1 - list_inner_product(x, y) END, 9) AS cosine_distance,
  round(list_sum(list_transform(x, lambda v: v / sqrt(list_inner_product(x, x)))), 9) AS unit_sum, round(greatest(x[1] * 50, 0) + ln(1 + exp(-abs(x[1] * 50))), 9) AS softplus,
  round(list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))), 9) AS lse, round(0.1 * (list_max(x) / 0.1 + ln(list_sum(list_transform(x, lambda v: exp((v - list_max(x)) / 0.1))))), 9) AS smooth_max,
  round(exp(x[1]) / list_sum(list_transform(x, lambda v: exp(v))), 9) AS softmax_first, round(1 / log2(vec_id + 2), 9) AS discount FROM ({PAIR})""",
    "P20 P21 P22 P24 P25",
)
def fn_vector_math(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("v"))
    a = e.select("vec_id", F.col("v").alias("x"), ((F.col("vec_id") + 7) % max(1, e.count())).alias("other"))
    t = a.join(e.select(F.col("vec_id").alias("other"), F.col("v").alias("y")), "other")
    x, y = F.col("x"), F.col("y")
    cols = {
        "dot": V.dot(x, y), "cosine_distance": V.cosine_distance(x, y, F.col("vec_id") == F.col("other")), "unit_sum": F.aggregate(V.normalised(x), F.lit(0.0), lambda s, v: s + v), "softplus": V.softplus(x[0] * 50),
        "lse": V.log_sum_exp(x), "smooth_max": V.smooth_max(x, 0.1), "softmax_first": V.softmax(x)[0], "discount": V.rank_discount(F.col("vec_id")),
    }
    return t.select("vec_id", *[F.round(c, 9).alias(n) for n, c in cols.items()])


@REGISTRY("fn_min_max_scaled", f"WITH s AS (SELECT vec_id // 100 AS g, vec_id, embedding[1]::DOUBLE AS v FROM embeddings) SELECT vec_id, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-10), 9) AS scaled FROM s WINDOW w AS (PARTITION BY g)", "P23")
def fn_min_max_scaled(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("g"), "vec_id", F.col("embedding")[0].cast("double").alias("v"))
    ends = s.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return s.join(ends, "g").select("vec_id", F.round((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-10), 9).alias("scaled"))


PADDED = "SELECT d AS doc, t AS tok, CASE WHEN t < 2 OR t >= 10 OR t = 5 THEN list_transform(range(64), lambda i: 0.0::DOUBLE) ELSE (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = d * 12 + t) END AS e FROM (SELECT unnest(range((SELECT count(*) FROM embeddings) // 12)) AS d), (SELECT unnest(range(12)) AS t)"


@REGISTRY("fn_unpadded_tokens", f"WITH p AS ({PADDED}), z AS (SELECT *, list_bool_or(list_transform(e, lambda x: x <> 0)) AS live FROM p), m AS (SELECT doc, min(tok) FILTER (live) AS a, max(tok) FILTER (live) AS b, count(*) FILTER (e[1] <> 0) AS n FROM z GROUP BY doc) SELECT doc, tok, n AS query_length, tok >= a AS left_kept, tok <= b AS right_kept FROM z JOIN m USING (doc)", "P26 P27")
def fn_unpadded_tokens(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("v"))
    grid = spark.range(e.count() // 12 * 12).select(F.floor(F.col("id") / 12).alias("doc"), (F.col("id") % 12).alias("tok"), F.col("id").alias("vec_id"))
    blank = (F.col("tok") < 2) | (F.col("tok") >= 10) | (F.col("tok") == 5)
    p = grid.join(e, "vec_id", "left").withColumn("e", F.when(blank, F.array_repeat(F.lit(0.0), 64)).otherwise(F.col("v")))
    z = p.withColumn("live", F.exists("e", lambda x: x != 0))
    m = z.groupBy("doc").agg(F.min(F.when(F.col("live"), F.col("tok"))).alias("a"), F.max(F.when(F.col("live"), F.col("tok"))).alias("b"), F.count_if(F.col("e")[0] != 0).alias("query_length"))
    return z.join(m, "doc").select("doc", "tok", "query_length", (F.col("tok") >= F.col("a")).alias("left_kept"), (F.col("tok") <= F.col("b")).alias("right_kept"))


@REGISTRY("fn_prefixed_columns", "SELECT doc_id AS query_doc_id, lang AS query_lang, coalesce(source, text_name, 'none') AS query_origin FROM documents", "P28 P30")
def fn_prefixed_columns(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "lang", F.coalesce("source", "text_name", F.lit("none")).alias("origin"))
    return t.select([F.col(c).alias(f"query_{c}") for c in t.columns])


@REGISTRY("fn_log_number", "SELECT p_partkey, CASE WHEN v <> 0 AND (abs(v) < 1e-3 OR abs(v) >= 1e4) THEN printf('%.6e', v) ELSE printf('%.6f', v) END AS shown FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey / 3e7 WHEN 1 THEN p_partkey::DOUBLE ELSE p_partkey * 1024.0 END AS v FROM part)", "P29")
def fn_log_number(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    v = F.when(k % 3 == 0, k / F.lit(3e7)).when(k % 3 == 1, k.cast("double")).otherwise(k * F.lit(1024.0))
    return table(spark, d, "part").select("p_partkey", S.log_number(v).alias("shown"))


@REGISTRY(
    "fn_picture_geometry",
    f"""SELECT p_partkey, w::INTEGER // 14 AS patches_x, h::INTEGER // 14 AS patches_y, w::INTEGER // 14 // 2 AS merged_x, h::INTEGER // 14 // 2 AS merged_y,
  CASE WHEN w * 792 > h * 612 THEN w::INTEGER ELSE round(h * 612 / 792)::INTEGER END AS padded_w, CASE WHEN w * 792 > h * 612 THEN round(w * 792 / 612)::INTEGER ELSE h::INTEGER END AS padded_h,
  split_part(lower(w::INTEGER || 'X' || h::INTEGER), 'x', 1)::INTEGER AS parsed_w, split_part(lower(w::INTEGER || 'X' || h::INTEGER), 'x', 2)::INTEGER AS parsed_h FROM ({SIZES})""",
    "P33 P34 P35",
)
def fn_picture_geometry(spark: SparkSession, d: str) -> DataFrame:
    t = page_sizes(spark, d).select("p_partkey", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"))
    w, h = F.col("w"), F.col("h")
    px, py = S.patch_grid(w, h, 14)
    mx, my = S.patch_grid(w, h, 14, 2)
    rw, rh = S.padded_to_ratio(w, h)
    sw, sh = S.parsed_size(F.concat(w.cast("string"), F.lit("X"), h.cast("string")))
    cols = {"patches_x": px, "patches_y": py, "merged_x": mx, "merged_y": my, "padded_w": rw, "padded_h": rh, "parsed_w": sw, "parsed_h": sh}
    return t.select("p_partkey", *[c.cast("int").alias(n) for n, c in cols.items()])


def _grid_sql(side: str) -> str:
    near, shrink, grow = (f"greatest(28.0, round_even({c}::DOUBLE / 28.0, 0) * 28.0)" for c in "wh"), "sqrt(w::DOUBLE * h / 602112.0)", "sqrt(3136.0 / (w::DOUBLE * h))"
    now, own = " * ".join(near), f"greatest(28.0, round_even({side}::DOUBLE / 28.0, 0) * 28.0)"
    return f"floor(CASE WHEN {now} > 602112 THEN greatest(28.0, floor({side} / {shrink} / 28.0) * 28.0) WHEN {now} < 3136 THEN ceil({side} * {grow} / 28.0) * 28.0 ELSE {own} END / 28.0)::INTEGER"


@REGISTRY("fn_resized_grid", f"SELECT p_partkey, {_grid_sql('w')} AS patches_x, {_grid_sql('h')} AS patches_y FROM (SELECT p_partkey, w::INTEGER * (1 + p_partkey % 3) AS w, h::INTEGER // (1 + p_partkey % 41) AS h FROM ({SIZES}))", "P33")
def fn_resized_grid(spark: SparkSession, d: str) -> DataFrame:
    """Patches after the resize to bounded areas; small and large pictures are among them."""
    k = F.col("p_partkey")
    t = page_sizes(spark, d).select("p_partkey", (F.col("w").cast("int") * (1 + k % 3)).alias("w"), F.floor(F.col("h").cast("int") / (1 + k % 41)).alias("h"))
    x, y = S.resized_grid(F.col("w"), F.col("h"))
    return t.select("p_partkey", x.alias("patches_x"), y.alias("patches_y"))


@REGISTRY("fn_crop_box", "WITH px AS (SELECT vec_id // 20 AS img, vec_id % 20 AS y, unnest(range(64)) AS x, unnest(embedding) AS v FROM embeddings) SELECT img, greatest(min(x) - 2, 0) AS x0, greatest(min(y) - 2, 0) AS y0, least(max(x) + 3, 64) AS x1, least(max(y) + 3, 20) AS y1 FROM px WHERE v > 0.3 GROUP BY img", "P34")
def fn_crop_box(spark: SparkSession, d: str) -> DataFrame:
    """Bounding box of marked pixels with a margin of 2, cut at the borders."""
    px = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("img"), (F.col("vec_id") % 20).alias("y"), F.posexplode("embedding").alias("x", "v")).where(F.col("v") > 0.3)
    return px.groupBy("img").agg(
        F.greatest(F.min("x") - 2, F.lit(0)).cast("bigint").alias("x0"), F.greatest(F.min("y") - 2, F.lit(0)).alias("y0"), F.least(F.max("x") + 3, F.lit(64)).cast("bigint").alias("x1"), F.least(F.max("y") + 3, F.lit(20)).alias("y1")
    )
