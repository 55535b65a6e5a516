"""Readers and writers of records, texts, pictures and results. Schemas are given, not inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.scalars import basename, file_stem, has_extension, strip

KEYWORD_RECORD = "text_name string, keywords array<string>, category string"
CLUSTER = "cluster_id int, keywords array<string>"
CLUSTERED_TEXT = KEYWORD_RECORD + ", cluster_ids array<int>, querys array<string>, querys_for_deepseek array<string>"
GROUP = "cluster_ids array<int>, text_names array<string>, group_theme string"
QUERY_RECORD = "query string, pos_target array<string>, keyword_list array<array<string>>, cluster_ids array<int>, pos_target_for_deepseek array<string>"
PAGE_RECORD = "page_name string, document_name string"
RESULT = "query string, results array<string>"
TEXT_ITEM = "id string, name string, text string, content string"


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files that hold one array or one object each. Missing fields are null; a file that is no JSON gives a row of nulls, which is left out."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    some = None
    for c in rows.columns:
        some = F.col(c).isNotNull() if some is None else some | F.col(c).isNotNull()
    return rows.where(some)


def read_record_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of files with one JSON object per line: unlike one array, these are split over tasks."""
    return spark.read.schema(schema).json(path)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(text_name, text): a folder's .txt files, whole, without outer white space. Files of no bytes (Spark does not list them) and files that are no UTF-8 are skipped; a blank file has the text ''."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("ignoreCorruptFiles", True).load(folder)
    rows = raw.select(basename(F.col("path")).alias("text_name"), F.col("content").cast("string").alias("text")).where(F.is_valid_utf8("text"))
    return rows.select("text_name", strip(F.col("text")).alias("text"))


def text_items(items: DataFrame, order: str) -> DataFrame:
    """(order, text_name, text) of items (id, name, text, content): id, else name, else text_{i}; text, else content, else ''. '' and an id of 0 count as missing. ``order`` numbers the items from 0."""
    given = F.coalesce(F.when(~F.col("id").isin("", "0"), F.col("id")), F.nullif("name", F.lit("")), F.concat(F.lit("text_"), F.col(order).cast("string")))
    return items.select(order, given.alias("text_name"), F.coalesce(F.nullif("text", F.lit("")), F.nullif("content", F.lit("")), F.lit("")).alias("text"))


def partial_texts(names: DataFrame, key: str, list_column: str, texts: DataFrame, limit: int = 5) -> DataFrame:
    """(key, place, text_name, text): the first ``limit`` names of a row that have a text; missing and empty ones are skipped after the cut."""
    few = names.select(key, F.posexplode(F.slice(list_column, 1, limit)).alias("place", "text_name"))
    return few.join(texts.where(F.length(strip(F.col("text"))) > 0), "text_name").select(key, "place", "text_name", "text")


def whole_text(names: DataFrame, name: str, texts: DataFrame, limit: int) -> DataFrame:
    """``names`` with ``text``: the text of the name, cut to ``limit`` characters, or ''."""
    from pagewright.functions.scalars import truncated

    t = texts.select(F.col("text_name").alias("__n"), F.col("text").alias("__t"))
    return names.join(t, names[name] == t["__n"], "left").withColumn("text", truncated(F.coalesce("__t", F.lit("")), limit)).drop("__n", "__t")


def list_files(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """(path, file_name, stem, length) of files with one of the endings in any case; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.where(has_extension(F.col("path"), extensions)).select("path", basename(F.col("path")).alias("file_name"), file_stem(F.col("path")).alias("stem"), "length")


def read_by_category(spark: SparkSession, root: str, file_name: str, schema: str) -> DataFrame:
    """Records of root/<category>/file_name with their category; categories are the folders that have the file."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/{file_name}")
    return rows.withColumn("category", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1))


def categories(spark: SparkSession, root: str, file_name: str) -> DataFrame:
    """(category): the folders of ``root`` that have the file; contents are not read."""
    files = spark.read.format("binaryFile").load(f"{root}/*/{file_name}").select("path")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("category")).distinct()


def read_train_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files named train-*."""
    return spark.read.parquet(f"{folder}/train-*.parquet")


#: Fixed value: how result files are named.
RESULT_NAME = r"query_list_text_(\w+?)_with_pos_target"


def result_category(file_name: Column) -> Column:
    """Category of a result file's name, else its stem."""
    return F.coalesce(F.nullif(F.regexp_extract(file_name, RESULT_NAME, 1), F.lit("")), file_stem(file_name))


def read_retrieved(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Result files (.json with "retrieved" in the name) with the category of their name."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*retrieved*.json").json(folder)
    return rows.withColumn("category", result_category(F.col("_metadata.file_name")))


def joined_pages(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, text): page texts put together in page order."""
    rows = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(text, F.lit("")).alias("t")))).alias("x"))
    return rows.select(doc, F.array_join("x.t", "").alias("text"))


def first_available(primary: Column, secondary: Column) -> Column:
    """What the first extractor gave, else what the second did."""
    return F.coalesce(F.nullif(primary, F.lit("")), secondary)


def page_records(pages: DataFrame, doc: str, index: str, ending: str = ".png") -> DataFrame:
    """(page_name, document_name): a row per page and one own row per document."""
    name = F.concat(F.col(doc), F.lit(ending))
    own = pages.select(doc).distinct().select(name.alias("page_name"), name.alias("document_name"))
    return pages.select(F.concat(F.col(doc), F.lit("_"), F.col(index).cast("string"), F.lit(ending)).alias("page_name"), name.alias("document_name")).unionByName(own)


# sinks


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, written by all tasks."""
    df.write.mode(mode).json(path)


def write_named(df: DataFrame, folder: str, name: str) -> None:
    """One file of the given name that holds an array of the rows, as JSON; for results that fit in one file."""
    spark = df.sparkSession
    array = df.select(F.to_json(F.struct(*df.columns)).alias("j")).agg(F.array_join(F.array_sort(F.collect_list("j")), ",\n").alias("all")).select(F.concat(F.lit("[\n"), "all", F.lit("\n]")).alias("value"))
    parts = f"{folder}/_{name}.parts"
    array.coalesce(1).write.mode("overwrite").text(parts)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = fs.globStatus(at(f"{parts}/part-*"))[0].getPath()
    fs.delete(at(f"{folder}/{name}"), False)
    if not fs.rename(written, at(f"{folder}/{name}")):
        raise OSError(f"{folder}/{name} cannot be written")
    fs.delete(at(parts), True)


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A vector collection as Parquet; its reading replaces loading and its folder the collection."""
    df.write.mode(mode).parquet(path)


def drop_vectors(spark: SparkSession, path: str) -> None:
    """Remove a vector collection, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def metrics_name(kind: str, tag: str | None, fallback: str) -> str:
    """metrics_{tag}.json or eval_{tag}.json; without a tag the given fallback (a run's number) stands for it."""
    return f"{kind}_{tag or fallback}.json"


def drop_collection(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def save_collection(df: DataFrame, name: str) -> None:
    """A named table; one that exists is replaced."""
    df.write.mode("overwrite").saveAsTable(name)


def missing_only(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose output does not exist yet."""
    return df.join(existing.select(key).distinct(), key, "left_anti")


def example_set(spark: SparkSession) -> DataFrame:
    """Four literal rows to try a pipeline on."""
    schema = T.StructType([T.StructField("query", T.StringType()), T.StructField("image", T.StringType()), T.StructField("part", T.StringType())])
    return spark.createDataFrame([(f"question {i}", f"page_{i}.png", "train" if i < 2 else "eval") for i in range(4)], schema)
