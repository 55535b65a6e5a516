"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.llm import contamination, frequency, leakage, neardup, overlap, residue, setjoin, splits, tokenizer
from pagewright.llm import sql as S
from pagewright.plans.registry import Registry
from pagewright.session import cut, table

REGISTRY = Registry()


def _banded(spark: SparkSession, d: str) -> DataFrame:
    """Terms are the intervals of length 1 among the suffixes of keyword lists, two keywords deep."""
    t = table(spark, d, "data_text_keywords")
    texts = t.agg(F.count_distinct("text_name")).first()[0]
    grams = frequency.gram_frequencies(t.select("text_name", F.transform("keywords", tx.norm).alias("terms")), "text_name", "terms", 2)
    return frequency.mark_bands(grams.where("n = 1"), texts)


@REGISTRY("p1_found", S.P1_FOUND)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _banded(spark, d).where(F.col("band").isNotNull()).select(F.col("gram").alias("term"), "band")


@REGISTRY("p1_frequencies", S.P1_FREQUENCIES)
def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _banded(spark, d).select(F.col("gram").alias("term"), "occurrences", F.col("records").alias("texts"), "band")


@REGISTRY("p1_word_grams", S.P1_WORD_GRAMS)
def p1_word_grams(spark: SparkSession, d: str) -> DataFrame:
    """All sequences of words inside keywords, up to the longest keyword."""
    t = table(spark, d, "data_text_keywords").select("text_name", F.explode("keywords").alias("k")).select("text_name", tx.words(F.col("k")).alias("ws"))
    longest = t.agg(F.max(F.size("ws"))).first()[0] or 1
    return frequency.gram_frequencies(t, "text_name", "ws", longest).select(F.replace("gram", F.lit(frequency.SEPARATOR), F.lit(" ")).alias("gram"), "n", "occurrences", F.col("records").alias("texts"))


@REGISTRY("p2_found", S.P2_FOUND)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "query_list"), "query_id", "query")


def _pairs(df: DataFrame, field: str) -> DataFrame:
    return df.select(F.lit(field).alias("field_name"), F.col("id_a").alias("record_id_a"), F.col("id_b").alias("record_id_b"))


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Records with their cluster ids, and those of both tables with their keywords."""
    clustered, plain = table(spark, d, "data_text_with_cluster_ids"), table(spark, d, "data_text_keywords")
    by_id = clustered.select(F.col("record_id").alias("id"), F.col("text_name").alias("name"), F.col("cluster_ids").alias("members"))

    def keyed(df: DataFrame, side: bool) -> DataFrame:
        return df.select(F.col("record_id").alias("id"), F.col("text_name").alias("name"), F.lit(side).alias("side"), tx.term_set(F.col("keywords")).alias("members"))

    return by_id, keyed(clustered, True).unionByName(keyed(plain, False))


@REGISTRY("p3_found", S.P3_FOUND)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    by_id, by_keyword = _sets(spark, d)
    ids, keywords = setjoin.at_once(lambda: overlap.similar_records(by_id, (3, 4), across=False), lambda: overlap.similar_records(by_keyword, (3, 5), across=True))
    return _pairs(ids, "cluster_ids").unionByName(_pairs(keywords, "keywords"))


@REGISTRY("p3_classes", S.P3_CLASSES)
def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per record and field: its class of equal sets and how many other classes are similar. Copies are not expanded into pairs."""
    by_id, by_keyword = _sets(spark, d)
    ids, keywords = setjoin.at_once(lambda: overlap.linked_records(by_id, (3, 4), across=False), lambda: overlap.linked_records(by_keyword, (3, 5), across=True))
    one = ids.withColumn("field_name", F.lit("cluster_ids")).unionByName(keywords.withColumn("field_name", F.lit("keywords")))
    return one.select("field_name", F.col("id").alias("record_id"), "class_id", "n_links")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_list")
    split = tx.split_key(F.col("split_name"))
    by_query = q.select(F.col("query_id").alias("id"), (split == "train").alias("in_train"), tx.word_set(F.col("query")).alias("members"))
    by_target = q.select(F.col("query_id").alias("id"), (split == "train").alias("in_train"), tx.stem_set(F.col("pos_target")).alias("members")).where(F.size("members") >= 3)
    a, b = setjoin.at_once(lambda: contamination.contained_records(by_query, (7, 10)), lambda: contamination.contained_records(by_target, (4, 5)))
    return a.withColumn("field", F.lit("query")).unionByName(b.withColumn("field", F.lit("pos_target")))


@REGISTRY("p4_found", S.P4_FOUND)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select(F.least("eval_id", "train_id").alias("query_id_a"), F.greatest("eval_id", "train_id").alias("query_id_b")).distinct()


@REGISTRY("p4_pairs", S.P4_CONTAINMENT)
def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with the share of the evaluation record that the training record has, per field."""
    return _leaks(spark, d).select("field", "eval_id", "train_id", F.round("overlap", 6).alias("overlap"), F.round("containment", 6).alias("containment"))


@REGISTRY("p4_report", S.P4_REPORT)
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source of the evaluation record: records that return in training, pairs, pairs that hold all of it, and the best containment."""
    q = table(spark, d, "query_list").select(F.col("query_id").alias("eval_id"), tx.split_key(F.col("split_name")).alias("split"), "source")
    pairs = _leaks(spark, d).groupBy("eval_id", "train_id").agg(F.max("containment").alias("c"))
    per = pairs.groupBy("eval_id").agg(F.count("*").alias("n"), F.count_if(F.col("c") == 1).alias("whole"), F.max("c").alias("best"))
    sums = [F.count("*").alias("leaked_records"), F.sum("n").alias("pairs"), F.sum("whole").alias("contained_pairs"), F.round(F.max("best"), 6).alias("best_containment")]
    return q.join(per, "eval_id").groupBy("split", "source").agg(*sums)


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.related_groups(table(spark, d, "query_list"), "query_id", "pos_target_for_deepseek", "query")


@REGISTRY("p5_found", S.P5_FOUND)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)


@REGISTRY("p5_splits")
def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every record; tested for whole groups, proportions and label deviation."""
    return splits.grouped_split(table(spark, d, "query_list"), "query_id", cut(_groups(spark, d)), tx.norm(F.col("category")), table(spark, d, "split_targets"))


@REGISTRY("p5_deviation")
def p5_deviation(spark: SparkSession, d: str) -> DataFrame:
    """How far each label's share of each split is from the wanted one."""
    q, targets = table(spark, d, "query_list"), table(spark, d, "split_targets")
    return splits.deviations(q, "query_id", p5_splits(spark, d), tx.norm(F.col("category")), targets)


@REGISTRY("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_column(table(spark, d, "documents"), "doc_id", "text")


@REGISTRY("p7_round_trip", S.P7_ROUND_TRIP)
def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The texts again from their ids."""
    return tokenizer.decode_column(p7_ids(spark, d), "doc_id", "ids")


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.passage_matches(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "item_text")


@REGISTRY("p8_found", S.P8_FOUND)
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


@REGISTRY("p8_items", S.P8_ITEMS)
def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many documents."""
    leaked = _passages(spark, d).groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("n_docs"))
    return leaked.join(table(spark, d, "eval_items").select("item_id", "item_split"), "item_id")


@REGISTRY("p8_clean_docs", S.P8_CLEAN)
def p8_clean_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents without any passage."""
    return leakage.without_leaks(table(spark, d, "documents").select("doc_id", "source"), _passages(spark, d), "doc_id")


@REGISTRY("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_cases(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


@REGISTRY("p9_kept_docs")
def p9_kept_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents without the cases."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return docs.join(residue.residue_cases(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "left_anti")
