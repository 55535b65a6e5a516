"""Frequencies of all values and n-grams from a distributed suffix array.

Each record is a sequence of values (terms). The suffixes at every position, cut to ``depth`` values, are sorted over the cluster by
suffix and record: a range shuffle on both, so that a value that fills a third of the table is spread over many partitions by record.
Equal suffixes of one record are one weighted row before that shuffle; different ones that begin alike, such as a term that stands in a
record several times before different terms, stay several rows of the same interval. A common-prefix interval of n values holds the occurrences of an
n-gram: the weights in it add up to the number of occurrences, and its rows less the adjacencies of rows of the same record (each row
with an earlier row of its record in the same interval) are the number of records.

Intervals are read in Arrow batches. One that ends within its batch gives one row; what crosses a batch's border is given out by record
and added up by an ordinary aggregate, so no task holds more than a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x01"
#: Stands for a null record, which counts occurrences but is no record.
NO_RECORD = "\x00"


def _intervals(suffixes: pa.Array, records: pa.Array, weights: np.ndarray, depth: int) -> Iterator[pa.RecordBatch]:
    """Rows (gram, n, occurrences, records, record) of one batch in suffix order; record is null where the interval lies within the batch."""
    rows = len(suffixes)
    values = pc.split_pattern(suffixes, SEPARATOR)
    length = pc.list_value_length(values).to_numpy(zero_copy_only=False)
    code = records.dictionary_encode().indices.to_numpy()
    order = np.argsort(code, kind="stable")
    earlier = np.full(rows, -1)  # the row before with the same record
    same = code[order[1:]] == code[order[:-1]]
    earlier[order[1:][same]] = order[:-1][same]
    named = pc.not_equal(records, NO_RECORD).to_numpy(zero_copy_only=False)
    names = ["gram", "n", "occurrences", "records", "record"]
    for n in range(1, min(depth, int(length.max())) + 1):
        grams = suffixes if n == depth else pc.binary_join(pc.list_slice(values, 0, n), SEPARATOR)
        long_enough = length >= n
        new = np.ones(rows, bool)
        if rows > 1:
            new[1:] = pc.not_equal(grams.slice(1), grams.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
        begin = np.nonzero(new)[0]
        start = begin[np.cumsum(new) - 1]
        again = earlier >= start  # an adjacency: the record stands in this interval already
        occurrences, distinct = np.add.reduceat(weights, begin), np.add.reduceat(named.astype(np.int64), begin) - np.add.reduceat((again & named).astype(np.int64), begin)
        inner = long_enough[begin]
        inner[[0, -1]] = False
        at = begin[inner]
        yield pa.RecordBatch.from_arrays(
            [grams.take(pa.array(at)), pa.array(np.full(len(at), n, np.int32)), pa.array(occurrences[inner]), pa.array(distinct[inner]), pa.nulls(len(at), records.type)], names=names
        )
        outer = np.unique(np.concatenate([np.arange(0, begin[1] if len(begin) > 1 else rows), np.arange(begin[-1], rows)]))
        outer = outer[long_enough[outer]]
        yield pa.RecordBatch.from_arrays(
            [grams.take(pa.array(outer)), pa.array(np.full(len(outer), n, np.int32)), pa.array(weights[outer]), pa.nulls(len(outer), pa.int64()), records.take(pa.array(outer))], names=names
        )


def gram_frequencies(df: DataFrame, record: str, values: str, depth: int = 1) -> DataFrame:
    """(gram, n, occurrences, records) of all sequences of 1 to ``depth`` neighbouring values of ``values`` (an array of strings).

    ``gram`` joins the values by \\x01. ``records`` counts distinct values of ``record``; rows whose ``record`` is null
    count as occurrences only. Null and empty values are left out before neighbours are formed; null and empty arrays give nothing. Repeated rows count as
    occurrences, and as the same record. Values must not hold \\x01.
    """
    clean = df.select(F.coalesce(F.col(record).cast("string"), F.lit(NO_RECORD)).alias("record"), F.filter(values, lambda x: x.isNotNull() & (x != "")).alias("vs"))
    suffix = F.explode(F.transform(F.col("vs"), lambda v, i: F.concat_ws(SEPARATOR, F.slice("vs", i + 1, depth))))
    rows = clean.where(F.size("vs") > 0).select("record", suffix.alias("suffix")).groupBy("suffix", "record").agg(F.count("*").alias("weight"))
    in_order = rows.repartitionByRange("suffix", "record").sortWithinPartitions("suffix", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from _intervals(b.column(0), b.column(1), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64), depth)

    parts = in_order.select("suffix", "record", "weight").mapInArrow(run, "gram string, n int, occurrences bigint, records bigint, record string")
    # by record first: a record may stand on both sides of a border
    by_record = parts.groupBy("gram", "n", "record").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return by_record.groupBy("gram", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum(F.when(F.col("record") == NO_RECORD, 0).otherwise(F.coalesce("records", F.lit(1)))).cast("bigint").alias("records"))


def mark_bands(freq: DataFrame, n_records: int, rare_below: int = 3, common_percent: int = 5) -> DataFrame:
    """``freq`` with ``band``: rare (in fewer than ``rare_below`` records), common (in at least ``common_percent`` % of ``n_records``), else null. Rare goes first."""
    r = F.col("records")
    return freq.withColumn("band", F.when(r < rare_below, "rare").when(r * 100 >= F.lit(n_records) * common_percent, "common"))
