"""A centroid index for late interaction: candidates by nearest centroids, exact scores for them.

Centroids are fitted on a bounded sample (SAMPLE_TOKENS tokens by md5 order, a documented bound); every token is indexed. A query token
probes its nearest centroids, documents with a token there are candidates, and candidates get their exact score, so only recall is
approximate. Raising ``probes`` to the number of centroids gives the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators import cluster, vector
from pagewright.operators.sampling import few_rows
from pagewright.session import cut

SAMPLE_TOKENS = 100_000


@dataclass
class Index:
    centres: np.ndarray
    #: (document, cluster_id): which clusters a document has tokens in.
    postings: DataFrame


def build(tokens: DataFrame, doc: str, tok: str, vec: str, k: int, iterations: int = 10) -> Index:
    """Index of all token vectors of ``tokens``."""
    keyed = tokens.select(doc, F.concat_ws(":", F.col(doc).cast("string"), F.col(tok).cast("string")).alias("__id"), F.col(vec).alias("__v"))
    centres, _ = cluster.kmeans(few_rows(keyed.where("__v is not null"), "__id", SAMPLE_TOKENS, 42), "__id", "__v", k, iterations)
    near = cluster.assign(keyed.select(doc, "__v"), doc, "__v", centres)
    return Index(centres, near.select(doc, "cluster_id").distinct())


def search(index: Index, packed: DataFrame, queries: DataFrame, doc: str, query: str, top_k: int, probes: int = 4, block_vectors: int = vector.BLOCK_VECTORS) -> DataFrame:
    """(query, doc, score, rank): the best of the candidates. ``packed`` and ``queries`` hold (key, vectors)."""
    spark = packed.sparkSession
    kinds = f"`{query}` {queries.schema[query].dataType.simpleString()}, `{doc}` {packed.schema[doc].dataType.simpleString()}, score double"
    found = []
    for ids, mats, only in vector._blocks(queries, query, block_vectors):
        near = {(i, int(c)) for i, m in zip(ids, mats, strict=True) for row in m for c in np.argsort(((index.centres - row) ** 2).sum(axis=1))[:probes]}
        asked = spark.createDataFrame(sorted(near), f"`{query}` {queries.schema[query].dataType.simpleString()}, cluster_id int")  # at most block_vectors x probes rows
        pairs = index.postings.join(F.broadcast(asked), "cluster_id").select(query, doc).distinct()
        sent = spark.sparkContext.broadcast(dict(zip(ids, mats, strict=True)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            mats = sent.value
            for b in batches:
                if b.num_rows:
                    d, at = vector._list_matrix(b.column(2))
                    scores = [float((mats[q] @ d[at[i] : at[i + 1]].T).max(axis=1).sum()) for i, q in enumerate(b.column(0).to_pylist())]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores)], names=[query, doc, "score"])

        scored = vector.top(pairs.join(packed.where(F.size("vectors") > 0), doc).select(query, doc, "vectors").mapInArrow(run, kinds), [query], F.col("score"), [F.col(doc)], top_k)
        if not only:
            scored = cut(scored)
            sent.destroy()
        found.append(scored)
    if not found:
        return spark.createDataFrame([], kinds + ", rank int")
    return reduce(DataFrame.unionByName, found)
