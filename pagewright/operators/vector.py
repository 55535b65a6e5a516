"""Late-interaction and single-vector scoring.

Queries are a stated set: they are read in blocks of bounded size and each block goes to the workers once; documents are never moved.
Where there is more than one block, the result of each is written before the next is read, so neither driver nor workers hold more than one.
Each Arrow batch of packed documents is one matrix product, and only its best rows per query leave the worker, so the shuffle of a top-k
is (batches x queries x k) small rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.vectors import dot
from pagewright.operators.sampling import global_rank
from pagewright.session import cut

#: Vectors of queries that one block may hold: 16384 x 128 doubles are 16 MB. One block is on the driver at a time.
BLOCK_VECTORS = 16_384
#: Numbers that one matrix product may have at a time (64 MB).
PRODUCT_CELLS = 8_000_000
ROUND = 6


def pack(tokens: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """(key, vectors): the token vectors of each document in order. Rows without a vector are left out."""
    rows = tokens.where(F.col(vector).isNotNull()).select(key, F.struct(F.col(order).alias("o"), F.col(vector).cast("array<double>").alias("v")).alias("t"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("t")).select(key, F.col("t.v").alias("vectors"))


def _blocks(queries: DataFrame, key: str, block_vectors: int) -> Iterator[tuple[list, list[np.ndarray], bool]]:
    """Keys and matrices of each block, and whether it is the only one."""
    packed = queries.select(key, "vectors").where(F.size("vectors") > 0)
    total = packed.agg(F.sum(F.size("vectors"))).first()[0] or 0
    if total <= block_vectors:
        t = packed.toArrow()  # at most block_vectors vectors
        if t.num_rows:
            d, at = _list_matrix(t["vectors"].combine_chunks())
            yield t[key].to_pylist(), [d[at[i] : at[i + 1]] for i in range(t.num_rows)], True
        return
    ids, mats, held = [], [], 0
    for r in packed.toLocalIterator():
        m = np.array(r["vectors"], dtype=float)
        if held and held + len(m) > block_vectors:
            yield ids, mats, False
            ids, mats, held = [], [], 0
        ids.append(r[key])
        mats.append(m)
        held += len(m)
    if ids:
        yield ids, mats, False


def _list_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All token vectors below each other, and where each document begins (one entry more than documents)."""
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    inner = column.values
    first, last = int(offsets[0]), int(offsets[-1])
    inner = inner.slice(first, last - first)
    flat = inner.flatten().to_numpy(zero_copy_only=False)
    rows = last - first
    return flat.reshape(rows, -1) if rows else np.empty((0, 1)), offsets - first


def _parts(at: np.ndarray, n_queries: int) -> Iterator[tuple[int, int]]:
    """Runs of documents whose products with the queries have at most PRODUCT_CELLS numbers, or one document."""
    begin = 0
    while begin < len(at) - 1:
        end = int(np.searchsorted(at, at[begin] + max(1, PRODUCT_CELLS // n_queries), "right")) - 1
        end = min(max(end, begin + 1), len(at) - 1)
        yield begin, end
        begin = end


def _score_part(d: np.ndarray, at: np.ndarray, padded: np.ndarray, q: np.ndarray, q_at: np.ndarray) -> np.ndarray:
    """Scores (documents x queries) of the documents that begin at ``at`` in ``d``."""
    best = np.maximum.reduceat(d @ q.T, at, axis=0)
    best[padded] = np.maximum(best[padded], 0.0)
    return np.add.reduceat(best, q_at, axis=1)


def _best_rows(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Of each column the rows of the k best scores (rounded), then by ``order``."""
    rounded = -np.round(scores, ROUND)
    if len(scores) > 4 * k:  # whatever is better than or ties with the k-th
        limit = np.partition(rounded, k - 1, axis=0)[k - 1]
        some = np.nonzero((rounded <= limit).any(axis=1))[0]
        rounded, order = rounded[some], order[some]
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((np.broadcast_to(order[:, None], rounded.shape), rounded), axis=0)[:k]]


def _placed(keys: pa.Array) -> np.ndarray:
    order = np.empty(len(keys), np.int64)
    order[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
    return order


def maxsim(
    docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, top_k: int | None = None, zero_pad_block: int | None = None, block_vectors: int = BLOCK_VECTORS, group: str | None = None
) -> DataFrame:
    """(query_key, doc_key, score): the sum over query tokens of the best dot product with a document token.

    ``docs`` and ``queries`` are packed (key, vectors). Documents and queries without vectors have no score. With ``top_k`` only the best
    of each query, by score rounded to 6 decimals and then by document key. ``zero_pad_block`` n: as if documents of each batch of n (in
    their order) were filled up with zero vectors to the longest of them. ``group``: ``docs`` has ``groups``, the names of the groups a row
    is in; the result has the name as column ``group``, with ``top_k`` for each of them, and of rows with one key the best score only.
    """
    spark = docs.sparkSession
    kinds = f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, `{doc_key}` {docs.schema[doc_key].dataType.simpleString()}, score double" + (f", `{group}` string" if group else "")
    packed = docs.where(F.size("vectors") > 0).select(doc_key, "vectors", *(["groups"] if group else []))
    if zero_pad_block:
        # the length of the block's longest document goes with each document
        lengths = global_rank(packed.select(doc_key, F.size("vectors").alias("n")), [F.col(doc_key)]).withColumn("block", F.floor(F.col("rank") / zero_pad_block))
        longest = lengths.select(doc_key, (F.max("n").over(Window.partitionBy("block")) > F.col("n")).alias("padded"))
        packed = packed.join(longest, doc_key)
    else:
        packed = packed.withColumn("padded", F.lit(False))
    packed = packed.select(doc_key, "vectors", "padded", *(["groups"] if group else []))
    names = [query_key, doc_key, "score"] + ([group] if group else [])
    by = ([group] if group else []) + [query_key]
    found = []
    for ids, mats, only in _blocks(queries, query_key, block_vectors):
        sent = spark.sparkContext.broadcast((ids, np.concatenate(mats), np.cumsum([0] + [len(m) for m in mats])[:-1]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q_ids, q, q_at = sent.value
            q_ids = pa.array(q_ids)
            for batch in batches:
                if not batch.num_rows:
                    continue
                d, at = _list_matrix(batch.column(1))
                padded = batch.column(2).to_numpy(zero_copy_only=False)
                scores = np.concatenate([_score_part(d[at[a] : at[b]], at[a:b] - at[a], padded[a:b], q, q_at) for a, b in _parts(at, len(q))])  # documents x queries
                for name, rows in _grouped(batch.column(3)) if group else [(None, None)]:
                    keys, part = (batch.column(0), scores) if rows is None else _best_of_keys(batch.column(0).take(pa.array(rows)), scores[rows])
                    pick = _best_rows(part, _placed(keys), top_k) if top_k else np.broadcast_to(np.arange(len(part))[:, None], part.shape)
                    which = np.broadcast_to(np.arange(part.shape[1])[None, :], pick.shape).ravel()
                    columns = [q_ids.take(pa.array(which)), keys.take(pa.array(pick.ravel())), pa.array(part[pick.ravel(), which])]
                    yield pa.RecordBatch.from_arrays(columns + ([pa.array([name] * len(which), pa.string())] if group else []), names=names)

        scored = packed.mapInArrow(run, kinds)
        if group:
            scored = scored.groupBy(*by, doc_key).agg(F.max("score").alias("score"))
        if top_k:
            scored = top(scored, by, F.col("score"), [F.col(doc_key)], top_k).drop("rank")
        if not only:
            scored = cut(scored)
            sent.destroy()
        found.append(scored)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], kinds)


def _grouped(groups: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    """Each group's name and its rows."""
    row = np.repeat(np.arange(len(groups)), pc.list_value_length(groups).to_numpy(zero_copy_only=False))
    flat = groups.flatten().dictionary_encode()
    code = flat.indices.to_numpy()
    for i, name in enumerate(flat.dictionary.to_pylist()):
        yield name, row[code == i]


def _best_of_keys(keys: pa.Array, scores: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Of rows with one key the best score per column."""
    coded = keys.dictionary_encode()
    if len(coded.dictionary) == len(keys):
        return keys, scores
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    begin = np.nonzero(np.diff(code[order], prepend=-1))[0]
    return coded.dictionary, np.maximum.reduceat(scores[order], begin, axis=0)


def top(df: DataFrame, by: list[str], score: Column, ties: list[Column], k: int | None) -> DataFrame:
    """``df`` with ``rank`` from 0: best score first (rounded to 6 decimals), then ``ties``; only the first ``k`` if given."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.round(score, ROUND).desc(), *ties))
    ranked = df.withColumn("__place", place)
    if k is not None:
        ranked = ranked.where(F.col("__place") <= k)  # on the bare number, which lets every task keep k rows of a group before the shuffle
    return ranked.withColumn("rank", (F.col("__place") - 1).cast("int")).drop("__place")


def pages_to_documents(scored: DataFrame, page_docs: DataFrame, query_key: str, page_key: str, **how: str) -> DataFrame:
    """(query_key, document, ...): page scores as the best ("max") or mean ("avg") score of their document, under the names of ``how``. A page without a document stands for itself.

    ``page_docs``: (page_key, document), one row per page.
    """
    agg = {"max": F.max, "avg": F.avg}
    doc = F.coalesce(F.col("document"), F.col(page_key))
    return scored.join(page_docs, page_key, "left").groupBy(query_key, doc.alias("document")).agg(*[agg[h]("score").alias(n) for n, h in how.items()])


def pair_scores(pairs: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, d, s): the late-interaction score of the given pairs (q, d) alone; ``docs`` (d, vectors), ``queries`` (q, vectors)."""
    joined = pairs.join(docs.withColumnRenamed("vectors", "dv"), "d").join(queries.withColumnRenamed("vectors", "qv"), "q")
    best = F.transform("qv", lambda x: F.array_max(F.transform("dv", lambda y: dot(x, y))))
    return joined.select("q", "d", F.aggregate(best, F.lit(0.0), lambda s, x: s + x).alias("s"))


def similarity_map(q_tokens: DataFrame, patches: DataFrame, width: int) -> DataFrame:
    """(q_tok, x, y, sim) of one query (q_tok, e) over patches (pos, e), laid out in rows of ``width``. A query of more than BLOCK_VECTORS tokens raises."""
    rows = q_tokens.select("q_tok", F.col("e").cast("array<double>").alias("e")).orderBy("q_tok").limit(BLOCK_VECTORS + 1).collect()
    if len(rows) > BLOCK_VECTORS:
        raise ValueError(f"a query has at most {BLOCK_VECTORS} tokens")
    toks = F.array(*[F.struct(F.lit(r["q_tok"]).cast("long").alias("q_tok"), F.lit(r["e"]).cast("array<double>").alias("q")) for r in rows]) if rows else None
    if toks is None:
        return patches.sparkSession.createDataFrame([], "q_tok long, x long, y long, sim double")
    each = patches.select("pos", F.col("e").cast("array<double>").alias("e"), F.explode(toks).alias("t"))
    return each.select("t.q_tok", (F.col("pos") % width).alias("x"), F.floor(F.col("pos") / width).alias("y"), dot(F.col("t.q"), F.col("e")).alias("sim"))
