"""k-means over whole tables; k-medoids and token pooling within one document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.sampling import shuffle_key


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def assign(points: DataFrame, key: str, vector: str, centres: np.ndarray) -> DataFrame:
    """(key, cluster_id, distance2): the nearest centre of each point; ties go to the lower number. Points without a vector are left out."""
    sent = points.sparkSession.sparkContext.broadcast(np.asarray(centres, dtype=float))  # k x dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column(1))
                d = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near])], names=[key, "cluster_id", "distance2"])

    typed = points.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>"))
    return typed.mapInArrow(run, f"`{key}` {points.schema[key].dataType.simpleString()}, cluster_id int, distance2 double")


def _sums(points: DataFrame, vector: str, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Per centre the sum and number of its points, and the squared error; each task sends k rows of partial sums."""
    sent = points.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        total, n, error = np.zeros_like(c), np.zeros(len(c)), np.zeros(len(c))
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column(0))
                d = (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None, :]
                near = d.argmin(axis=1)
                np.add.at(total, near, x)
                np.add.at(n, near, 1)
                np.add.at(error, near, d[np.arange(len(x)), near])
        flat = pa.array(total.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, c.shape[1]), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c), dtype=np.int32)), lists, pa.array(n), pa.array(error)], names=["c", "total", "n", "error"])

    parts = points.select(F.col(vector).cast("array<double>")).mapInArrow(run, "c int, total array<double>, n double, error double")
    by = parts.select("c", "n", "error", F.posexplode("total").alias("p", "x")).groupBy("c", "p").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("error").alias("error")).collect()  # k x dim numbers
    total, n, error = np.zeros_like(centres), np.zeros(len(centres)), np.zeros(len(centres))
    for r in by:
        total[r["c"], r["p"]], n[r["c"]], error[r["c"]] = r["x"], r["n"], r["error"]
    return total, n, float(error.sum())


def kmeans(points: DataFrame, key: str, vector: str, k: int, iterations: int = 25, seed: int = 42) -> tuple[np.ndarray, float]:
    """Centres and squared error by Lloyd's rounds over the whole table. Centres begin at k points of the md5 shuffle; an empty cluster keeps its centre."""
    points = points.where(F.col(vector).isNotNull())
    begin = points.orderBy(shuffle_key(F.col(key), seed), key).limit(k).select(vector).collect()
    centres = np.array([r[0] for r in begin], dtype=float)
    for _ in range(iterations):
        total, n, _ = _sums(points, vector, centres)
        moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        if np.allclose(moved, centres, atol=1e-12):
            break
        centres = moved
    return centres, _sums(points, vector, centres)[2]


def elbow(points: DataFrame, key: str, vector: str, ks: list[int], iterations: int = 10, seed: int = 42) -> list[tuple[int, float]]:
    """(k, squared error) for each k."""
    return [(k, kmeans(points, key, vector, k, iterations, seed)[1]) for k in ks]


def k_medoids(distance: np.ndarray, k: int, rounds: int = 100) -> list[int]:
    """Sorted medoids: the first has the least sum of distances, each further one lies farthest from those chosen, then they alternate. Ties: lowest number.

    In a round every point joins its nearest medoid, and each set of points takes the member with the least sum of distances to the set. The
    sums of all points to all sets are one product of the distances and the 0-1 matrix of membership.
    """
    points = np.arange(len(distance))
    if k >= len(points):
        return points.tolist()
    medoids = np.empty(k, np.int64)
    medoids[0] = np.argmin(distance @ np.ones(len(points)))
    for i in range(1, k):
        from_chosen = np.min(distance[medoids[:i]], axis=0)
        medoids[i] = np.argmax(np.where(np.isin(points, medoids[:i]), -np.inf, from_chosen))
    for _ in range(rounds):
        member = np.argmin(distance[:, medoids], axis=1)[:, None] == np.arange(k)[None, :]
        cost = np.where(member, distance @ member.astype(float), np.inf)
        moved = np.where(member.any(axis=0), np.argmin(cost, axis=0), medoids)
        if (moved == medoids).all():
            break
        medoids = moved
    return sorted(int(m) for m in medoids)


def medoid_pages(pages: DataFrame, doc: str, index: str, vector: str, k: int = 4) -> DataFrame:
    """(doc, page_index): k pages of each document by k-medoids on the cosine distance of their unit vectors."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        v = np.stack([np.asarray(x, dtype=float) for x in pdf[vector]])
        d = 1.0 - v @ v.T
        np.fill_diagonal(d, 0.0)
        kept = pdf.iloc[k_medoids(d, k)]
        return pd.DataFrame({doc: kept[doc], "page_index": kept[index].astype("int32")})

    return pages.select(doc, index, vector).groupBy(doc).applyInPandas(one, f"`{doc}` {pages.schema[doc].dataType.simpleString()}, page_index int")


def ward_clusters(points: np.ndarray, n_clusters: int) -> np.ndarray:
    """Cluster of each row by Ward's linkage (Lance-Williams on squared distances), numbered by first member."""
    n = len(points)
    d = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    size, label, live = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(n - max(1, n_clusters)):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        others = live.copy()
        others[[i, j]] = False
        merged = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        d[i, others] = d[others, i] = merged[others]
        d[j, :] = d[:, j] = np.inf
        live[j], size[i] = False, size[i] + size[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def pool_hierarchically(tokens: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Pooled token vectors and the cluster of each token: clusters of rows of 1 - E E' by Ward, their mean at unit length (zero stays zero)."""
    if factor == 1 or not len(tokens):
        return tokens, np.arange(len(tokens))
    if len(tokens) == 1:
        raise ValueError("one token cannot be pooled")
    cluster = ward_clusters(1.0 - tokens @ tokens.T, max(len(tokens) // factor, 1))
    means = np.stack([tokens[cluster == c].mean(axis=0) for c in range(cluster.max() + 1)])
    norm = np.linalg.norm(means, axis=1, keepdims=True)
    return np.where(norm > 0, means / np.where(norm > 0, norm, 1.0), means), cluster


def pooled(tokens: DataFrame, doc: str, order: str, vector: str, pool: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(doc, tok, e): each document's token vectors through ``pool``, any function of a (tokens x dim) array."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out = pool(np.stack([np.asarray(x, dtype=float) for x in pdf[vector]]))
        if out.ndim != 2:
            raise ValueError("a pool function must return a (tokens x dim) array")
        return pd.DataFrame({doc: [pdf[doc].iloc[0]] * len(out), "tok": np.arange(len(out), dtype=np.int32), "e": list(out)})

    return tokens.select(doc, order, vector).groupBy(doc).applyInPandas(one, f"`{doc}` {tokens.schema[doc].dataType.simpleString()}, tok int, e array<double>")


def pool_pairs(tokens: DataFrame, doc: str, tok: str, vector: str) -> DataFrame:
    """(doc, tok, e): neighbouring tokens 2i and 2i + 1 averaged, at unit length."""
    from pagewright.functions.vectors import normalised

    each = tokens.select(doc, F.floor(F.col(tok) / 2).alias("tok"), F.posexplode(F.col(vector).cast("array<double>")).alias("p", "x"))
    mean = each.groupBy(doc, "tok", "p").agg(F.avg("x").alias("x")).groupBy(doc, "tok").agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("v"))
    return mean.select(doc, "tok", normalised(F.col("v.x")).alias("e"))
