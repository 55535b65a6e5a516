"""Rows of the queries that have no SQL, on the smallest tables, against plain Python."""

from pathlib import Path

import numpy as np
import pytest

from pagewright.operators import cluster
from pagewright.plans import io_queries, retrieval_queries, training_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    return np.array([r.embedding for r in rows], dtype=float)


def lloyd(x, starts, rounds):
    c = x[starts]
    for _ in range(rounds):
        near = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1).sum()


def starts(n, k):
    import hashlib

    return sorted(range(n), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))[:k]


def test_kmeans_and_elbow(spark, vectors):
    k = min(int(min(max(len(vectors) ** 0.5, 2), 100)), len(vectors))
    got = {r.vec_id: (r.cluster_id, r.distance2) for r in training_queries.cluster_kmeans(spark, DATA).collect()}
    near, error = lloyd(vectors, starts(len(vectors), k), 25)
    assert len(got) == len(vectors) and np.mean([got[i][0] == near[i] for i in range(len(vectors))]) > 0.999
    assert sum(d for _, d in got.values()) == pytest.approx(error, rel=1e-6)
    for r in training_queries.cluster_elbow(spark, DATA).collect():
        assert r.error == pytest.approx(lloyd(vectors, starts(len(vectors), r.k), 10)[1], rel=1e-6)


def medoids_by_search(d, k):
    """The definition, one sum at a time."""
    n = len(d)
    if n <= k:
        return list(range(n))
    m = [min(range(n), key=lambda i: (round(sum(d[i]), 12), i))]
    while len(m) < k:
        m.append(max((i for i in range(n) if i not in m), key=lambda i: (min(d[i][j] for j in m), -i)))
    for _ in range(100):
        sets = [[i for i in range(n) if min(range(k), key=lambda c: (d[i][m[c]], c)) == c] for c in range(k)]
        new = [min(s, key=lambda i: (round(sum(d[i][j] for j in s), 12), i)) if s else m[c] for c, s in enumerate(sets)]
        if new == m:
            break
        m = new
    return sorted(m)


def test_medoid_pages(spark, vectors):
    got = {}
    for r in training_queries.cluster_medoid_pages(spark, DATA).collect():
        got.setdefault(r.doc_id, []).append(r.page_index)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for doc in range(len(vectors) // 10):
        e = unit[10 * doc : 10 * doc + 10]
        d = 1 - e @ e.T
        np.fill_diagonal(d, 0)
        assert sorted(got[doc]) == medoids_by_search(d.tolist(), 4)


def test_pooled_tokens(spark, vectors):
    got = {}
    for r in training_queries.cluster_pooled_tokens(spark, DATA).collect():
        got.setdefault(r.doc_id, {})[r.tok] = np.array(r.e)
    mean = {r.doc_id: np.array(r.e) for r in training_queries.cluster_pooled_by_function(spark, DATA).collect()}
    for doc in range(len(vectors) // 10):
        e = vectors[10 * doc : 10 * doc + 10]
        want = cluster.pool_hierarchically(e, 3)[0]
        assert len(got[doc]) == len(want) == 3 and all(np.allclose(got[doc][i], want[i]) for i in range(3))
        assert np.allclose(mean[doc], e.mean(axis=0))


def test_indexed_search_finds_most(spark, vectors):
    got = {}
    for r in retrieval_queries.vec_indexed_top10(spark, DATA).collect():
        got.setdefault(r.qid, set()).add(r.doc_id)
    scores = (vectors @ vectors.T).reshape(len(vectors) // 4, 4, len(vectors) // 10, 10).max(axis=3).sum(axis=1)
    best = [set(np.argsort(-s, kind="stable")[:10].tolist()) for s in scores]
    assert set(got) == set(range(len(best))) and sum(len(best[q] & got[q]) for q in got) >= 0.9 * 10 * len(best)


def test_places_for_models(spark):
    n = spark.read.parquet(f"{DATA}/query_list.parquet")
    encoded = {r.query_id: r.n_vectors for r in io_queries.ext_encoded_queries(spark, DATA).collect()}
    words = {r.query_id: len((r.query or "").split()) for r in n.collect()}
    assert set(encoded) <= set(words) and all(v >= 1 for v in encoded.values()) and len(encoded) >= sum(w > 0 for w in words.values())
    keywords = io_queries.ext_generated_keywords(spark, DATA).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert keywords and all(r["keywords"] and (docs[r.doc_id] or "").strip() for r in keywords)
    made = io_queries.ext_generated_queries(spark, DATA).collect()
    assert made and all(r["query"].strip() and 3 <= len(r.pos_target) <= 5 and len(r.group_theme) <= 200 for r in made)
    listed = {r.record_id: r.querys for r in spark.read.parquet(f"{DATA}/data_text_with_cluster_ids.parquet").collect()}
    judged = io_queries.ext_judged_queries(spark, DATA)
    assert {"record_id"} <= set(judged.columns)
    kept = judged.collect()
    lists = [c for c in judged.columns if isinstance(kept[0][c], list)] if kept else []
    assert all(set(r[c] or []) <= set(listed[r.record_id]) for r in kept for c in lists)
