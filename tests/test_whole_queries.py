"""Queries without SQL over all rows of a table, against brute force."""

import numpy as np

from pagewright.plans import retrieval_queries


def test_indexed_search_asks_every_row(spark, tmp_path):
    rnd = np.random.default_rng(5)
    e = rnd.normal(size=(200, 8))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(e)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in retrieval_queries.vec_indexed_top10(spark, str(tmp_path)).collect():
        got.setdefault(r.qid, {})[r.doc_id] = r.score
    assert set(got) == set(range(50)) and all(len(x) == 10 for x in got.values())
    e = e.astype(np.float32).astype(float)
    scores = (e @ e.T).reshape(50, 4, 20, 10).max(axis=3).sum(axis=1)
    best = {q: set(np.argsort(-scores[q])[:10].tolist()) for q in range(50)}
    assert sum(len(best[q] & set(got[q])) for q in range(50)) >= 0.9 * 500
    assert all(abs(s - scores[q, d]) < 1e-6 for q, x in got.items() for d, s in x.items())
