"""Operators on small tables: literal cases, brute force and invariants."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import scalars as S
from pagewright.functions import text as tx
from pagewright.operators import cluster as C
from pagewright.operators import collate, grouping, index, losses, pages, ranking, relational, sampling, vector


def column(spark, values, kind, make):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_names(spark):
    names = ["a/b/x.tar.gz", "x.png", "noext", " y.txt ", "", "dir.v1/z", "a.b.png", None]
    assert column(spark, names, "string", S.file_stem) == ["x.tar", "x", "noext", " y", "", "z", "a.b", None]
    assert column(spark, names, "string", S.stripped_stem) == ["x.tar", "x", "noext", "y", "", "z", "a.b", ""]
    assert column(spark, names, "string", S.first_dot_stem) == ["x", "x", "noext", " y", "", "z", "a", None]
    assert column(spark, ["0046587_0", "0046587_12", "doc_x", "plain", "a_99999999999"], "string", S.page_number) == [0, 12, 0, 0, 0]
    assert column(spark, ["C:\\t\\A.TXT", " q/r/S.pdf\n", "x.png.png", "a.doc", None, "  ", ".txt"], "string", tx.name_stem) == ["a", "s", "x.png", "a.doc", None, "", ""]
    assert column(spark, [" A--b_C ", "土壤 数据", "..", None], "string", tx.norm) == ["a b c", "土壤 数据", "", None]
    assert column(spark, [" Dev", "TRAINING", "x", None, "Testing "], "string", tx.split_key) == ["validation", "train", None, None, "test"]


def sample(t):
    if len(t) <= 8000:
        return t
    middle = t[2000:-2000]
    if len(middle) > 4000:
        middle = "".join(middle[i * (len(middle) - 500) // 7 :][:500] for i in range(8))
    return t[:2000] + middle + t[-2000:]


def test_texts(spark):
    texts = ["".join(chr(97 + i * i % 26) for i in range(n)) for n in (0, 7999, 8000, 8001, 9000, 12000, 40001)]
    assert column(spark, texts, "string", S.head_middle_tail) == [sample(t) for t in texts]
    assert column(spark, ["abcdef", "abc", None], "string", lambda c: S.truncated(c, 4)) == ["abc…", "abc", None]
    assert column(spark, ["abcdef"], "string", lambda c: S.truncated(c, 0)) == ["abcdef"]
    assert column(spark, ["x" * 300, " \n a \t"], "string", S.short_theme) == ["x" * 200, "a"]


def test_lists(spark):
    lists = [["a", " "], [" ", ""], [], None, [None]]
    assert column(spark, lists, "array<string>", S.has_text) == [True, False, False, False, False]
    assert column(spark, lists, "array<string>", S.size_or_zero) == [2, 2, 0, 0, 1]
    assert column(spark, [["a", "b", "a", "c"], None], "array<string>", lambda c: S.kept_members(c, F.array(F.lit("a"), F.lit("c")))) == [["a", "a", "c"], []]
    assert column(spark, ["", "x", None], "string", S.listed) == [[], ["x"], []]


EXPECTED = {
    "first4": lambda n: list(range(min(4, n))), "first9": lambda n: list(range(min(9, n))), "all_pages": lambda n: list(range(n)), "first2_last2": lambda n: [0, 1, n - 2, n - 1] if n >= 4 else list(range(n)),
    "last4": lambda n: list(range(n - 4, n)) if n >= 4 else list(range(n)), "uniform4": lambda n: [round(i * (n - 1) / 3) for i in range(4)] if n >= 4 else list(range(n)),
}


def test_page_choice(spark):
    counts = [0, 1, 2, 3, 4, 5, 9, 10, 16, 17, 20, 21, 30]
    docs = spark.createDataFrame([(f"d{n}", n) for n in counts], "doc string, n int")
    for s in pages.EVALUATED:
        got = {r.n: r.p for r in docs.select("n", pages.chosen_pages(s, F.col("n"), F.col("doc")).alias("p")).collect()}
        for n in counts:
            if s == "random4":
                assert len(got[n]) == min(4, n) and got[n] == sorted(set(got[n]))
            else:
                assert got[n] == EXPECTED[s](n), (s, n)
    with pytest.raises(ValueError):
        pages.chosen_pages("best4", F.col("n"))


def test_tiles(spark):
    docs = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 7)], "n int")
    got = {(s, r.n): r.t for s in pages.COMPOSED for r in docs.select("n", pages.composed_tiles(s, F.col("n"), F.col("n")).alias("t")).collect()}
    assert got["last4", 2] == [0, 1, 1, 0] and got["last4", 3] == [0, 1, 2, 2] and got["last4", 7] == [3, 4, 5, 6]
    assert got["first2_last2", 1] == [0, 0, 0, 0] and got["first2_last2", 7] == [0, 1, 5, 6]
    assert got["uniform4", 2] == [0, 0, 1, 1] and got["first4", 3] == [0, 1, 2, None] and got["first9", 4] == [0, 1, 2, 3, 0, 1, 2, 3, 0] and got["first1", 7] == [0]


def test_metrics_literal(spark):
    truth = spark.createDataFrame([("q", "a"), ("q", "b"), ("ideal", "a"), ("none", "z")], "q string, d string")
    res = spark.createDataFrame([("q", "x", 0), ("q", "a", 1), ("ideal", "a", 0), ("free", "a", 0)], "q string, d string, rank int")
    got = {(r.q, r.k): r for r in ranking.query_metrics(res, truth, "q", "d").collect()}
    assert ("free", 1) not in got and got["none", 10].ndcg == 0
    assert got["ideal", 1].ndcg == 1 and got["ideal", 10].precision == 0.1 and got["q", 1].mrr == 0
    assert got["q", 3].recall == 0.5 and got["q", 3].mrr == 0.5 and math.isclose(got["q", 3].ndcg, (1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert ranking.query_metrics(res.limit(0), truth, "q", "d").where("recall > 0").count() == 0
    twice = spark.createDataFrame([("q", "x", 0), ("q", "a", 1), ("q", "x", 2), ("q", "b", 3)], "q string, d string, rank int")
    assert sorted((r.d, r["rank"]) for r in ranking.deduplicated(twice, "q", "d").collect()) == [("a", 1), ("b", 2), ("x", 0)]


def test_maxsim(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    docs = {i: rnd.normal(size=(rnd.integers(1, 6), 5)) for i in range(40)}
    queries = {i: rnd.normal(size=(rnd.integers(1, 4), 5)) for i in range(7)}
    d = spark.createDataFrame([(i, [[float(x) for x in v] for v in m]) for i, m in docs.items()] + [(99, [])], "doc long, vectors array<array<double>>")
    q = spark.createDataFrame([(i, [[float(x) for x in v] for v in m]) for i, m in queries.items()], "q long, vectors array<array<double>>")
    want = {(i, j): (queries[i] @ docs[j].T).max(axis=1).sum() for i in queries for j in docs}
    for block, cells in ((2, 8), (4096, 8_000_000)):
        monkeypatch.setattr(vector, "PRODUCT_CELLS", cells)
        got = {(r.q, r.doc): r.score for r in vector.maxsim(d, q, "doc", "q", block_vectors=block).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
        top = {(r.q, r.doc) for r in vector.maxsim(d, q, "doc", "q", 3, block_vectors=block).collect()}
        assert top == {(i, j) for i in queries for j in sorted(docs, key=lambda j: (-round(want[i, j], 6), j))[:3]}
    assert vector.maxsim(d, q.limit(0), "doc", "q", 3).count() == 0 and vector.maxsim(d.limit(0), q, "doc", "q", 3).count() == 0


def test_centroid_index(spark):
    """Every token is indexed; recall against brute force is at least 0.9."""
    rnd = np.random.default_rng(4)
    topics = rnd.normal(size=(12, 16))
    docs = {i: topics[rnd.integers(12, size=4)] + 0.4 * rnd.normal(size=(4, 16)) for i in range(300)}
    tokens = spark.createDataFrame([(i, t, [float(x) for x in v]) for i, m in docs.items() for t, v in enumerate(m)], "doc long, tok int, e array<double>")
    queries = spark.createDataFrame([(i, [[float(x) for x in v + 0.1] for v in docs[i][:2]]) for i in range(0, 300, 20)], "q long, vectors array<array<double>>")
    built, packed = index.build(tokens, "doc", "tok", "e", 12), vector.pack(tokens, "doc", "tok", "e")
    assert built.postings.select("doc").distinct().count() == 300
    got = index.search(built, packed, queries, "doc", "q", 10, probes=3)
    want = vector.maxsim(packed, queries, "doc", "q", 10)
    hit = got.join(want.select("q", "doc"), ["q", "doc"]).count()
    assert hit >= 0.9 * want.count()
    scores = {(r.q, r.doc): r.score for r in want.collect()}
    assert all(math.isclose(r.score, scores[r.q, r.doc]) for r in got.collect() if (r.q, r.doc) in scores)


def test_global_rank_and_samples(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("k")).repartition(5)
    ranks = {r.k: r["rank"] for r in sampling.global_rank(df, [-F.col("k")]).collect()}
    assert ranks == {k: 499 - k for k in range(500)}
    within = {r.k: r["rank"] for r in sampling.global_rank(df, [F.col("k")], by=["g"]).collect()}
    assert within == {k: k // 3 for k in range(500)}
    pools = sampling.nested_pools(df, "k", [0.001, 0.2, 1.0]).collect()
    by = {r: {x.k for x in pools if x.ratio == r} for r in (0.001, 0.2, 1.0)}
    assert [len(by[r]) for r in (0.001, 0.2, 1.0)] == [1, 100, 500] and by[0.001] < by[0.2] < by[1.0]
    parts = sampling.train_eval(df, "k", 0.1).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 450, "eval": 50}
    batches = sampling.single_source_batches(df, "g", "k", 16, 1).toPandas()
    assert (batches.groupby("batch_order").g.nunique() == 1).all() and (batches.groupby("batch_order").k.count() == 16).all() and len(batches) == 480
    assert sampling.global_rank(df.limit(0), [F.col("k")], by=["g"]).count() == 0
    pool = sampling.sized_pool(df.withColumn("p", F.col("k") < 20), "k", "p", 50)
    assert pool.count() == 50 and pool.where("p").count() == 20
    assert sampling.sized_pool(df.withColumn("p", F.col("k") < 20), "k", "p", 5).count() == 20


def brute_groups(rows, k, low=3, high=5):
    index, seen, out = {}, set(), []
    for name, ids in rows:
        for c in ids:
            index.setdefault(c, set()).add(name)
    for name, ids in rows:
        ids = sorted(set(ids))
        for combo in ([tuple(ids)] if len(ids) < k else itertools.combinations(ids, k)) if ids else []:
            members = frozenset(set.intersection(*(index[c] for c in combo)))
            if low <= len(members) <= high and members not in seen:
                seen.add(members)
                out.append((k, combo, tuple(sorted(members))))
    return out


def test_similar_groups(spark):
    rnd = np.random.default_rng(5)
    rows = [(f"t{i:02d}", sorted({int(x) for x in rnd.integers(0, 14, rnd.integers(0, 8))})) for i in range(60)]
    df = spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(rows)] + [(98, "empty", []), (99, "null", None)], "record_id long, text_name string, cluster_ids array<int>").withColumn("combo", F.lit(1))
    ks = list(range(2, 8))
    got = {(r.k, tuple(r.cluster_ids), tuple(r.text_names)) for r in grouping.similar_groups(df, ks).collect()}
    assert got == {g for k in ks for g in brute_groups(rows, k)}
    assert grouping.all_groups(df, ks).count() == len({g[1:] for g in got})
    assert grouping.similar_groups(df.limit(0), ks).count() == 0


def test_medoids_and_ward():
    points = np.concatenate([np.random.default_rng(i).normal(size=(6, 2)) * 0.1 + c for i, c in enumerate([(0, 0), (5, 5), (0, 9), (9, 0)])])
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    assert sorted(m // 6 for m in C.k_medoids(d, 4)) == [0, 1, 2, 3] and C.k_medoids(d[:3, :3], 4) == [0, 1, 2]
    label = C.ward_clusters(points, 4)
    assert [len(set(label[i : i + 6])) for i in range(0, 24, 6)] == [1, 1, 1, 1] and len(set(label)) == 4
    tokens = points / np.linalg.norm(points, axis=1, keepdims=True)
    pooled, of = C.pool_hierarchically(tokens, 3)
    assert len(pooled) <= 8 and np.allclose(np.linalg.norm(pooled, axis=1), 1) and len(of) == 24
    assert C.pool_hierarchically(tokens, 1)[0] is tokens
    with pytest.raises(ValueError):
        C.pool_hierarchically(tokens[:1], 2)


def test_kmeans(spark):
    rnd = np.random.default_rng(0)
    x = np.concatenate([rnd.normal(size=(40, 3)) * 0.1 + c for c in ([0, 0, 0], [4, 0, 0], [0, 4, 0])])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(500, None)], "id long, v array<double>")
    centres, error = C.kmeans(df, "id", "v", 3)
    got = {r.id: r.cluster_id for r in C.assign(df, "id", "v", centres).collect()}
    d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert got == {i: int(c) for i, c in enumerate(d.argmin(axis=1))} and math.isclose(error, d.min(axis=1).sum(), rel_tol=1e-6)
    assert C.elbow(df, "id", "v", [1, 3])[0][1] > error
    assert [grouping.cluster_count(n) for n in (1, 2, 10, 500, 10**6)] == [1, 2, 3, 22, 100]


def test_losses(spark):
    rnd = np.random.default_rng(2)
    s = rnd.normal(size=(4, 4))
    scores = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(4) for j in range(4)], "q int, d int, s double")
    pos = spark.createDataFrame([(i, i) for i in range(4)], "q int, d int")
    lse = np.log(np.exp(s / 0.5).sum(axis=1))
    assert math.isclose(losses.info_nce(scores, pos, 0.5).first()[0], (lse - s.diagonal() / 0.5).mean())
    hard = [max(np.delete(s[i], i)) if s[i].argmax() == i else s[i].max() for i in range(4)]
    assert math.isclose(losses.pairwise(scores, pos).first()[0], np.log1p(np.exp(hard - s.diagonal())).mean())
    some = spark.createDataFrame([(0, 1), (0, 2), (2, 3)], "q int, d int")
    want = sum(lse[q] - np.log(sum(np.exp(s[q, d] / 0.5) for d in ds)) for q, ds in ((0, (1, 2)), (2, (3,)))) / 4
    assert math.isclose(losses.multi_positive(scores, some, 0.5).first()[0], want)
    assert losses.combined(scores, some, 200).first()[0] == losses.multi_positive(scores, some).first()[0]
    lengths = spark.createDataFrame([(i, 1) for i in range(4)], "q int, len int")
    with pytest.raises(ValueError):
        losses.normalised_scores(scores, lengths, strict=True)
    assert losses.BY_NAME["info_nce"] is losses.info_nce


def test_masks(spark):
    ex = spark.createDataFrame([(0, 1, ["a", "b"]), (0, 2, ["b", "b"]), (0, 3, []), (1, 4, ["a"])], "batch int, q int, ts array<string>")
    m = collate.multi_positive_mask(ex, "batch", "q", "ts", 5).toPandas()
    assert len(m) == 3 * 4 + 1 and m[m.batch == 0].groupby("column").is_positive.sum().tolist() == [1, 1, 1, 1]
    m = collate.shared_positive_mask(ex, "batch", "q", "ts", 5).toPandas()
    assert len(m) == 3 * 2 + 1 and m[(m.batch == 0) & (m.doc == "b")].sort_values("q").is_positive.tolist() == [True, True, False]


def test_relations(spark):
    df = spark.createDataFrame([(1, "x", ["t1", "t2", "t1"]), (2, "x", None), (3, None, []), (4, None, ["t2", None]), (5, "y", ["t9"])], "id long, q string, ts array<string>")
    inv = {r.member: r.vals for r in relational.inverted(df, "id", "ts", "id").collect()}
    assert inv == {"t1": [1, 1], "t2": [1, 4], "t9": [5]}
    assert [r.id for r in relational.exactly_once(df, "q").orderBy("id").collect()] == [5]
    assert {r.id: r.vals for r in relational.attached(df.select("id", "q"), "q", relational.inverted(df, "id", "ts", "id")).collect()} == {i: [] for i in range(1, 6)}
    h = relational.histogram(df, F.coalesce(F.col("q"), F.lit("-"))).collect()
    assert {r.value: (r.n, r.percent) for r in h} == {"x": (2, 40.0), "-": (2, 40.0), "y": (1, 20.0)}
    assert relational.histogram(df.limit(0), F.col("q")).count() == 0
    old = df.select("q", F.col("id").alias("o"))
    assert relational.merged_groups(old, old, ["q"], "o").count() == 3


def test_routed_batches(spark):
    from pagewright.operators import collate

    df = spark.createDataFrame([(1, 5, "image"), (1, 3, "text"), (2, 1, "image"), (3, 1, None)], "b long, i long, kind string")
    got = {(r.b, r.i): r.route for r in collate.routed(df.where("b < 3"), "b", "i", F.col("kind")).collect()}
    assert got == {(1, 5): "text", (1, 3): "text", (2, 1): "image"}
    assert collate.routed(df.limit(0), "b", "i", F.col("kind")).count() == 0
    with pytest.raises(Exception, match="unsupported kind"):
        collate.routed(df, "b", "i", F.col("kind")).collect()
