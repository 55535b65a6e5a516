"""Near duplicates, similar sets, leaks between splits: against brute force, and on empty, null, repeated and hot input."""

import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import contamination, neardup, overlap, setjoin
from pagewright.session import cut


def words(s):
    return frozenset(re.findall(r"[^\W_]+", (s or "").lower()))


def alike(a, b, ratio):
    p, q = ratio
    both = len(a & b)
    return bool(a) and bool(b) and both * (p + q) >= (len(a) + len(b)) * p


def groups_of(rows, links):
    parent = {r: r for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    out = {}
    for r in rows:
        out.setdefault(root(r), []).append(r)
    return {(g, r) for g, m in out.items() if len(m) > 1 for r in m}


def random_texts(seed, n, vocabulary=60, common=8):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        k = rnd.randint(1, 12)
        base = [f"c{i}" for i in range(common) if rnd.random() < 0.8]
        out.append(" ".join(base + [f"w{rnd.randint(0, vocabulary)}" for _ in range(k)]))
    for _ in range(n // 2):
        t = rnd.choice(out).split()
        if len(t) > 3:
            t[rnd.randrange(len(t))] = f"w{rnd.randint(0, vocabulary)}"
        rnd.shuffle(t)
        out.append(" ".join(t))
    return out


RULES = {
    "members": lambda sets, ratio: {},
    "grams": lambda sets, ratio: {"rule": setjoin.Grams(ratio), "tokens": contamination.word_grams(sets)},
    "fingerprints": lambda sets, ratio: {"rule": neardup.Fingerprint(ratio), "tokens": neardup.fingerprints(sets, ratio)},
}
#: Sizes from which blocks are hot and large, and the cost of a row of a split block; with 0 blocks are split wherever that helps at all.
WAYS = [(120, 2048, 100), (2, 2048, 100), (2, 5, 100), (2, 5, 0), (10, 20, 0)]


@pytest.mark.parametrize("hot, tile, cost", WAYS)
@pytest.mark.parametrize("ratio, how", [((7, 10), "members"), ((7, 10), "grams"), ((7, 10), "fingerprints"), ((3, 4), "members"), ((3, 5), "members"), ((4, 5), "grams"), ((3, 5), "fingerprints")])
def test_pairs_equal_brute_force(spark, monkeypatch, ratio, how, hot, tile, cost):
    monkeypatch.setattr(setjoin, "ROW_COST", cost)
    texts = random_texts(5, 120)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", F.split("t", " ").alias("m"))
    member, sets = setjoin.classes(df, "id", "m")
    sets = cut(sets)
    pairs = setjoin.similar_sets(sets, ratio, hot=hot, tile=tile, **RULES[how](sets, ratio)).collect()
    assert len({(min(r.a, r.b), max(r.a, r.b)) for r in pairs}) == len(pairs)
    by = {}
    for r in member.collect():
        by.setdefault(r.set_id, words(texts[r.id]))
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(by, 2) if alike(by[a], by[b], ratio)}
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in pairs} == want
    assert all(r.common == len(by[r.a] & by[r.b]) for r in pairs)


@pytest.mark.parametrize("hot, tile, cost", WAYS)
def test_links_keep_groups(spark, monkeypatch, hot, tile, cost):
    monkeypatch.setattr(setjoin, "ROW_COST", cost)
    texts = random_texts(9, 100, vocabulary=25)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", F.split("t", " ").alias("m"))
    member, sets = setjoin.classes(df, "id", "m")
    sets = cut(sets)
    links = [(r.a, r.b) for r in neardup.close_sets(sets, (7, 10), hot=hot, tile=tile).collect()]
    by = {r.set_id: words(texts[r.id]) for r in member.collect()}
    want = [(a, b) for a, b in itertools.combinations(sorted(by), 2) if alike(by[a], by[b], (7, 10))]
    assert groups_of(sorted(by), links) == groups_of(sorted(by), want)
    assert all(alike(by[a], by[b], (7, 10)) for a, b in links)


def test_near_duplicate_groups(spark):
    base = "find documents about flood plan near the old harbour of north town"
    texts = [base, base + " please", base.upper() + "!!", "  ", None, "?", "", "other words here", "here other words", base.replace("harbour", "station"), "查找 土壤 数据"]
    texts += [f"unrelated text number {i} with own words a{i} b{i} c{i} d{i} e{i}" for i in range(30)]
    rows = list(enumerate(texts, 100))
    df = spark.createDataFrame(rows, "query_id long, query string").withColumn("toks", F.lit("x")).withColumn("label", F.lit(1)).withColumn("set_id", F.lit(2))
    got = {(r.group_id, r.query_id) for r in neardup.near_duplicate_groups(df, "query_id", "query").collect()}
    links = [(a, b) for (a, s), (b, t) in itertools.combinations(rows, 2) if alike(words(s), words(t), (7, 10))]
    assert got == groups_of([r[0] for r in rows], links)
    assert neardup.near_duplicate_groups(df.limit(0), "query_id", "query").count() == 0


def test_hot_families_stay_whole(spark):
    """A third of all rows are edits of one text, another third are copies of one."""
    family = [" ".join(f"k{i}" for i in range(9)) + f" own{j}" for j in range(200)]
    copies = ["same text in every row of this part"] * 200
    rest = [f"alone{j} a{j} b{j} c{j}" for j in range(200)]
    rows = list(enumerate(family + copies + rest))
    df = spark.createDataFrame(rows, "query_id long, query string")
    got = {(r.group_id, r.query_id) for r in neardup.near_duplicate_groups(df, "query_id", "query").collect()}
    assert got == {(0, i) for i in range(200)} | {(200, i) for i in range(200, 400)}


def test_crowded_fingerprints_lose_nothing(spark, monkeypatch):
    """With one block per word many words share blocks, and some sets have no more filled blocks than may differ."""
    monkeypatch.setattr(neardup, "BLOCKS_PER_WORD", 1)
    texts = random_texts(4, 90, vocabulary=30)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", F.split("t", " ").alias("m"))
    member, sets = setjoin.classes(df, "id", "m")
    links = [(r.a, r.b) for r in neardup.close_sets(cut(sets), (7, 10)).collect()]
    by = {r.set_id: words(texts[r.id]) for r in member.collect()}
    want = [(a, b) for a, b in itertools.combinations(sorted(by), 2) if alike(by[a], by[b], (7, 10))]
    assert groups_of(sorted(by), links) == groups_of(sorted(by), want)


def dense_family(spark, n):
    """n sets of 30 out of 36 members: almost all pairs meet in almost all blocks, and most are similar."""
    rnd = random.Random(1)
    rows = [(i, i % 2 == 0, f"n{i}", [f"m{x}" for x in sorted(rnd.sample(range(36), 30))]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, in_train boolean, name string, members array<string>")


def test_dense_family_ends(spark):
    rows, df = dense_family(spark, 2000)
    member = np.zeros((2000, 36), np.int64)
    for i, _, _, m in rows:
        member[i, [int(x[1:]) for x in m]] = 1
    common = member @ member.T
    alike_ = common * 17 >= 60 * 7
    begin = time.monotonic()
    assert contamination.contained_records(df, (7, 10)).count() == alike_[1::2, ::2].sum()
    texts = df.select("id", F.concat_ws(" ", "members").alias("t"))
    assert neardup.near_duplicate_groups(texts, "id", "t").count() == 2000
    pairs = overlap.similar_records(df.drop("in_train"), (3, 4), across=False).count()
    assert pairs == (np.triu(common * 7 >= 60 * 3, 1)).sum()
    assert time.monotonic() - begin < 120


def test_gram_guarantee_is_checked():
    assert setjoin.Grams.hold((7, 10)) and setjoin.Grams.hold((4, 5)) and not setjoin.Grams.hold((3, 5)) and not setjoin.Grams.hold((1, 2))


def test_common_counts():
    rnd = np.random.default_rng(0)
    a, b = ([rnd.choice(60, rnd.integers(0, 12), replace=False) for _ in range(n)] for n in (40, 25))
    a.append(np.arange(1000, 1003))
    x, y = (setjoin.Lists(np.concatenate(s), np.array([len(v) for v in s])) for s in (a, b))
    want = np.array([[len(np.intersect1d(u, v)) for v in b] for u in a])
    for dense in (0, 256, 10**9):
        setjoin.DENSE, kept = dense, setjoin.DENSE
        assert (setjoin.common_counts(x, y) == want).all()
        setjoin.DENSE = kept
    assert (setjoin.common_counts(x.heads(np.full(41, 2)), y) == np.array([[len(np.intersect1d(u[:2], v)) for v in b] for u in a])).all()


@pytest.mark.parametrize("chunk", [2, 1024])
def test_copies_are_joined_in_chunks(spark, chunk):
    left = spark.createDataFrame([(1, i) for i in range(7)] + [(2, 10)], "a long, x long")
    right = spark.createDataFrame([(1, i) for i in range(5)] + [(3, 20), (3, 21)], "b long, y long")
    pairs = spark.createDataFrame([(1, 1), (1, 3), (2, 3), (2, 9)], "a long, b long")
    got = sorted((r.a, r.b, r.x, r.y) for r in setjoin.with_copies(pairs, left, right, chunk).collect())
    assert got == sorted([(1, 1, x, y) for x in range(7) for y in range(5)] + [(1, 3, x, y) for x in range(7) for y in (20, 21)] + [(2, 3, 10, y) for y in (20, 21)])


@pytest.mark.parametrize("small", [1, 6])
def test_similar_records(spark, small):
    rnd = random.Random(3)
    sets = [rnd.sample(range(14), rnd.randint(0, 9)) for _ in range(90)] + [None, [], [None], [1, 1, None, 2, 3]]
    rows = [(i, f"n{i % 80}" if i % 17 else None, s) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, name string, members array<int>")
    got = {(r.id_a, r.id_b) for r in overlap.similar_records(df, (3, 4), across=False, small=small).collect()}
    clean = {i: frozenset(x for x in s or [] if x is not None) for i, _, s in rows}
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] != b[1] and alike(clean[a[0]], clean[b[0]], (3, 4))}
    assert got == want
    sided = df.withColumn("side", F.col("id") % 2 == 0)
    got = {(r.id_a, r.id_b) for r in overlap.similar_records(sided, (3, 5), across=True, small=small).collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] != b[1] and (a[0] + b[0]) % 2 and alike(clean[a[0]], clean[b[0]], (3, 5))}
    assert got == want
    assert overlap.similar_records(df.limit(0), (3, 4), across=False).count() == 0


def test_contained_records(spark):
    texts = random_texts(11, 80, vocabulary=30) + ["", None, "one copy of this", "one copy of this", "one copy of this"]
    side = [None if i % 11 == 0 else i % 3 != 0 for i in range(len(texts))]
    df = spark.createDataFrame([(i, s, list(words(t)) if t is not None else None) for i, (t, s) in enumerate(zip(texts, side))], "id long, in_train boolean, members array<string>")
    got = contamination.contained_records(df, (7, 10)).collect()
    ws = [words(t) for t in texts]
    want = {(e, t) for e in range(len(texts)) for t in range(len(texts)) if side[e] is False and side[t] is True and alike(ws[e], ws[t], (7, 10))}
    assert len(got) == len(want) and {(r.eval_id, r.train_id) for r in got} == want
    assert all(abs(r.containment - len(ws[r.eval_id] & ws[r.train_id]) / len(ws[r.eval_id])) < 1e-9 for r in got)
    assert contamination.contained_records(df.limit(0), (7, 10)).count() == 0
