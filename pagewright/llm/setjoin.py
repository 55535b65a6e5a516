"""Exact joins of similar sets over blocks, with bounded work where a block is hot.

Every set is a list of tokens in one global order, rare before frequent. What tokens are is the caller's affair: the members themselves
(``MEMBERS``), hashes of word n-grams (``Grams``) or blocks of a fingerprint (``neardup``); a ``Rule`` says how many tokens of a set a
similar set may lack. If it may lack e, then (pigeonhole) the first k tokens that both have stand among the first e + k of each: the
k-block of the pair. Blocks with k = 1 are the lists of the sets that have one token among their first ones. A pair is looked at in many
blocks but made in one, that of its first k common tokens.

Blocks are handled by their size. Up to HOT_SETS sets: an ordinary join. Beyond that: the sets are split into parts of at most TILE_SETS
sets (fewer where sets are long), and each two parts are one task-sized tile in which all common members are counted at once by matrix
products; nothing but results leaves a tile. Blocks of more than TILE_SETS sets may instead be split by one more token to blocks with
k + 1, if their pairs and rows, counted beforehand, are then at most half of the tiles' pairs. So the work at least halves from level to
level, levels are few, and no data make the number of rows explode. Both sets of a pair see the same block sizes and take the same way.
No block is dropped, cut or sampled.

Sets with equal members must be one row (see ``classes``): copies multiply nothing. Thresholds are fractions (p, q) of whole numbers;
comparisons are exact. Members are 64-bit hashes, which only stand for each other within a pair; equal sets are found by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagewright.session import cut

#: Blocks of at most so many sets are joined row by row; the result does not depend on it, nor on the two below.
HOT_SETS = 120
#: Sets and members that a part of a tile holds at most. Single sets may be longer.
TILE_SETS, TILE_MEMBERS = 2048, 400_000
#: Sets of a large block to which all its sets are compared first where only links are wanted.
PIVOTS = 4
#: Records of one set that a key of the last join holds at most.
CHUNK_ROWS = 1024
#: What a row of a split block costs in pairs of a tile.
ROW_COST = 100
#: Columns of one matrix product, and how much denser than 1 / DENSE a member must be to be in one.
PRODUCT_COLUMNS, DENSE = 2048, 256
Ratio = tuple[int, int]


def classes(df: DataFrame, key: str, members: str, carry: tuple[str, ...] = (), flags: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Membership (``key``, set_id, ``carry``) and the distinct sets (set_id, toks, n, ``flags``), the latter written. Empty and null sets are in neither.

    ``key`` is a unique integer; ``set_id`` is the smallest one of the set, ``n`` the number of its rows. ``toks`` are hashes of the members.
    A flag of a set is whether any of its rows meets the condition.
    """
    hashed = df.select(F.col(key), *carry, F.array_sort(F.array_distinct(F.transform(F.filter(members, lambda x: x.isNotNull()), lambda x: F.xxhash64(x)))).alias("toks"))
    keyed = hashed.where(F.size("toks") > 0).withColumns({"h1": F.xxhash64("toks"), "h2": F.xxhash64(F.lit("second"), "toks")})
    marks = [F.max(c).alias(name) for name, c in (flags or {}).items()]
    sets = cut(keyed.groupBy("h1", "h2").agg(F.min(F.col(key).cast("bigint")).alias("set_id"), F.first("toks").alias("toks"), F.count("*").alias("n"), *marks))
    member = keyed.select(key, *carry, "h1", "h2").join(sets.select("h1", "h2", "set_id"), ["h1", "h2"]).drop("h1", "h2")
    return member, sets.drop("h1", "h2")


def at_once(*jobs: Callable[[], DataFrame]) -> list[DataFrame]:
    """Results of joins that do not depend on each other, made side by side: their loops wait for jobs of their own."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inherit(job)) for job in jobs]]


def with_copies(pairs: DataFrame, left: DataFrame, right: DataFrame, chunk: int = CHUNK_ROWS) -> DataFrame:
    """``pairs`` (a, b, ...) of sets as pairs of their records: ``left`` (a, ...) and ``right`` (b, ...) are memberships.

    Records of a set with more than ``chunk`` copies are joined chunk by chunk, so no key of a join has more than that on either side.
    """
    salted = []
    for df, s in ((left, "a"), (right, "b")):
        many = df.groupBy(s).agg(F.count("*").alias("m")).where(F.col("m") > chunk).select(s, F.ceil(F.col("m") / chunk).cast("int").alias(f"chunks_{s}"))
        columns = [c for c in df.columns if c != s]
        own = df.join(many, s, "left").withColumn(f"chunk_{s}", F.coalesce(F.pmod(F.xxhash64(*columns), F.col(f"chunks_{s}")).cast("int"), F.lit(0)))
        salted.append(own.select(s, f"chunk_{s}", *columns))
        numbers = F.sequence(F.lit(0), F.coalesce(F.col(f"chunks_{s}"), F.lit(1)) - 1)
        pairs = pairs.join(many, s, "left").withColumn(f"chunk_{s}", F.explode(numbers)).drop(f"chunks_{s}")
    return pairs.join(salted[0], ["a", "chunk_a"]).join(salted[1], ["b", "chunk_b"]).drop("chunk_a", "chunk_b")


def need(a: Column, b: Column, ratio: Ratio) -> Column:
    """Common members that sets of these sizes must have."""
    p, q = ratio
    return F.ceil(p * (a + b) / F.lit(p + q)).cast("int")


def _least_partner(size: Column, ratio: Ratio) -> Column:
    return F.ceil(size * ratio[0] / F.lit(ratio[1])).cast("int")


@dataclass(frozen=True)
class Rule:
    """Tokens are the members themselves."""

    ratio: Ratio

    def lacking(self, size: Column, tokens: Column, low: Column, high: Column) -> Column:
        """How many of a set's ``tokens`` a similar set of ``low`` to ``high`` members may lack."""
        return tokens - need(size, F.greatest(low, _least_partner(size, self.ratio)), self.ratio)

    def home(self) -> Column:
        """Whether a row stands where it meets sets that are not smaller. Each pair has such a row."""
        return F.lit(True)

    def pair(self) -> Column:
        """A further condition on a pair of rows a and b."""
        return F.lit(True)

    def matrix(self, a: Part, b: Part, tokens: np.ndarray) -> np.ndarray | bool:
        """The same for all pairs of two parts, from the numbers of their common tokens."""
        return True


@dataclass(frozen=True)
class Grams(Rule):
    """Tokens are hashes of two neighbouring members in one order of all members.

    Sets with c common members and d others have at most d + 1 runs of common members, so at least c - d - 1 common grams.
    """

    def lacking(self, size: Column, tokens: Column, low: Column, high: Column) -> Column:
        p, q = self.ratio
        shared = F.ceil((size + F.greatest(low, _least_partner(size, self.ratio))) * (2 * p - q) / F.lit(p + q) - 1).cast("int")
        return tokens - F.greatest(shared, F.lit(1))

    @staticmethod
    def hold(ratio: Ratio) -> bool:
        """Whether all different sets that are similar have a common gram. Beyond 3 (p + q) members the bound above sees to it."""
        p, q = ratio
        some = range(1, 3 * (p + q) + 1)
        return 2 * p > q and all(3 * math.ceil(p * (a + b) / (p + q)) - a - b > 1 for a in some for b in some if a <= b and a * q >= b * p and (a < b or a > 1))


def ordered(rows: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """``sets`` with ``toks``, the ``tok`` of ``rows`` in the global order: by frequency where a token is in more than HOT_SETS sets, and by hash."""
    often = rows.groupBy("tok").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SETS)
    ranked = rows.join(often, "tok", "left").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tok"))).alias("o"))
    return ranked.select(*by, F.col("o.tok").alias("toks")).join(sets, by[0])


def similar_sets(
    sets: DataFrame,
    ratio: Ratio,
    sides: tuple[str, str] | None = None,
    links: bool = False,
    larger_than: int = 0,
    rule: Rule | None = None,
    tokens: DataFrame | None = None,
    hot: int = HOT_SETS,
    tile: int = TILE_SETS,
) -> DataFrame:
    """(a, b, common, size_a, size_b): the pairs of distinct sets (set_id, toks) whose overlap is at least ``ratio``.

    ``sides``: two boolean columns of ``sets``; only pairs with one set of each side are made (a set may be of both). Otherwise all pairs, once.
    ``links``: only as many pairs as connect the same sets. ``larger_than``: one set of a pair must have more members.
    ``tokens``: (set_id, tok) that ``rule`` speaks of, instead of the members; it may have a column ``cls``, then a set stands in several
    classes and pairs are made within the class of the smaller set. Sets that may lack all their tokens are also joined among themselves over
    their members: of a pair that shares no token both are such. Empty input gives no rows.
    """
    rule = rule or Rule(ratio)
    carry = list(sides or ())
    own = sets.select("set_id", F.col("toks").alias("members"), F.size("toks").alias("size"), *carry)
    if tokens is None:
        base = ordered(sets.select("set_id", F.explode("toks").alias("tok")), own.drop("members"), ["set_id"]).withColumn("cls", F.lit(0))
    else:
        base = ordered(tokens, own, ["set_id", *[c for c in tokens.columns if c == "cls"]])
        base = base if "cls" in base.columns else base.withColumn("cls", F.lit(0))
    most = F.floor(F.col("size") * ratio[1] / F.lit(ratio[0])).cast("int")
    loose, seen = F.size("toks") <= rule.lacking(F.col("size"), F.size("toks"), F.lit(1), most), Observation()
    base = cut(base.withColumn("n_toks", F.size("toks")).observe(seen, F.count_if(loose).alias("loose")))
    found = _Join(base, ratio, rule, sides, links, larger_than, hot, tile).pairs()
    if tokens is None or not seen.get["loose"]:
        return found
    some = sets.join(base.where(loose).select("set_id").distinct(), "set_id", "left_semi")
    more = similar_sets(some, ratio, sides, links, larger_than, hot=hot, tile=tile)
    return found.unionByName(more).dropDuplicates(["a", "b"])


@dataclass
class _Join:
    base: DataFrame
    ratio: Ratio
    rule: Rule
    sides: tuple[str, str] | None
    links: bool
    larger_than: int
    hot: int
    tile: int

    def pairs(self) -> DataFrame:
        p, q = self.ratio
        size, n_toks = F.col("size"), F.col("n_toks")
        kept = self._slim()
        reach = self.rule.lacking(size, n_toks, F.lit(1), F.floor(size * q / F.lit(p)).cast("int"))
        first = F.explode(F.transform(F.slice("toks", 1, F.greatest(reach, F.lit(0)) + 1), lambda t, i: F.struct(F.xxhash64("cls", t).alias("block"), i.cast("int").alias("last"))))
        level, k, found = self.base.select(*kept, first.alias("x")).select("x.block", "x.last", *kept), 1, []
        while True:
            ways = [F.max(self.rule.home()).alias("home"), *[F.max(s).alias(s) for s in self.sides or ()]]
            count = level.groupBy("block").agg(F.count("*").alias("n"), F.sum("size").alias("mass"), F.min("size").alias("low"), F.max("size").alias("high"), *ways).where("n > 1 and home")
            for s in self.sides or ():  # a block that one side never has makes no pair
                count = count.where(s)
            most = F.least("high", F.floor(size * q / F.lit(p)).cast("int"))
            lacking = self.rule.lacking(size, n_toks, F.col("low"), most)
            marked = level.join(count.select("block", "n", "mass", "low", "high"), "block").withColumn("lacks", lacking)
            seen = Observation()
            marked = cut(marked.where(F.col("last") + 1 - k <= F.col("lacks")).drop("low", "high").observe(seen, F.max("n").alias("top")))
            found.append(self._joined(marked.where(F.col("n") <= self.hot), k))
            top = seen.get["top"] or 0
            if top <= self.hot:
                break
            level, tiled = self._split(marked, k) if top > self.tile else (None, marked.where(F.col("n") > self.hot).withColumn("exact", F.lit(False)))
            found.append(self._tiled(tiled, k))
            if level is None:
                break
            k += 1
        return reduce(DataFrame.unionByName, found)

    def _slim(self) -> list[str]:
        """Columns that go through the blocks; the lists are joined to what is left."""
        return [c for c in self.base.columns if c not in ("toks", "members")]

    def _full(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.base.select("set_id", "cls", *[c for c in ("toks", "members") if c in self.base.columns]), ["set_id", "cls"])

    @property
    def _members(self) -> str:
        return "members" if "members" in self.base.columns else "toks"

    def _ahead(self, rows: DataFrame, k: int) -> tuple[DataFrame, Column]:
        """Rows with a later token, and the struct (block, last) of each of them, for blocks with k + 1."""
        end = F.least(F.col("n_toks"), F.col("lacks") + k + 1) - 1
        step = F.transform(F.sequence(F.col("last") + 1, end), lambda j: F.struct(F.xxhash64("block", F.get("toks", j)).alias("block"), j.cast("int").alias("last")))
        return self._full(rows.where(F.col("last") + 1 <= end)), F.explode(step)

    def _split(self, marked: DataFrame, k: int) -> tuple[DataFrame | None, DataFrame]:
        """Rows of the next level from blocks that are better split, if any; and the rows for tiles.

        Sets that may have no more than k tokens in common with a similar one cannot rely on a block with k + 1. In a split block those are
        tiled among themselves, for pairs with just k common tokens (``exact``); all other pairs have more and meet later.
        """
        large, unsafe = marked.where(F.col("n") > self.tile), F.col("n_toks") - F.col("lacks") <= k
        rows, step = self._ahead(large, k)
        inner = rows.select(F.col("block").alias("outer"), step.alias("x")).groupBy("outer", "x.block").agg(F.count("*").alias("m"))
        after = inner.groupBy("outer").agg(F.sum(F.col("m").cast("double") * (F.col("m") - 1) / 2 + ROW_COST * F.col("m")).alias("cost"))
        short = large.groupBy("block").agg(F.max("n").cast("double").alias("n"), F.count_if(unsafe).cast("double").alias("u"))
        now = short.join(after, short["block"] == after["outer"], "left").select("block", (2 * (F.coalesce("cost", F.lit(0.0)) + F.col("u") * F.col("u") / 2) <= F.col("n") * F.col("n") / 2).alias("splits"))
        judged = cut(marked.where(F.col("n") > self.hot).join(now, "block", "left").withColumn("splits", F.coalesce("splits", F.lit(False))))
        tiled = judged.where(~F.col("splits") | unsafe).withColumn("exact", F.col("splits")).drop("splits")
        split = judged.where("splits")
        if split.isEmpty():
            return None, tiled
        rows, step = self._ahead(split, k)
        kept = self._slim()
        return rows.select(*kept, step.alias("x")).select("x.block", "x.last", *kept), tiled

    def _joined(self, cold: DataFrame, k: int) -> DataFrame:
        p, q = self.ratio
        wanted = need(F.col("a.size"), F.col("b.size"), self.ratio)
        shorter = (F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.set_id") < F.col("b.set_id")))
        on = (F.col("a.block") == F.col("b.block")) & shorter & (F.col("a.size") * q >= F.col("b.size") * p) & (F.col("b.size") > self.larger_than)
        if self.sides:
            left, right = self.sides
            on = on & ((F.col(f"a.{left}") & F.col(f"b.{right}")) | (F.col(f"a.{right}") & F.col(f"b.{left}")))
        met = self._full(cold).alias("a").join(self._full(cold).alias("b"), on & self.rule.pair())
        earlier = F.array_intersect(*[F.slice(f"{s}.toks", F.lit(1), F.col(f"{s}.last")) for s in "ab"])
        both = F.array_intersect(f"a.{self._members}", f"b.{self._members}")
        kept = met.where(F.size(earlier) == k - 1).withColumn("common", F.size(both)).where(F.col("common") >= wanted)
        return kept.select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b"), "common", F.col("a.size").alias("size_a"), F.col("b.size").alias("size_b"))

    def _tiled(self, rows: DataFrame, k: int) -> DataFrame:
        rows = self._full(rows)
        rows = rows if "members" in rows.columns else rows.withColumn("members", F.col("toks"))
        if not self.links:
            return self._in_tiles(rows.withColumns({"near": F.lit(False), "n_near": F.lit(0).cast("bigint"), "n_far": F.col("n")}), k)
        small, large = rows.where(F.col("n") <= self.tile), rows.where(F.col("n") > self.tile)
        whole = self._in_tiles(small.withColumns({"near": F.lit(False), "n_near": F.lit(0).cast("bigint"), "n_far": F.col("n")}), k)
        if large.isEmpty():
            return whole
        links, placed = self._stars(large)
        return whole.unionByName(links).unionByName(self._in_tiles(placed, k))

    def _stars(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links of a block's sets to a few of them, its pivots; and ``rows`` with ``near``: linked to the pivot with most links.

        Sets that are near hang together already and need no tile among themselves, so a family of similar sets, however large, costs a pass.
        """
        p, q = self.ratio
        chance = F.xxhash64("set_id", F.lit("pivot"))
        pivots = rows.groupBy("block", F.pmod(chance, F.lit(PIVOTS)).alias("slot")).agg(F.min_by(F.struct("set_id", "members", "size"), chance).alias("pivot")).select("block", "pivot")
        met = rows.join(pivots, "block").where(F.col("pivot.set_id") != F.col("set_id"))
        common = F.size(F.array_intersect("members", "pivot.members"))
        close = met.withColumn("common", common).where((F.col("common") * (p + q) >= (F.col("size") + F.col("pivot.size")) * p) & (F.greatest("size", "pivot.size") > self.larger_than))
        links = cut(close.select("block", F.col("pivot.set_id").alias("a"), F.col("set_id").alias("b"), "common", F.col("pivot.size").alias("size_a"), "size"))
        best = links.groupBy("block", "a").agg(F.count("*").alias("m")).groupBy("block").agg(F.max_by("a", "m").alias("a"))
        near = links.join(best, ["block", "a"], "left_semi").select("block", F.col("b").alias("set_id")).unionByName(best.select("block", F.col("a").alias("set_id"))).distinct().withColumn("near", F.lit(True))
        flagged = cut(rows.join(near, ["block", "set_id"], "left").withColumn("near", F.coalesce("near", F.lit(False))))
        parts = flagged.groupBy("block").agg(F.count_if("near").alias("n_near"), F.count_if(~F.col("near")).alias("n_far"))
        return links.select("a", "b", "common", "size_a", F.col("size").alias("size_b")), flagged.join(parts, "block")

    def _in_tiles(self, rows: DataFrame, k: int) -> DataFrame:
        """Results of blocks whose sets are split into parts: each far part with each part, but no near part with a near one."""
        mean = F.greatest(F.lit(1.0), F.col("mass") / F.col("n") * self.tile / TILE_MEMBERS)  # more and smaller parts where sets are long
        near, far = (F.ceil(F.col(c) * mean / self.tile).cast("int") for c in ("n_near", "n_far"))
        spread = F.xxhash64("set_id", F.lit("part"))
        part = F.when(F.col("near"), F.pmod(spread, near)).otherwise(near + F.pmod(spread, far)).cast("int")
        begin = F.when(F.col("near"), near).otherwise(F.lit(0))
        others = F.when(far > 0, F.sequence(begin, F.greatest(near + far - 1, begin)))
        placed = rows.withColumn("part", part).withColumn("tiles", others)
        tiles = F.explode(F.transform("tiles", lambda x: F.struct(F.least("part", x).alias("i"), F.greatest("part", x).alias("j"))))
        kept = ["block", "exact", "part", "set_id", "cls", "last", "size", "toks", "members", *(self.sides or ())]
        each = placed.select(*kept, tiles.alias("t")).select(*kept, "t.i", "t.j")
        rule, ratio, sides, links, larger = self.rule, self.ratio, self.sides, self.links, self.larger_than

        def run(t: pa.Table) -> pa.Table:
            return tile_pairs(t, k, rule, ratio, sides, links, larger)

        return each.groupBy("block", "exact", "i", "j").applyInArrow(run, "a bigint, b bigint, common int, size_a int, size_b int")


class Lists:
    """A list column as flat values and lengths."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.sizes = values, sizes

    @classmethod
    def of(cls, column: pa.ChunkedArray) -> Lists:
        a = column.combine_chunks()
        a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
        return cls(a.flatten().to_numpy(zero_copy_only=False), np.diff(a.offsets.to_numpy()))

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def take(self, which: np.ndarray) -> Lists:
        return Lists(self.values[np.repeat(which, self.sizes)], self.sizes[which])

    def heads(self, n: np.ndarray) -> Lists:
        """The first n values of each list."""
        at = np.arange(len(self.values)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        return Lists(self.values[at < np.repeat(n, self.sizes)], np.minimum(n, self.sizes))


def common_counts(a: Lists, b: Lists) -> np.ndarray:
    """How many values each list of ``a`` has in common with each of ``b``. Values are distinct within a list.

    Values that many lists have are columns of matrix products; for the rest the few pairs of lists that have them are counted one by one.
    """
    na, nb = len(a.sizes), len(b.sizes)
    out = np.zeros((na, nb), np.float32)
    _, number = np.unique(np.concatenate([a.values, b.values]), return_inverse=True)
    if not len(number):
        return out
    n = int(number.max()) + 1
    va, vb, ra, rb = number[: len(a.values)], number[len(a.values) :], a.rows, b.rows
    ca, cb = np.bincount(va, minlength=n), np.bincount(vb, minlength=n)
    work = ca.astype(np.int64) * cb
    dense = np.nonzero(work * DENSE > na * nb)[0]
    column = np.full(n, -1)
    for begin in range(0, len(dense), PRODUCT_COLUMNS):
        some = dense[begin : begin + PRODUCT_COLUMNS]
        column[:] = -1
        column[some] = np.arange(len(some))
        x, y = np.zeros((na, len(some)), np.float32), np.zeros((nb, len(some)), np.float32)
        ma, mb = column[va] >= 0, column[vb] >= 0
        x[ra[ma], column[va[ma]]] = 1
        y[rb[mb], column[vb[mb]]] = 1
        out += x @ y.T
    sparse = work > 0
    sparse[dense] = False
    if sparse.any():
        ma, mb = sparse[va], sparse[vb]
        va, ra, vb, rb = va[ma], ra[ma], vb[mb], rb[mb]
        order = np.argsort(vb, kind="stable")
        vb, rb = vb[order], rb[order]
        low, high = np.searchsorted(vb, va, "left"), np.searchsorted(vb, va, "right")
        times = high - low
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        out += np.bincount(np.repeat(ra, times) * nb + rb[at], minlength=na * nb).reshape(na, nb)
    return out


@dataclass
class Part:
    ids: np.ndarray
    cls: np.ndarray
    last: np.ndarray
    size: np.ndarray
    toks: Lists
    members: Lists
    sides: list[np.ndarray]

    def take(self, which: np.ndarray) -> Part:
        return Part(self.ids[which], self.cls[which], self.last[which], self.size[which], self.toks.take(which), self.members.take(which), [s[which] for s in self.sides])


def tile_pairs(t: pa.Table, k: int, rule: Rule, ratio: Ratio, sides: tuple[str, str] | None, links: bool, larger_than: int) -> pa.Table:
    """The similar pairs of one tile: of the sets of part i with those of part j of one block."""
    i, j, exact = t["i"][0].as_py(), t["j"][0].as_py(), t["exact"][0].as_py()
    part = t["part"].to_numpy()
    ints = [t[c].to_numpy() for c in ("set_id", "cls", "last", "size")]
    whole = Part(*ints, Lists.of(t["toks"]), Lists.of(t["members"]), [t[s].to_numpy() for s in sides or ()])
    a, b = (whole.take(part == x) for x in (i, j)) if i != j else (whole, whole)
    p, q = ratio
    size_a, size_b = a.size.astype(np.int32)[:, None], b.size.astype(np.int32)[None, :]
    common = common_counts(a.members, b.members).astype(np.int32)
    good = (common * (p + q) >= (size_a + size_b) * p) & (np.maximum(size_a, size_b) > larger_than)
    if i == j:
        good &= a.ids[:, None] < b.ids[None, :]
    if sides:
        good &= (a.sides[0][:, None] & b.sides[1][None, :]) | (a.sides[1][:, None] & b.sides[0][None, :])
    if good.any():
        good &= common_counts(a.toks.heads(a.last), b.toks.heads(b.last)) == k - 1
    if good.any() and (exact or type(rule).matrix is not Rule.matrix):
        tokens = common_counts(a.toks, b.toks)
        good &= rule.matrix(a, b, tokens)
        if exact:
            good &= tokens == k
    x, y = _spanning(good, i == j) if links else np.nonzero(good)
    return pa.table(
        {"a": a.ids[x], "b": b.ids[y], "common": common[x, y].astype(np.int32), "size_a": a.size[x].astype(np.int32), "size_b": b.size[y].astype(np.int32)},
        schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int32()), ("size_a", pa.int32()), ("size_b", pa.int32())]),
    )


def _spanning(good: np.ndarray, one_side: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``good`` that connect the same rows and columns, in at most rows x log(rows) pairs: each row takes a pair out of its group, round by round."""
    rows, columns = good.shape
    offset = 0 if one_side else rows
    group = np.arange(rows if one_side else rows + columns)
    xs, ys = [], []
    left = good
    while left.any():
        x = np.nonzero(left.any(axis=1))[0]
        y = left[x].argmax(axis=1)
        xs.append(x)
        ys.append(y)
        while True:  # the smallest group number spreads over the new pairs and along group numbers
            low = np.minimum(group[x], group[y + offset])
            fresh = group.copy()
            np.minimum.at(fresh, group[x], low)
            np.minimum.at(fresh, group[y + offset], low)
            fresh = fresh[fresh]
            if (fresh == group).all():
                break
            group = fresh
        left = left & (group[:rows, None] != group[offset : offset + columns][None, :])
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.empty(0, np.int64), np.empty(0, np.int64))
