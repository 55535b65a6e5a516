"""Groups of near-duplicate records: fingerprints split into pigeonhole blocks, joined on blocks, verified by Hamming distance.

A record's fingerprint has a fixed number of blocks, BLOCKS_PER_WORD for each word that sets of its size class may have. Each word belongs
to the block that its hash names, and a block's value is the exclusive or of its words' hashes (no word: an empty block). The Hamming
distance of two fingerprints is the number of blocks in which they differ. Each word that only one of two sets has changes one block, so
if sets of a and b words overlap by at least p/q, the distance is at most (a + b) (q - p) / (p + q) =: d. Hence (pigeonhole) two such
fingerprints agree in one of the first d + 1 filled blocks of each, in any common order of blocks and values: here rare ones first, so that
common words, which fill many blocks alike, cost nothing (``setjoin``). Pairs that meet in a block are verified by the Hamming distance of
their fingerprints and then, exactly, by the overlap of their words.

Sets whose size falls into different classes meet in the class of the smaller; a set therefore stands in up to two classes. Sets of which
so many words share blocks that no more than d are filled could lose a pair. They are few, and compared among themselves over their words
instead of blocks, so nothing is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.llm import graph, setjoin

BLOCKS_PER_WORD = 64
#: Bits of a block's value; the bits above hold the block's number.
VALUE_BITS = 40


def size_class(size: Column) -> Column:
    """The class of a set: its size has so many binary digits after the first."""
    return F.length(F.bin(size)) - 1


def fingerprints(sets: DataFrame, ratio: setjoin.Ratio) -> DataFrame:
    """(set_id, cls, tok): the filled blocks of each set (set_id, toks) in its own class and in that of its smallest partner; ``tok`` is a block's number and value."""
    size = F.size("toks")
    partner = F.ceil(size * ratio[0] / F.lit(ratio[1]))
    each = sets.select("set_id", "toks", F.explode(F.array_distinct(F.array(size_class(size), size_class(partner)))).alias("cls")).select("set_id", "cls", F.explode("toks").alias("word"))
    block = F.pmod(F.xxhash64("word", F.lit("block")), F.lit(BLOCKS_PER_WORD) * F.pow(F.lit(2), F.col("cls")).cast("bigint"))
    filled = each.groupBy("set_id", "cls", block.alias("block")).agg(F.bit_xor("word").alias("value"))
    return filled.select("set_id", "cls", F.shiftleft(F.col("block"), VALUE_BITS).bitwiseOR(F.col("value").bitwiseAND(F.lit((1 << VALUE_BITS) - 1))).alias("tok"))


@dataclass(frozen=True)
class Fingerprint(setjoin.Rule):
    """Tokens are filled blocks; pairs are made in the class of the smaller set and must be close enough in Hamming distance."""

    def lacking(self, size: Column, tokens: Column, low: Column, high: Column) -> Column:
        p, q = self.ratio
        return F.least(tokens, F.floor((size + high) * (q - p) / F.lit(p + q)).cast("int"))

    def home(self) -> Column:
        return F.col("cls") == size_class(F.col("size"))

    def pair(self) -> Column:
        p, q = self.ratio
        numbers = [F.transform(f"{s}.toks", lambda t: F.shiftright(t, VALUE_BITS)) for s in "ab"]
        distance = F.size("a.toks") + F.size("b.toks") - F.size(F.array_intersect(*numbers)) - F.size(F.array_intersect("a.toks", "b.toks"))
        return (F.col("a.cls") == size_class(F.least("a.size", "b.size"))) & (distance * (p + q) <= (F.col("a.size") + F.col("b.size")) * (q - p))

    def matrix(self, a: setjoin.Part, b: setjoin.Part, tokens: np.ndarray) -> np.ndarray:
        p, q = self.ratio
        numbers = [setjoin.Lists(x.toks.values >> VALUE_BITS, x.toks.sizes) for x in (a, b)]
        distance = a.toks.sizes[:, None] + b.toks.sizes[None, :] - setjoin.common_counts(*numbers) - tokens
        size_a, size_b = a.size.astype(np.int32)[:, None], b.size.astype(np.int32)[None, :]
        own = [np.frexp(x.size)[1] - 1 for x in (a, b)]  # binary digits after the first
        return (distance * (p + q) <= (size_a + size_b) * (q - p)) & (a.cls[:, None] == np.minimum(own[0][:, None], own[1][None, :]))


def close_sets(sets: DataFrame, ratio: setjoin.Ratio, **kw) -> DataFrame:
    """(a, b, common, size_a, size_b): links between the sets (set_id, toks) that overlap by at least ``ratio``, enough of them to connect all that are."""
    return setjoin.similar_sets(sets, ratio, links=True, rule=Fingerprint(ratio), tokens=fingerprints(sets, ratio), **kw)


def near_duplicate_groups(df: DataFrame, key: str, text: str, ratio: setjoin.Ratio = (7, 10)) -> DataFrame:
    """(group_id, key): records connected through pairs whose word sets overlap by at least ``ratio``; group_id is the smallest key.

    One row for each record of a group of two or more. Exact copies are one fingerprint, whatever their number. Records without words
    (null, empty, blank, marks only) are in no group. ``key`` must be unique and an integer. Other columns are not read.
    """
    rows = df.select(F.col(key).alias("id"), tx.word_set(F.col(text)).alias("members"))
    member, sets = setjoin.classes(rows, "id", "members")
    close = close_sets(sets, ratio)
    # a set is an entity that ties its own records; a link makes the first record of one set a record of the other
    ties = member.select(F.col("id").alias("record"), F.col("set_id").alias("entity")).unionByName(close.select(F.col("a").alias("record"), F.col("b").alias("entity")))
    groups = graph.min_labels(ties)
    return groups.select(F.col("label").alias("group_id"), F.col("record").alias(key))
