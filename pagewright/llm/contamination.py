"""Records of evaluation splits that return in the training split.

A record's words are put in one order that all records share (that of their hashes, since the order of words is free here), and its
n-grams are the hashes of two neighbours in it. Sets with c common words and d others have at most d + 1 runs of common words, hence at
least c - d - 1 common n-grams; where that is at least one for every pair wanted (``setjoin.Grams.hold``), n-grams lose nothing, and
otherwise single words stand in. The n-gram hashes of the evaluation records are partitioned and the training records' are scanned for
hits, each record with as few of its rarest n-grams as the wanted overlap allows; hashes that one side never has are dropped at once. For
each hit the containment of the evaluation record in the training record and the overlap are computed on the whole sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import setjoin


def word_grams(sets: DataFrame) -> DataFrame:
    """(set_id, tok): hashes of neighbours in ``toks``, which are in one order for all sets. Sets of one member have none."""
    grams = F.transform(F.sequence(F.lit(1), F.size("toks") - 1), lambda i: F.xxhash64(F.get("toks", i - 1), F.get("toks", i)))
    return sets.where(F.size("toks") > 1).select("set_id", F.explode(grams).alias("tok"))


def contained_records(records: DataFrame, ratio: setjoin.Ratio, **kw) -> DataFrame:
    """(eval_id, train_id, overlap, containment): pairs of an evaluation and a training record whose sets overlap by at least ``ratio``.

    ``records``: id (unique integer), in_train (boolean; null rows are left out), members. containment is the share of the evaluation
    record's members that the training record has. Null and empty sets are in no pair; copies of a record each give their pairs.
    """
    flags = {"has_train": F.col("in_train"), "has_eval": ~F.col("in_train")}
    member, sets = setjoin.classes(records.where(F.col("in_train").isNotNull()), "id", "members", ("in_train",), flags)
    grams = setjoin.Grams.hold(ratio)
    how = {"rule": setjoin.Grams(ratio), "tokens": word_grams(sets)} if grams else {}
    close = setjoin.similar_sets(sets, ratio, ("has_train", "has_eval"), **how, **kw)
    union = F.col("size_a") + F.col("size_b") - F.col("common")
    ways = [("a", "b", F.col("size_a")), ("b", "a", F.col("size_b"))]
    hits = [close.select(F.col(e).alias("a"), F.col(t).alias("b"), (F.col("common") / union).alias("overlap"), (F.col("common") / n).alias("containment")) for e, t, n in ways]
    same = sets.where("has_train and has_eval").select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.lit(1.0).alias("overlap"), F.lit(1.0).alias("containment"))
    evals = member.where(~F.col("in_train")).select(F.col("set_id").alias("a"), F.col("id").alias("eval_id"))
    trains = member.where("in_train").select(F.col("set_id").alias("b"), F.col("id").alias("train_id"))
    found = setjoin.with_copies(hits[0].unionByName(hits[1]).unionByName(same), evals, trains)
    return found.select("eval_id", "train_id", "overlap", "containment")
