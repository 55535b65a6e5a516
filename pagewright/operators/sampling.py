"""Samples, shuffles, splits and batches that every run and engine repeats: order is the md5 of a seed and a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import cut


def shuffle_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def global_rank(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: the place from 0 by ``order``, over the table or within ``by``.

    Range-partitioned sort, then each partition's rows are counted on from those before it: no window over the whole table and none
    over a whole group, however large. Per-partition counts are all that is added up (one row per partition and group at its border).
    """
    by = by or []
    keys = [F.col(b) for b in by]
    placed = df.withColumns({f"__o{i}": c for i, c in enumerate(order)})
    names = [f"__o{i}" for i in range(len(order))]
    done = cut(placed.repartitionByRange(*by, *names).sortWithinPartitions(*by, *names).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    part = done.groupBy("__part").agg(F.min("__at").alias("__low"), F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    before = part.select("__part", "__low", F.coalesce(earlier, F.lit(0)).alias("__before"))
    over_all = done.join(F.broadcast(before), "__part").withColumn(name, F.col("__at") - F.col("__low") + F.col("__before"))  # a row per partition
    if by:
        first = over_all.groupBy(*keys).agg(F.min(name).alias("__first"))
        match = None
        for b in by:
            c = F.col(f"a.{b}").eqNullSafe(F.col(f"f.{b}"))
            match = c if match is None else match & c
        over_all = over_all.alias("a").join(first.alias("f"), match).select(*[F.col(f"a.{c}") for c in [*df.columns]], (F.col(f"a.{name}") - F.col("f.__first")).alias(name))
    return over_all.select(*df.columns, name)


def train_eval(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """``df`` with ``part``: the last int(n * ratio) of the shuffled rows are eval, the others train."""
    n = df.count()
    ranked = global_rank(df, [shuffle_key(F.col(key), seed), F.col(key)])
    return ranked.withColumn("part", F.when(F.col("rank") >= n - int(n * ratio), "eval").otherwise("train")).drop("rank")


def nested_pools(df: DataFrame, key: str, ratios: list[float], seed: int = 42) -> DataFrame:
    """(ratio, row): one shuffle; each pool is a prefix of it of max(1, int(n * ratio)) rows, so smaller pools lie in larger ones."""
    n = df.count()
    sizes = F.array(*[F.struct(F.lit(float(r)).alias("ratio"), F.lit(n if r >= 1 else max(1, int(n * r))).alias("size")) for r in ratios])
    ranked = global_rank(df, [shuffle_key(F.col(key), seed), F.col(key)])
    return ranked.select("*", F.explode(sizes).alias("x")).where(F.col("rank") < F.col("x.size")).select("x.ratio", *df.columns)


def sized_pool(df: DataFrame, key: str, positive: str, size: int, seed: int = 42) -> DataFrame:
    """All rows with ``positive`` and as many others by shuffle as reach min(max(size, positives), all)."""
    counts = df.agg(F.count("*").alias("n"), F.count_if(positive).alias("p")).first()
    rest = min(max(size, counts["p"]), counts["n"]) - counts["p"]
    others = df.where(~F.col(positive)).orderBy(shuffle_key(F.col(key), seed), key).limit(rest)
    return df.where(positive).unionByName(others)


def some_of_each(df: DataFrame, list_column: str, key: str, limit: int, strategy: str = "random", seed: int = 42) -> Column:
    """At most ``limit`` elements of a list: its first ones, or those with the least md5, kept in their order."""
    arr = F.col(list_column)
    if strategy == "all":
        return F.slice(arr, 1, limit)
    if strategy != "random":
        raise ValueError(f"unknown strategy {strategy}")
    keyed = F.transform(arr, lambda x, i: F.struct(shuffle_key(F.concat(F.col(key).cast("string"), F.lit(":"), i.cast("string")), seed).alias("h"), i.alias("i"), x.alias("x")))
    few = F.array_sort(F.transform(F.slice(F.array_sort(keyed), 1, limit), lambda s: F.struct(s.i.alias("i"), s.x.alias("x"))))
    return F.when(F.size(arr) <= limit, arr).otherwise(F.transform(few, lambda s: s.x))


def single_source_batches(df: DataFrame, source: str, key: str, size: int, seed: int, epoch: int = 0) -> DataFrame:
    """(batch_order, source, key, slot): full batches of one source each, in an order that mixes the sources; rests are left out."""
    ranked = global_rank(df.select(source, key), [shuffle_key(F.col(key), seed + epoch), F.col(key)], by=[source])
    n = df.groupBy(source).agg(F.count("*").alias("n"))
    full = ranked.join(n, source).where(F.col("rank") < F.floor(F.col("n") / size) * size).withColumn("batch", F.floor(F.col("rank") / size))
    batches = global_rank(full.select(source, "batch").distinct(), [shuffle_key(F.concat(F.col(source).cast("string"), F.lit("/"), F.col("batch").cast("string")), seed + epoch), F.col(source), F.col("batch")], name="batch_order")
    return full.join(batches, [source, "batch"]).select("batch_order", source, key, (F.col("rank") % size).cast("int").alias("slot"))


def whole_batches(df: DataFrame, source: str, order: str, size: int) -> DataFrame:
    """The first floor(n / size) * size rows of each source."""
    n = df.groupBy(source).agg(F.count("*").alias("__n"))
    return global_rank(df, [F.col(order)], by=[source]).join(n, source).where(F.col("rank") < F.floor(F.col("__n") / size) * size).drop("rank", "__n")


def holdout(df: DataFrame, order: str, n_eval: int) -> DataFrame:
    """``df`` with ``part``: the first ``n_eval`` rows by ``order`` are eval."""
    return global_rank(df, [F.col(order)]).withColumn("part", F.when(F.col("rank") < n_eval, "eval").otherwise("train")).drop("rank")


def few_rows(df: DataFrame, key: str, limit: int, seed: int) -> DataFrame:
    """``limit`` rows by shuffle; all if there are fewer."""
    return df.orderBy(shuffle_key(F.col(key), seed), key).limit(limit)


def slices(df: DataFrame, order: str, workers: int) -> DataFrame:
    """``df`` with ``worker``: contiguous slices of ceil(n / workers) rows."""
    n = df.count()
    each = max(1, -(-n // workers))
    return global_rank(df, [F.col(order)]).withColumn("worker", F.floor(F.col("rank") / each).cast("int")).drop("rank")
