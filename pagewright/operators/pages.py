"""Choice of pages that stand for a document, from its number of pages alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.scalars import hash_number

#: Strategies of evaluation: distinct sorted page numbers. Strategies of composition: a fixed number of tiles.
EVALUATED = ("first4", "first9", "all_pages", "first2_last2", "last4", "uniform4", "random4")
COMPOSED = {"first1": (1, 1), "first4": (2, 2), "first9": (3, 3), "first16": (4, 4), "last4": (2, 2), "first2_last2": (2, 2), "uniform4": (2, 2), "random4": (2, 2)}


def _all(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def chosen_pages(strategy: str, n: Column, doc: Column | None = None) -> Column:
    """Page numbers (from 0, sorted, distinct) for evaluation. No pages give an empty array; an unknown strategy raises."""
    if strategy not in EVALUATED:
        raise ValueError(f"unknown page strategy {strategy}")
    n = n.cast("int")
    if strategy == "all_pages":
        picked = _all(n)
    elif strategy in ("first4", "first9"):
        picked = F.slice(_all(n), 1, int(strategy[5:]))
    else:
        if strategy == "first2_last2":
            four = F.array(F.lit(0), F.lit(1), n - 2, n - 1)
        elif strategy == "last4":
            four = F.array(n - 4, n - 3, n - 2, n - 1)
        elif strategy == "uniform4":
            four = F.array(*[F.round(i * (n - 1) / 3).cast("int") for i in range(4)])
        else:
            # the four page numbers with the least md5 of document and number: the same in each run and engine
            keyed = F.array_sort(F.transform(_all(n), lambda i: F.struct(F.md5(F.concat(doc.cast("string"), F.lit(":"), i.cast("string"))).alias("h"), i.alias("i"))))
            four = F.array_sort(F.transform(F.slice(keyed, 1, 4), lambda s: s.i))
        picked = F.when(n >= 4, four).otherwise(_all(n))
    return F.when(n > 0, picked).otherwise(F.array().cast("array<int>"))


def composed_tiles(strategy: str, n: Column, doc: Column | None = None) -> Column:
    """Page number of each tile in order; null is a blank tile. Needs a document of at least one page.

    random4 takes four pages in md5 order of document and number; with fewer pages each tile takes one by md5, with repeats.
    """
    n = n.cast("int")
    if strategy == "random4":
        tile = lambda i: hash_number(F.concat(doc.cast("string"), F.lit(":"), i.cast("string")), 1 << 30)
        keyed = F.array_sort(F.transform(_all(n), lambda i: F.struct(F.md5(F.concat(doc.cast("string"), F.lit(":"), i.cast("string"))).alias("h"), i.alias("i"))))
        four = F.transform(F.slice(keyed, 1, 4), lambda s: s.i)
        return F.when(n >= 4, four).otherwise(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (tile(i) % n).cast("int")))
    if strategy == "first4":
        return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i < n, i))
    if strategy in ("first1", "first9", "first16"):
        return F.transform(F.sequence(F.lit(0), F.lit(int(strategy[5:]) - 1)), lambda i: i % n)
    if strategy == "uniform4":
        return F.array(*[F.least(F.round(i * (n - 1) / 3).cast("int"), n - 1) for i in range(4)])
    last = {"last4": F.array(n - 4, n - 3, n - 2, n - 1), "first2_last2": F.array(F.lit(0), F.lit(1), n - 2, n - 1)}[strategy]
    short = {1: (0, 0, 0, 0), 2: (0, 1, 1, 0), 3: (0, 1, 2, 2)}
    out = last
    for pages, tiles in short.items():
        out = F.when(n == pages, F.array(*[F.lit(t) for t in tiles])).otherwise(out)
    return out


def tile_place(index: Column, columns: int, width: int = 1275, height: int = 1650) -> tuple[Column, Column, Column, Column]:
    """Row, column and pixel offsets of a tile."""
    row, col = F.floor(index / columns).cast("int"), (index % columns).cast("int")
    return row, col, (col * width).cast("int"), (row * height).cast("int")


def page_counts(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, n_pages) without the documents' own rows."""
    return pages.where(F.col(page) != F.col(doc)).groupBy(doc).agg(F.count_distinct(page).cast("int").alias("n_pages"))


def strategy_table(docs: DataFrame, doc: str, n: str, strategies: tuple[str, ...] = EVALUATED) -> DataFrame:
    """(strategy, doc, page_index) for all strategies in one pass over ``docs``."""
    picked = F.array(*[F.struct(F.lit(s).alias("strategy"), chosen_pages(s, F.col(n), F.col(doc)).alias("pages")) for s in strategies])
    return docs.select(doc, F.explode(picked).alias("x")).select("x.strategy", doc, F.explode("x.pages").alias("page_index"))


def ordered_pages(pages: DataFrame, doc: str, page: str, number: Column, order: str) -> DataFrame:
    """(doc, page, page_index): pages of a document by number, then by ``order``; own rows left out."""
    rows = pages.where(F.col(page) != F.col(doc)).withColumn("number", number)
    place = F.row_number().over(Window.partitionBy(doc).orderBy("number", order)) - 1
    return rows.select(doc, page, place.cast("int").alias("page_index"))
