"""Evaluation passages inside a corpus, found with suffix arrays of the corpus' shards.

Each Arrow batch of documents is a shard. Its words become numbers (0: a word that no item has), its suffixes are sorted and every
suffix of every item is looked up in that order by binary search, which gives all verbatim matches and where they stand. Suffixes that
cannot reach the wanted run are left out before sorting: those with a foreign word in the next ``run`` words, and those whose first
words are the first words of no item suffix. What is left is extended to the longest verbatim match.

Up to ``block_words`` words of items (a bound of some 50 MB) are sent to the workers, which build the sorted side once each; there is no
shuffle but that of the result. Beyond that nothing is sent but a filter of at most FILTER_BITS bits: the corpus is scanned once, the
suffixes whose first ``run`` words may begin an item suffix go, as 128-bit keys, to where the item suffixes with that key are, sorted on
both sides, and runs of matches on one diagonal make the longest ones. Neither the driver nor a worker holds more for more items.

Null, empty and short texts and items match nothing. Repeated documents and items each give their own rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import text as tx
from pagewright.session import cut

RUN_WORDS = 12
SEED_WORDS = 4
WINDOW_WORDS = 10_000
BLOCK_WORDS = 1_000_000
#: Most bits of the filter of item suffixes (32 MB); it has 16 for each suffix as long as that is less. More suffixes only make it pass more.
FILTER_BITS = 1 << 28
#: Bytes of a piece in which the filter is put together, and parts into which the matches of one key are spread.
PIECE_BYTES, SPREAD = 1 << 16, 8
#: Words whose hashes a worker remembers.
KEPT_WORDS = 500_000
WORD = re.compile(r"[^\W_]+").findall
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _seeds(ids: np.ndarray) -> np.ndarray:
    """A hash of the SEED_WORDS numbers from each position; the last positions are filled up with 0."""
    wide = np.concatenate([ids, np.zeros(SEED_WORDS, ids.dtype)]).astype(np.uint64)
    h = np.zeros(len(ids), np.uint64)
    for k in range(SEED_WORDS):
        h = (h ^ (wide[k : k + len(ids)] + np.uint64(k + 1))) * _MIX[k]
        h ^= h >> np.uint64(29)
    return h


def _clear(ids: np.ndarray, run: int) -> np.ndarray:
    """Positions whose next ``run`` numbers exist and are not 0."""
    zeros = np.concatenate([[0], np.cumsum(ids == 0)])
    return np.nonzero(zeros[run:] == zeros[:-run])[0] if len(ids) >= run else np.empty(0, np.int64)


def _suffix_keys(ids: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    """The first ``run`` numbers from each position as bytes that sort as the numbers do."""
    return np.ascontiguousarray(ids[at[:, None] + np.arange(run)].astype(">u4")).view(f"S{4 * run}").ravel()


class ItemBlock:
    """The sorted side of the search: suffixes of a block of item windows."""

    def __init__(self, windows: list[tuple[object, list[str]]], run: int):
        self.run = run
        self.number: dict[str, int] = {}
        parts, owner = [], []
        for k, (_, ws) in enumerate(windows):
            parts.append(np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in ws), np.int64, len(ws)))
            parts.append(np.zeros(1, np.int64))
            owner.append(np.full(len(ws) + 1, k))
        self.ids = np.concatenate([*parts, np.zeros(1, np.int64)])
        self.owner = np.concatenate([*owner, [-1]])
        self.items = [w[0] for w in windows]
        self.at = _clear(self.ids, run)
        self.keys = _suffix_keys(self.ids, self.at, run) if len(self.at) else np.empty(0, f"S{4 * run}")
        seeds = _seeds(self.ids)[self.at]
        self.seeds = np.unique(seeds)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(seeds >> np.uint64(44)).astype(np.int64)] = True

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the matches: text, window, first word in the text, first word in the block, length in words. Only left-maximal ones."""
        none = tuple(np.empty(0, np.int64) for _ in range(5))
        get, parts, starts = self.number.get, [], np.zeros(len(texts) + 1, np.int64)
        for k, t in enumerate(texts):
            ids = np.fromiter(map(get, WORD(t.lower()), repeat(0)), np.int32) if t else np.empty(0, np.int32)
            parts += [ids, np.zeros(1, np.int32)]
            starts[k + 1] = starts[k] + len(ids) + 1
        if not parts or not len(self.at):
            return none
        ids = np.concatenate(parts)
        at = _clear(ids, self.run)
        if len(at):
            seeds = _seeds(ids)[at]
            near = self.seen[(seeds >> np.uint64(44)).astype(np.int64)]
            at, seeds = at[near], seeds[near]
            if len(at):
                where = np.minimum(np.searchsorted(self.seeds, seeds), len(self.seeds) - 1)
                at = at[self.seeds[where] == seeds]
        if not len(at):
            return none
        keys = _suffix_keys(ids, at, self.run)
        order = np.argsort(keys, kind="stable")  # the shard's suffix array
        at, keys = at[order], keys[order]
        low, high = np.searchsorted(keys, self.keys, "left"), np.searchsorted(keys, self.keys, "right")
        hits = high - low
        if not hits.sum():
            return none
        mine = np.repeat(np.arange(len(self.at)), hits)
        rank = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low, hits)
        p, q = at[rank], self.at[mine]
        before = np.where((p > 0) & (q > 0), (ids[np.maximum(p - 1, 0)] == self.ids[np.maximum(q - 1, 0)]) & (ids[np.maximum(p - 1, 0)] != 0), False)
        p, q = p[~before], q[~before]
        length, growing = np.full(len(p), self.run), np.arange(len(p))
        while len(growing):
            a, b = p[growing] + length[growing], q[growing] + length[growing]
            ok = (a < len(ids)) & (b < len(self.ids))
            growing, a, b = growing[ok], a[ok], b[ok]
            growing = growing[(ids[a] == self.ids[b]) & (ids[a] != 0)]
            length[growing] += 1
        text = np.searchsorted(starts, p, "right") - 1
        return text, self.owner[q], p - starts[text], q, length


def _windows(items: DataFrame, key: str, text: str, run: int) -> DataFrame:
    """(item, words) in windows of at most WINDOW_WORDS words that overlap so that no run is lost."""
    step = WINDOW_WORDS - run + 1
    ws = items.select(F.col(key).alias("item"), tx.words(F.col(text)).alias("ws")).where(F.size("ws") >= run)
    begins = F.sequence(F.lit(0), F.greatest(F.size("ws") - run, F.lit(0)), F.lit(step))
    return ws.select("item", "ws", F.explode(begins).alias("begin")).select("item", "begin", F.slice("ws", F.col("begin") + 1, WINDOW_WORDS).alias("ws"))


def passage_matches(
    docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, run: int = RUN_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(doc, item, doc_word, n_words): each pair that shares ``run`` or more consecutive words, with its longest match and where that begins.

    One row per document row and item. Columns of the inputs beside the named ones are not read.
    """
    spark = docs.sparkSession
    kinds = docs.schema[doc_key].dataType, items.schema[item_key].dataType
    schema = T.StructType([T.StructField("doc", kinds[0]), T.StructField("item", kinds[1]), T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.LongType())])
    windows = _windows(items, item_key, item_text, run)
    total = windows.agg(F.sum(F.size("ws"))).first()[0] or 0
    if not total:
        return spark.createDataFrame([], schema)
    if total > block_words:
        return _shuffled_matches(docs, items, (doc_key, doc_text, item_key, item_text), run, total)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["item"], r["ws"]) for r in windows.toLocalIterator()]))  # at most block_words words

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _block(sent.value, run)
        for batch in batches:
            text, window, doc_word, _, length = block.search(batch.column(1).to_pylist())
            docs_found = batch.column(0).take(pa.array(text))
            items_found = pa.array([block.items[w] for w in window], _arrow(kinds[1]))
            yield pa.RecordBatch.from_arrays([docs_found, items_found, pa.array(doc_word, pa.int64()), pa.array(length, pa.int64())], names=["doc", "item", "doc_word", "n_words"])

    return _longest(docs.select(F.col(doc_key), F.col(doc_text)).mapInArrow(search, schema))


_BLOCKS: dict[str, ItemBlock] = {}


def _block(sent: tuple[str, list], run: int) -> ItemBlock:
    """The sorted side, built once in a worker."""
    name, windows = sent
    if name not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[name] = ItemBlock(windows, run)
    return _BLOCKS[name]


def _longest(found: DataFrame) -> DataFrame:
    best = F.max(F.struct("n_words", (-F.col("doc_word")).alias("back"))).alias("best")
    return found.groupBy("doc", "item").agg(best).select("doc", "item", (-F.col("best.back")).alias("doc_word"), F.col("best.n_words").alias("n_words"))


class WordHashes(dict):
    """Hashes of words, kept for those met lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") or 1
        return h


_HASHES = WordHashes()


def suffix_keys(texts: list[str | None], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each suffix with ``run`` or more words: its text, its first word's place and two hashes of its first ``run`` words."""
    parts, starts = [], np.zeros(len(texts) + 1, np.int64)
    for k, t in enumerate(texts):
        ws = WORD(t.lower()) if t else []
        parts += [np.fromiter(map(_HASHES.__getitem__, ws), np.uint64, len(ws)), np.zeros(1, np.uint64)]
        starts[k + 1] = starts[k] + len(ws) + 1
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    at = _clear(ids, run)
    first, second = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for j in range(run):
        w = ids[at + j]
        first = first * _MIX[0] + w
        second = (second ^ (w >> np.uint64(17))) * _MIX[1] + w
    first ^= first >> np.uint64(31)
    first *= _MIX[2]
    text = np.searchsorted(starts, at, "right") - 1
    return text, at - starts[text], first, second


def _key_rows(df: DataFrame, key: str, text: str, name: str, run: int, sent=None) -> DataFrame:
    """(h1, h2, name, at) of the suffixes of ``df``; only those that the filter passes, if there is one."""
    kind = df.schema[key].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, at, h1, h2 = suffix_keys(b.column(1).to_pylist(), run)
            if sent is not None:
                bits, shift = sent.value
                where = (h1 >> np.uint64(shift)).astype(np.int64)
                keep = (bits[where >> 3] >> (where & 7).astype(np.uint8)) & 1 == 1
                owner, at, h1, h2 = owner[keep], at[keep], h1[keep], h2[keep]
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), b.column(0).take(pa.array(owner)), pa.array(at)], names=["h1", "h2", name, "at"])

    return df.select(F.col(key), F.col(text)).mapInArrow(rows, f"h1 bigint, h2 bigint, `{name}` {kind.simpleString()}, at bigint")


def _filter(keys: DataFrame, total: int) -> tuple[np.ndarray, int]:
    """Bits by the first bits of h1, put together piece by piece on the cluster; at most FILTER_BITS of them reach the driver."""
    n_bits = min(FILTER_BITS, 1 << max(19, (16 * total - 1).bit_length()))
    shift = 64 - (n_bits.bit_length() - 1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_bits >> 3, np.uint8)
        for b in batches:
            where = (b.column(0).to_numpy().view(np.uint64) >> np.uint64(shift)).astype(np.int64)
            np.bitwise_or.at(bits, where >> 3, (1 << (where & 7)).astype(np.uint8))
        pieces = bits.reshape(-1, min(PIECE_BYTES, len(bits)))
        some = np.nonzero(pieces.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([pieces[i].tobytes() for i in some], pa.binary())], names=["piece", "bits"])

    def merge(t: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t["bits"].to_pylist()])
        return pa.table({"piece": t["piece"][:1], "bits": pa.array([both.tobytes()], pa.binary())})

    pieces = keys.select("h1").mapInArrow(mark, "piece bigint, bits binary").groupBy("piece").applyInArrow(merge, "piece bigint, bits binary").toArrow()
    out = np.zeros(n_bits >> 3, np.uint8)
    size = min(PIECE_BYTES, len(out))
    for piece, bits in zip(pieces["piece"].to_pylist(), pieces["bits"].to_pylist(), strict=True):
        out[piece * size : (piece + 1) * size] = np.frombuffer(bits, np.uint8)
    return out, shift


def _shuffled_matches(docs: DataFrame, items: DataFrame, names: tuple[str, str, str, str], run: int, total: int) -> DataFrame:
    doc_key, doc_text, item_key, item_text = names
    wanted = cut(_key_rows(items, item_key, item_text, "item", run))
    sent = docs.sparkSession.sparkContext.broadcast(_filter(wanted, total))  # at most FILTER_BITS bits
    met = _key_rows(docs, doc_key, doc_text, "doc", run, sent).withColumn("spread", F.pmod(F.xxhash64("doc"), F.lit(SPREAD)))
    wanted = wanted.withColumnRenamed("at", "item_at").withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<bigint>")))
    hits = met.join(wanted, ["h1", "h2", "spread"]).select("doc", "item", "at", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    place = F.row_number().over(Window.partitionBy("doc", "item", "diagonal").orderBy("at"))
    runs = hits.withColumn("run", F.col("at") - place).groupBy("doc", "item", "diagonal", "run").agg(F.min("at").alias("doc_word"), (F.count("*") + run - 1).alias("n_words"))
    return _longest(runs.select("doc", "item", "doc_word", "n_words"))


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]


def without_leaks(docs: DataFrame, matches: DataFrame, doc_key: str) -> DataFrame:
    """``docs`` without the rows that hold a passage."""
    bad = matches.select(F.col("doc").alias("__leaked")).distinct()
    return docs.join(bad, docs[doc_key] == bad["__leaked"], "left_anti")
