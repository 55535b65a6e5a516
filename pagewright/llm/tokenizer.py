"""Byte-pair encoding of a corpus by a lazily determinised transducer.

The merges are not replayed text by text. For a byte string w let t(w) be the last token of its encoding. t(wc) is the longest
vocabulary entry v that ends wc and may follow t(wc without v), where "b may follow a" means that the merges leave the bytes of a and b
as just these two tokens. So t(wc) hangs only on c and on the t of those positions from which the bytes read so far may still grow into
a vocabulary entry. That finite piece of knowledge is the transducer's state; states and transitions are made when first met and kept.
A token is emitted as soon as every position that may still matter leads back through it, which happens after a bounded lookahead.

Long texts are read whole. Null and empty texts have an empty list of ids. Special marks inside a text are plain text.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_FOLDER = "/opt/tokenizers"
#: Splits a text before the merges; fixed by the public vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for pure ASCII texts, where the standard library's matcher is faster.
PIECES_ASCII = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Bounds of what a worker keeps. Beyond them the memory is emptied and filled again; results are the same.
KEPT_PIECES, KEPT_STATES, LONG_PIECE = 400_000, 200_000, 64
START = -1


class MergeTransducer:
    """One vocabulary's transducer. ``ranks`` maps a token's bytes to its rank, which is also its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.prefixes = {b[:k] for b in ranks for k in range(1, len(b) + 1)} | {b""}
        self._may_follow: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[bytes, tuple[int, ...]]] = []
        self.number: dict[tuple[bytes, tuple[int, ...]], int] = {}
        self.steps: list[dict[int, tuple[int, int]]] = []
        self._state((b"", (START,)))

    def _state(self, state: tuple[bytes, tuple[int, ...]]) -> int:
        k = self.number.get(state)
        if k is None:
            k = self.number[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return k

    def _merge(self, text: bytes) -> list[int]:
        """The merges replayed on a few bytes; only used to learn which tokens may stand side by side."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        known = self._may_follow.get((a, b))
        if known is None:
            if len(self._may_follow) > KEPT_PIECES:
                self._may_follow.clear()
            known = self._may_follow[a, b] = self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def _open_starts(self, tail: bytes) -> list[int]:
        """Lengths of the ends of ``tail`` that begin some vocabulary entry, longest first; 0 is always the last."""
        return [n for n in range(len(tail), -1, -1) if tail[len(tail) - n :] in self.prefixes]

    def step(self, at: int, byte: int) -> tuple[int, int]:
        """The next state and t of the bytes read so far."""
        known = self.steps[at].get(byte)
        if known is not None:
            return known
        tail, lasts = self.states[at]
        before = dict(zip(self._open_starts(tail), lasts, strict=True))
        grown = tail + bytes((byte,))
        while grown not in self.prefixes:
            grown = grown[1:]
        lengths = self._open_starts(grown)
        for n in lengths:
            token = self.ranks.get(grown[len(grown) - n :]) if n else None
            if token is not None and self.is_whole(token) and (before[n - 1] == START or self.may_follow(before[n - 1], token)):
                break
        else:
            raise ValueError(f"the vocabulary lacks byte {byte}")
        following = self._state((grown, tuple(before[n - 1] if n else token for n in lengths)))
        self.steps[at][byte] = following, token
        return following, token

    def encode(self, text: bytes) -> list[int]:
        """Ids of one piece."""
        if (whole := self.ranks.get(text)) is not None and self.is_whole(whole):
            return [whole]
        if len(self.states) > KEPT_STATES:
            self._reset()
        if len(text) > LONG_PIECE:
            return list(self.stream(text))
        at, lasts = 0, []
        for byte in text:
            at, token = self.step(at, byte)
            lasts.append(token)
        out, i = [], len(text)
        while i:
            out.append(lasts[i - 1])
            i -= len(self.bytes_of[lasts[i - 1]])
        return out[::-1]

    def is_whole(self, token: int) -> bool:
        """Whether the merges make this entry from its own bytes."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self._merge(self.bytes_of[token]) == [token]
        return known

    def stream(self, text: bytes) -> Iterator[int]:
        """Ids of one piece, emitted while reading: what is held back is as long as the lookahead, whatever the piece's length."""
        at, held, begin = 0, [], 0  # held[i]: t after byte begin + i
        for i, byte in enumerate(text):
            at, token = self.step(at, byte)
            held.append(token)
            if len(held) < 2 * LONG_PIECE and i + 1 < len(text):
                continue
            # go back from every position that may still matter; where the ways meet, all before is settled
            end = i + 1
            ways = {end} if end == len(text) else {end - n for n in self._open_starts(self.states[at][0])}
            while len(ways) > 1:
                far = max(ways)
                ways.discard(far)
                ways.add(far - len(self.bytes_of[held[far - begin - 1]]))
            meet, out = ways.pop(), []
            back = meet
            while back > begin:
                out.append(held[back - begin - 1])
                back -= len(self.bytes_of[out[-1]])
            yield from reversed(out)
            del held[: meet - begin]
            begin = meet


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one line per token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Pieces(dict):
    """Ids of the pieces met so far."""

    def __init__(self, transducer: MergeTransducer):
        self.transducer = transducer

    def __missing__(self, piece: str) -> list[int]:
        ids = self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= LONG_PIECE:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Texts to ids by one vocabulary."""

    def __init__(self, path: str):
        self.transducer = MergeTransducer(read_ranks(path))
        self.pieces = _Pieces(self.transducer)
        self.split, self.split_ascii = regex.compile(PIECES).findall, re.compile(PIECES_ASCII, re.A).findall

    def encode(self, text: str | None) -> chain:
        """Ids of one text as an iterator."""
        if not text:
            return chain()
        found = self.split_ascii(text) if text.isascii() else self.split(text)
        return chain.from_iterable(map(self.pieces.__getitem__, found))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


class Utf8Decoder:
    """Incremental UTF-8 decoding: bytes arrive in any portions, characters leave as soon as they are complete.

    ``need`` is how many bytes of the current character are missing and ``low``/``high`` bound the next one. Ill-formed bytes give U+FFFD.
    """

    def __init__(self) -> None:
        self.need, self.code, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.code, self.need, self.low, self.high = self.code << 6 | b & 0x3F, self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                self.need, self.low, self.high = 0, 0x80, 0xBF
                out.append("�")
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.code = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        """What an unfinished last character gives."""
        rest, self.need = "�" if self.need else "", 0
        return rest


def decode(ids: list[int], transducer: MergeTransducer) -> str:
    """Text of a list of ids, token by token."""
    d = Utf8Decoder()
    return "".join(d.feed(transducer.bytes_of[int(i)]) for i in ids) + d.end()


def encode_column(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """One row (key, ids) for each row of ``df``; ids is empty for null and for empty texts. Other columns are not read.

    A scan and one Arrow pass without a shuffle: no row depends on another.
    """
    path = path or os.path.join(DEFAULT_FOLDER, "byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            ids, ends = array("i"), [0]
            for text in batch.column(1).to_pylist():
                ids.extend(e.encode(text))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.frombuffer(ids, dtype=np.int32) if ids else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_column(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """One row (key, text) for each row of ``df``; null and empty lists give ''. Unknown ids raise."""
    path = path or os.path.join(DEFAULT_FOLDER, "byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = encoder(path).transducer
        for batch in batches:
            texts = [decode(x or [], t) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, text string")


def token_count(ids: Column) -> Column:
    return F.size(ids)
