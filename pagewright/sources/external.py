"""Places for models and services: encoders, keyword and query generators, judges.

Each is a function over Arrow batches, registered by name, that a job replaces with a real one. The defaults are deterministic stand-ins
made from md5, so that pipelines run and are tested without any model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], list[np.ndarray]]
Generator = Callable[[list[str]], list[str]]
ENCODERS: dict[str, Encoder] = {}
GENERATORS: dict[str, Generator] = {}


def encoder(name: str) -> Callable[[Encoder], Encoder]:
    def add(f: Encoder) -> Encoder:
        ENCODERS[name] = f
        return f

    return add


def generator(name: str) -> Callable[[Generator], Generator]:
    def add(f: Generator) -> Generator:
        GENERATORS[name] = f
        return f

    return add


def hash_vector(word: str, dim: int = 64) -> np.ndarray:
    """A unit vector that depends on the word alone."""
    raw = b"".join(hashlib.md5(f"{word}/{i}".encode()).digest() for i in range(-(-dim // 16)))
    v = np.frombuffer(raw[:dim], np.uint8).astype(float) - 127.5
    return v / np.linalg.norm(v)


@encoder("multi_vector")
def hash_multi_vector(texts: list[str]) -> list[np.ndarray]:
    """One vector per word; an empty text has one for the empty word."""
    return [np.stack([hash_vector(w) for w in (t or "").lower().split() or [""]]) for t in texts]


@encoder("single_vector")
def hash_single_vector(texts: list[str]) -> list[np.ndarray]:
    """The mean of the words' vectors at unit length."""
    out = []
    for m in hash_multi_vector(texts):
        v = m.mean(axis=0)
        n = np.linalg.norm(v)
        out.append((v / n if n else v)[None, :])
    return out


@generator("keywords")
def frequent_words(texts: list[str]) -> list[str]:
    """A JSON answer with the eight most frequent long words."""
    out = []
    for t in texts:
        words = pd.Series([w for w in (t or "").lower().split() if len(w) > 5 and w.isalpha()], dtype=object)
        top = sorted(words.value_counts().items(), key=lambda x: (-x[1], x[0]))[:8]
        out.append('<answer>{"keywords":[%s],"category":"research"}</answer>' % ",".join(f'"{w}"' for w, _ in top))
    return out


@generator("query")
def query_of_prompt(prompts: list[str]) -> list[str]:
    """A JSON answer with a query made of the prompt's first words."""
    return ['<answer>{"query":"Which documents cover %s?"}</answer>' % " ".join((p or "").replace('"', "").replace("\\", "").split()[:6]) for p in prompts]


@generator("theme")
def theme_of_prompt(prompts: list[str]) -> list[str]:
    return [" ".join((p or "").split()[:5]) for p in prompts]


def encoded(df: DataFrame, key: str, text: str, name: str = "multi_vector", batch: int = 50) -> DataFrame:
    """(key, vectors): texts through an encoder in batches. Null texts are encoded as ''."""
    run_batch = ENCODERS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                vectors = run_batch([t or "" for t in part[text]])
                yield pd.DataFrame({key: part[key].to_numpy(), "vectors": [[list(v) for v in m] for m in vectors]})

    return df.select(key, text).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, vectors array<array<double>>")


def generated(df: DataFrame, key: str, prompt: str, name: str, batch: int = 20) -> DataFrame:
    """(key, answer): prompts through a generator. A batch that fails gives null answers and the others go on."""
    run_batch = GENERATORS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                try:
                    answers = run_batch([p or "" for p in part[prompt]])
                except Exception:  # noqa: BLE001  a service's failure of any kind
                    answers = [None] * len(part)
                yield pd.DataFrame({key: part[key].to_numpy(), "answer": pd.Series(answers, dtype=object).to_numpy()})

    return df.select(key, prompt).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, answer string")


def judged(df: DataFrame, key: str, text: str, candidates: str, judge: Callable[[str, list[str]], list[str]], on_failure: str = "none") -> DataFrame:
    """(key, kept): a judge's choice, restricted to the candidates and in their order. A failing call keeps none, or all with ``on_failure``="all"."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = []
            for t, c in zip(pdf[text], pdf[candidates], strict=True):
                given = [] if c is None else list(c)
                try:
                    said = set(judge(t or "", given)) if given else set()
                except Exception:  # noqa: BLE001
                    said = set(given) if on_failure == "all" else set()
                kept.append([x for x in given if x in said])
            yield pd.DataFrame({key: pdf[key].to_numpy(), "kept": kept})

    return df.select(key, text, candidates).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, kept array<string>")


def shares_word(text: str, queries: list[str]) -> list[str]:
    """A judge: queries with a long word that the text has."""
    words = {w for w in text.lower().split() if len(w) > 6}
    return [q for q in queries if q and words & set(q.lower().split())]


def masked_unit_vectors(tokens: DataFrame, vector: str, mask: str) -> DataFrame:
    """What follows a model's projection: vectors at unit length, masked ones zero."""
    from pagewright.functions.vectors import normalised

    return tokens.withColumn(vector, F.transform(normalised(F.col(vector).cast("array<double>")), lambda x: x * F.col(mask)))


def pooled_vector(tokens: DataFrame, doc: str, order: str, vector: str, how: str) -> DataFrame:
    """(doc, e): one vector per document: the first token's (cls), the last's or the mean, at unit length."""
    from pagewright.functions.vectors import normalised

    v = F.col(vector).cast("array<double>")
    if how in ("cls", "last"):
        pick = F.min_by if how == "cls" else F.max_by
        return tokens.groupBy(doc).agg(pick(v, F.col(order)).alias("v")).select(doc, normalised(F.col("v")).alias("e"))
    if how != "mean":
        raise ValueError(f"unknown pooling {how}")
    each = tokens.select(doc, F.posexplode(v).alias("p", "x")).groupBy(doc, "p").agg(F.avg("x").alias("x"))
    return each.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("v")).select(doc, normalised(F.col("v.x")).alias("e"))
