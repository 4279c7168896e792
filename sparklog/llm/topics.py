"""Topics of texts without topic labels: spherical k-means over hashed content words, fitted on all documents.

A text's content words (letters only, `LEAST` bytes or more, so that function words hardly count) are hashed to DIMS
buckets (by sums of a random number for each byte times an odd one for its place, for many texts at once); the square roots of their counts, scaled to length 127 and rounded, are its vector of DIMS bytes. From it the
mean vector of its language is taken, so that topics are not languages: labels that LANGUAGES or more others outnumber,
and null ones, share one mean. Centroids begin at fixed random directions; each round every document goes to the
centroid of the greatest scalar product (ties: the first), and centroids become the sums of their documents.

One pass over the texts writes the vectors; means and rounds read only these. All sums are of integers, so centroids do
not depend on partitions or retries. The driver holds DIMS numbers a topic and language.

Texts without content words have the topic "none". A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm import common

DIMS, LEAST, LANGUAGES = 64, 4, 32
#: Lower-case letters and bytes of other characters than ASCII; 0: what parts words.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 0 for b in range(256)], np.uint8)
SPACE = np.array([b in b" \t\n\v\f\r" for b in range(256)])
#: Random numbers of bytes and of places in a word (from the 65th byte on, places begin again), from a fixed seed.
_DRAW = np.random.Generator(np.random.PCG64(20240302))
GEAR, PLACES = _DRAW.integers(0, 1 << 32, 256, dtype=np.uint32), _DRAW.integers(0, 1 << 32, 64, dtype=np.uint32) | np.uint32(1)
BLOCK = 1 << 20
FEATURES = "tokens long, vector binary"


def _counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words between white space of each text, and its content words by bucket."""
    n = len(texts)
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    solid = ~SPACE[data]
    begins = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
    tokens = np.bincount(np.searchsorted(edges, begins, "right") - 1, minlength=n)
    letters = LETTERS[data]
    at = np.flatnonzero(letters)
    if not len(at):
        return tokens, np.zeros((n, DIMS), np.int64)
    starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(starts, append=len(at))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    hashes = np.add.reduceat(GEAR[letters[at]] * PLACES[place & 63], starts, dtype=np.uint32)
    kept = lengths >= LEAST
    doc = np.searchsorted(edges, at[starts[kept]], "right") - 1
    return tokens, np.bincount(doc * DIMS + (hashes[kept] >> np.uint32(26)), minlength=n * DIMS).reshape(n, DIMS)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about BLOCK bytes, cut at spaces only."""
    at = 0
    while len(text) - at > BLOCK:
        cut = text.rfind(b" ", at, at + BLOCK)
        cut = cut if cut > at else text.find(b" ", at + BLOCK)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """_counted() of any texts, in blocks of about BLOCK bytes."""
    tokens, buckets = np.zeros(len(texts), np.int64), np.zeros((len(texts), DIMS), np.int64)
    held, owners, size = [], [], 0

    def add() -> None:
        t, b = _counted(held)
        np.add.at(tokens, owners, t)
        np.add.at(buckets, owners, b)

    for k, text in enumerate(texts):
        for piece in _pieces(text):
            held.append(piece), owners.append(k)
            size += len(piece)
            if size >= BLOCK:
                add()
                held, owners, size = [], [], 0
    if held:
        add()
    return tokens, buckets


def vectors_of(buckets: np.ndarray) -> np.ndarray:
    """Vectors (int8, a row a text) from content words by bucket; zeros without any."""
    length = np.sqrt(buckets.sum(axis=1, keepdims=True))
    return np.rint(np.sqrt(buckets) * (127 / np.maximum(length, 1e-9))).astype(np.int8)


class Topics(NamedTuple):
    """means: language (None: all others) to mean vector; centroids: a row a topic."""

    means: dict[str | None, np.ndarray]
    centroids: np.ndarray

    def of(self, vectors: np.ndarray, langs: list[str | None]) -> np.ndarray:
        """Number of the topic of each vector (a row each), -1 for zero vectors."""
        means = np.array([self.means.get(x, self.means[None]) for x in langs]).reshape(-1, DIMS)
        found = ((vectors - means) @ self.centroids.T).argmax(axis=1) if len(vectors) else np.empty(0, np.int64)
        return np.where(vectors.any(axis=1), found, -1)


def features(text: Column) -> Column:
    """tokens (words between ASCII white space) and vector of a text column."""

    @F.arrow_udf(FEATURES)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            tokens, buckets = counted(common.byte_texts(texts))
            yield pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array([v.tobytes() for v in vectors_of(buckets)], pa.binary())], ["tokens", "vector"])

    return found(text)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, DIMS).astype(float)


def _sums(rows: DataFrame, group) -> dict:
    """Sums of the vectors (and their number, last) by what group(vectors, langs) gives for each; one row a task and group is shuffled."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            vectors, langs = _vectors(batch.column(0)), batch.column(1).to_pylist()
            keys = group(vectors, langs)
            order = {key: k for k, key in enumerate(dict.fromkeys(keys))}
            place = np.array([order[key] for key in keys], np.int64)
            for key, k in order.items():
                own = vectors[place == k]
                sums[key] = sums.get(key, 0) + np.append(own.sum(axis=0), len(own))
        yield pa.RecordBatch.from_pydict({"key": pa.array(list(sums), pa.string()), "sums": pa.array([x.astype(np.int64).tolist() for x in sums.values()], pa.list_(pa.int64()))})

    cells = rows.select("vector", "lang").mapInArrow(summed, "key string, sums array<long>").select("key", F.posexplode("sums").alias("k", "x")).groupBy("key", "k").agg(F.sum("x").alias("x"))
    out: dict = {}
    for r in cells.collect():  # groups x (DIMS + 1)
        out.setdefault(r["key"], np.zeros(DIMS + 1))[r["k"]] = r["x"]
    return out


def fit(rows: DataFrame, *, topics: int = 8, rounds: int = 5) -> Topics:
    """Topics of rows(vector, lang), all of them."""
    top = [r["lang"] for r in rows.filter("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    sums = _sums(rows, lambda vectors, langs: [x if x in top else None for x in langs])
    means = {k: x[:-1] / max(1, x[-1]) for k, x in sums.items()}
    means.setdefault(None, sum(x[:-1] for x in sums.values()) / max(1, sum(x[-1] for x in sums.values())) if sums else np.zeros(DIMS))
    centroids = np.random.Generator(np.random.PCG64(20240301)).choice([-1.0, 1.0], (topics, DIMS)) / np.sqrt(DIMS)
    for _ in range(rounds):
        model = Topics(means, centroids)
        # A group is a topic in a language, so that the language's mean can be taken from the sums of integers.
        groups = _sums(rows, lambda vectors, langs, model=model: [f"{k}:{x if x in top else ''}" for k, x in zip(model.of(vectors, langs).tolist(), langs, strict=True)])
        new = np.zeros_like(centroids)
        for key in sorted(groups):
            number, lang = key.split(":", 1)
            if int(number) >= 0:
                new[int(number)] += groups[key][:-1] - groups[key][-1] * means[lang if lang in top else None]
        lengths = np.sqrt((new * new).sum(axis=1, keepdims=True))
        centroids = np.where(lengths > 0, new / np.maximum(lengths, 1e-9), centroids)
    return Topics(means, centroids)


def names(numbers: np.ndarray) -> list[str]:
    return ["none" if k < 0 else f"t{k}" for k in numbers.tolist()]


def topic_of_vector(vector: Column, lang: Column, model: Topics) -> Column:
    @F.arrow_udf("string")
    def found(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vectors, langs in batches:
            yield pa.array(names(model.of(_vectors(vectors), langs.to_pylist())), pa.string())

    return found(vector, lang)


def topic_of_text(text: Column, lang: Column, model: Topics) -> Column:
    """struct of tokens and topic."""

    @F.arrow_udf("tokens long, topic string")
    def found(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, langs in batches:
            tokens, buckets = counted(common.byte_texts(texts))
            numbers = model.of(vectors_of(buckets).astype(float), langs.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(names(numbers), pa.string())], ["tokens", "topic"])

    return found(text, lang)
