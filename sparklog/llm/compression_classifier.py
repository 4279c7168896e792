"""Quality classifier by compression: zstandard dictionaries of good and of bad text, and a calibrated score.

A text is cut into pieces of `PIECE` bytes, and each is compressed alone with either dictionary, so that the
dictionary and not the text's own past decides. The difference of the two sizes, normalised by the text's bytes, is all
that a score sees: a logistic function of it, fitted on labelled texts that no dictionary has seen, weighted so that
classes count as often as among all labels used for learning.

Learning uses at most `per_class` labelled documents of each class (the least by a hash of the id) of at most
`longest` bytes each, and of these only as many as have `most_bytes` together, which is what may come to the driver; this
bound is the only thing that sees a part of the data. Scoring reads every whole text, needs no shuffle and ships two
dictionaries of `DICTIONARY` bytes.

Null and empty texts are scored as empty; labels other than 0 and 1, and null ones, are ignored; a document with more
than one label counts once for each, one with more than one row by its least text. With fewer than `least` texts of a class there is no classifier, and every score
is the share of good labels, or 0.5 without any. Other columns pass through; a column of the name `out` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm import common

PIECE, DICTIONARY, LEVEL = 256, 65536, 3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    offset: float
    prior: float


class Sizes:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def compressor(held: bytes):
            dictionary = zstandard.ZstdCompressionDict(held)
            dictionary.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False).compress

        self.good, self.bad = compressor(good), compressor(bad)

    def difference(self, text: bytes) -> float:
        """How many bytes a byte of the text takes less with the good dictionary than with the bad one."""
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        return sum(len(self.bad(p)) - len(self.good(p)) for p in pieces) / (len(text) + 16)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights by Newton's method with halved steps."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def fit(good: list[bytes], bad: list[bytes], share_good: float, least: int = 20) -> Model:
    """Dictionaries from every other text of each class, calibration from the rest."""
    import zstandard

    if min(len(good), len(bad)) < least:
        return Model(b"", b"", 0.0, 0.0, share_good)

    def dictionary(texts: list[bytes]) -> bytes:
        pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
        size = min(DICTIONARY, max(1024, sum(map(len, pieces)) // 8))
        return zstandard.train_dictionary(size, pieces).as_bytes()

    try:
        held = dictionary(good[::2]), dictionary(bad[::2])
    except zstandard.ZstdError:  # too little text to build a dictionary from
        return Model(b"", b"", 0.0, 0.0, share_good)
    sizes = Sizes(*held)
    found = np.array([sizes.difference(t) for t in good[1::2] + bad[1::2]])
    y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    weight = np.where(y == 1, share_good / y.sum(), (1 - share_good) / (len(y) - y.sum())) * len(y)
    scale = float(found.std()) + 1e-9
    slope, offset = _logistic(np.column_stack((found / scale, np.ones(len(found)))), y, weight)
    return Model(*held, float(slope) / scale, float(offset), share_good)


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 3000, longest: int = 1 << 20, most_bytes: int = 64 << 20, least: int = 20) -> Model:
    """A model from labelled rows; labels has the rows to learn from only."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    counts = {int(r[0]): r[1] for r in own.groupBy("label").count().collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) < least:
        return fit([], [], counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5)
    some = [own.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # 2 x per_class rows
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.octet_length("text") <= longest)
    one = texts.join(chosen, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    sizes = sorted(tuple(r) for r in one.select(F.xxhash64("id"), "id", F.col("label").cast("int"), F.octet_length("text")).collect())  # 2 x per_class rows
    held, room = [], {0: most_bytes // 2, 1: most_bytes // 2}
    for _, id_, label, size in sizes:
        room[label] -= size
        if room[label] >= 0:
            held.append((id_, label))
    if not held:
        return fit([], [], counts[1] / sum(counts.values()))
    few = docs.sparkSession.createDataFrame(held, one.select("id", F.col("label").cast("int").alias("label")).schema)
    rows = sorted((order, int(label), text.encode()) for order, label, text in one.join(F.broadcast(few), ["id", "label"]).select(F.xxhash64("id"), "label", "text").collect())
    by = [[t for _, label, t in rows if label == k] for k in (0, 1)]
    return fit(by[1], by[0], counts[1] / sum(counts.values()), least)


def score(text: Column, model: Model) -> Column:
    """Score from 0 to 1 of a text column."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes = Sizes(model.good, model.bad) if model.good else None
        for texts in batches:
            if sizes is None:
                yield pa.array([model.prior] * len(texts), pa.float64())
                continue
            z = model.slope * np.array([sizes.difference(t) for t in common.byte_texts(texts)], float) + model.offset
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return scored(text)


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classified(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", out: str = "score", **options) -> DataFrame:
    """docs with a column `out`, learnt from the labels outside the held-out third."""
    model = learn(docs, labels.filter(~held_out(F.col(id_col))), id_col=id_col, text_col=text_col, label_col=label_col, **options)
    return docs.withColumn(out, score(F.col(text_col), model))
