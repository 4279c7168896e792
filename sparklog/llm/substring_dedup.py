"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A chunk ends where the gear hash of the last WINDOW bytes has its top `bits` bits 0, at `least` bytes or more, or at
`most` bytes (255 or fewer); ends never split a character. Insertions shift chunks only near them. What is deduplicated
are pairs of adjoining chunks, by the 64-bit digest of their bytes (about 60, ten words), so that common phrases of two
documents seldom count, and chunks join in a span only where an earlier document has them in this order. A digest's
*keeper* is the least doc_id that has it; the pairs of other documents with it are redundant. Redundant pairs that follow
each other make a span, and spans of `min_words` words or more are reported, each with all keepers of its pairs: chunks
at both ends of a shared passage mix it with what is around, so of a passage of 51 words all but a few per mille show 24
or more. Texts of one digest by chance make no span, since a span of that many words needs several digests in a row.

Digests are summed to least and greatest doc_id before they are shuffled, so frequent passages are no hot keys there;
occurrences then join the repeated digests as plain tables, which adaptive execution splits where one is frequent.
Spans of one document meet in one task, as its text does.

Null and empty texts have no chunks, texts of one chunk no pairs. Repeats inside one document are left alone, as are rows with a null id; rows that
share an id count as one document. Extra columns are ignored by spans() and pass through without_repeats().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparklog.llm import common

#: The gear: a random 32-bit number for each byte, from a fixed seed.
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint32)
WINDOW = 16
#: place: first code point << 32, code points of both chunks << 24 and << 16, words begun in both << 8 and << 0.
PAIR = "doc_id long, digest long, place long"


def cuts(text: bytes, least: int = 16, most: int = 96, bits: int = 4) -> list[int]:
    """Ends of the chunks of a UTF-8 text."""
    n = len(text)
    data = np.frombuffer(text, np.uint8)
    h = GEAR[data]
    k = 1
    while k < WINDOW:  # after the round of k, h has the last 2k bytes
        more = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += more
        k *= 2
    h &= np.uint32((1 << WINDOW) - 1)  # higher bits would see bytes unevenly
    ok = np.ones(n + 1, bool)  # an end here splits no character
    ok[1:n] = (data[1:] & 0xC0) != 0x80
    ends = np.nonzero((h >> np.uint32(WINDOW - bits) == 0) & ok[1:])[0] + 1
    out, at = [], 0
    for end in [*ends.tolist(), n]:
        while end - at > most:
            cut = at + most
            while not ok[cut]:
                cut -= 1
            out.append(cut)
            at = cut
        if end - at >= least or (end == n and end > at):
            out.append(end)
            at = end
    return out


def _pairs(docs: DataFrame, id_col: str, text_col: str, least: int, most: int, bits: int) -> DataFrame:
    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                ids, digests, places = [], [], []
                for doc, text in zip(some.column(0).to_pylist(), common.byte_texts(some.column(1)), strict=True):
                    if not text:
                        continue
                    edges = [0, *cuts(text, least, most, bits)]
                    if len(edges) < 3:
                        continue
                    data = np.frombuffer(text, np.uint8)
                    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[edges]
                    blank = space[data]
                    begun = np.concatenate(([0], np.cumsum(~blank & np.concatenate(([True], blank[:-1])))))[edges]
                    size, words = np.diff(points), np.diff(begun)
                    digests += [digest(text[a:b]) for a, b in zip(edges, edges[2:], strict=False)]
                    ids.append(np.full(len(edges) - 2, doc))
                    places.append(points[:-2] << 32 | size[:-1] << 24 | size[1:] << 16 | words[:-1] << 8 | words[1:])
                if ids:
                    columns = [np.concatenate(ids), np.array(digests, np.uint64).view(np.int64), np.concatenate(places)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "digest", "place"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    return rows.mapInArrow(chunk, PAIR)


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 24, least: int = 16, most: int = 96, bits: int = 4) -> DataFrame:
    """Redundant spans: doc_id, start, end (code points), words, keepers (keeper and words of its chunks that it keeps, by id)."""
    if most > 255:
        raise ValueError("chunks have 255 bytes at most")
    pairs, _ = common.written(_pairs(docs, id_col, text_col, least, most, bits), "pairs")
    repeated = pairs.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).filter("keeper < last").drop("last")
    repeated, _ = common.written(repeated, "repeated")
    redundant = pairs.join(repeated, "digest").filter("doc_id > keeper").select("doc_id", "place", "keeper").dropDuplicates(["doc_id", "place", "keeper"])
    part = {name: F.shiftright("place", n).bitwiseAND(F.lit(255)) for name, n in (("points", 24), ("more_points", 16), ("words", 8), ("more_words", 0))}
    placed = redundant.select("doc_id", "keeper", F.shiftright("place", 32).alias("start"), *[c.alias(n) for n, c in part.items()])
    order = Window.partitionBy("doc_id").orderBy("start")
    after = F.col("start") + F.col("points")
    fresh = F.coalesce((F.lag(after).over(order) != F.col("start")).cast("int"), F.lit(1))
    # A pair counts its first chunk, and its second one where no pair begins with that.
    follows = F.coalesce(F.lead("start").over(order) == after, F.lit(False))
    own = follows & (F.lead("keeper").over(order) == F.col("keeper"))
    counted = [F.col("words") + F.when(there, 0).otherwise(F.col("more_words")) for there in (follows, own)]
    runs = placed.select("doc_id", "keeper", "start", (after + F.col("more_points")).alias("end"), fresh.alias("fresh"), counted[0].alias("words"), counted[1].alias("kept"))
    runs = runs.withColumn("run", F.sum("fresh").over(order))
    # Dealt by doc_id already: two aggregates and no further shuffle. Each keeper counts, since none of them has the whole span.
    kept = runs.groupBy("doc_id", "run", "keeper").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.sum("kept").alias("kept"))
    each = F.sort_array(F.collect_list(F.struct("keeper", F.col("kept").alias("words"))))
    found = kept.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), each.alias("keepers"))
    return found.filter(F.col("words") >= min_words).drop("run")


def repeated_documents(docs: DataFrame, *, min_words: int = 24, **options) -> DataFrame:
    """Documents with redundant spans: doc_id, n_spans, n_words, keepers, spans, span_keepers.

    span_keepers has, span by span, every keeper with its words. keepers has the ids of those of `min_words` words or more
    where the span's others have fewer than that together (edges cut otherwise than in the keeper), else of all.
    """

    def main(span):
        small = F.aggregate(F.filter(span["keepers"], lambda k: k["words"] < min_words), F.lit(0).cast("long"), lambda n, k: n + k["words"])
        return F.when(small < min_words, F.filter(span["keepers"], lambda k: k["words"] >= min_words)).otherwise(span["keepers"])["keeper"]

    found = spans(docs, min_words=min_words, **options).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_spans"), F.sum("words").alias("n_words"), F.sort_array(F.collect_list(F.struct("start", "end", "keepers"))).alias("found")
    )
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("found", main))))
    places = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", "n_spans", "n_words", ids.alias("keepers"), places.alias("spans"), F.col("found.keepers").alias("span_keepers"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the redundant spans cut out of their texts."""
    own, cut = common.free_name(docs, "span_doc"), common.free_name(docs, "span_list")
    found = repeated_documents(docs, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias(own), F.col("spans").alias(cut))
    joined = docs.join(found, F.col(id_col).cast("long") == F.col(own), "left")
    text = F.col(text_col)
    kept = F.transform(cut, lambda s, i: F.substring(text, F.when(i == 0, 0).otherwise(F.get(F.col(cut), i - 1)["end"]) + 1, (s["start"] - F.when(i == 0, 0).otherwise(F.get(F.col(cut), i - 1)["end"]))))
    last = F.element_at(F.col(cut), -1)["end"]
    rest = F.substring(text, last + 1, F.char_length(text))
    whole = F.when(F.col(cut).isNull(), text).otherwise(F.concat(F.concat_ws("", kept), rest))
    return joined.withColumn(text_col, whole).select(*[F.col(f"`{c}`") for c in docs.columns])
