import math
import zlib

import pytest
import zstandard

from sparklog.llm import compression_classifier as cc
from sparklog.llm.queries import op10_compression_classifier

from .helpers import SF, no_documents, odd_documents, table


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in op10_compression_classifier(spark, SF).collect()}
    assert len(rows) == table(spark, "documents").count()
    for doc, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(rows[r["doc_id"]]["score"], r["quality"]) for r in table(spark, "labels").collect() if rows[r["doc_id"]]["held_out"]]
    assert sum((s >= 0.5) == y for s, y in held) / len(held) >= 0.95
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) >= 0.9  # 14 bad texts
    bins = [sum(good) + sum(bad), len(good)]
    assert bins[0] / len(held) == pytest.approx(bins[1] / len(held), abs=0.1)


def test_labels_of_the_held_out_third_do_not_count(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    flipped = labels.withColumn("quality", (1 - labels.quality) * cc.held_out(labels.doc_id).cast("int") + labels.quality * (~cc.held_out(labels.doc_id)).cast("int"))
    a = {r["doc_id"]: r["score"] for r in cc.classified(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in cc.classified(docs, flipped).collect()}
    assert a == b


def test_odd_rows(spark):
    docs, labels = odd_documents(spark, "score string"), table(spark, "labels")
    none = cc.classified(docs, labels.limit(0), out="p").collect()
    assert {r["p"] for r in none} == {0.5}
    few = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, None), (None, 1), (5, 7)], "doc_id long, quality int")
    assert {r["p"] for r in cc.classified(docs, few, out="p").collect()} <= {0.5, 2 / 3, 1.0, 0.0}
    model = cc.learn(table(spark, "documents"), labels)
    scored = docs.withColumn("p", cc.score(docs.text, model)).collect()
    assert len(scored) == docs.count() and all(0 <= r["p"] <= 1 for r in scored)
    assert cc.classified(docs, labels).columns == docs.columns
    assert cc.classified(no_documents(spark), labels).count() == 0


def test_scores_against_plain_sizes(spark):
    """Sizes, fit and score again: whole compressor calls, calibration by bisection of its two conditions."""
    docs, labels = table(spark, "documents"), table(spark, "labels")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    known = [(r["doc_id"], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    model = cc.learn(docs, labels.filter(~cc.held_out(labels.doc_id)))

    def size(text, dictionary):
        held = zstandard.ZstdCompressionDict(dictionary)
        return sum(len(zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False, write_dict_id=False).compress(text[i : i + 256])) for i in range(0, len(text), 256))

    differ = {d: (size(t, model.bad) - size(t, model.good)) / (len(t) + 16) for d, t in texts.items()}
    rows = {r["doc_id"]: r["score"] for r in cc.classified(docs, labels).collect()}
    assert all(rows[d] == pytest.approx(1 / (1 + math.exp(-(model.slope * x + model.offset))), abs=1e-9) for d, x in differ.items())
    # The dictionaries come from every other text by the hash of its id; the rest fit the two numbers.
    order = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "xxhash64(doc_id) h").collect()}
    held = [[d for d, q in sorted(known, key=lambda k: order[k[0]]) if q == label][1::2] for label in (0, 1)]
    share = sum(q for _, q in known) / len(known)
    scale = (lambda v: math.sqrt(sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v)))([differ[d] for d in held[0] + held[1]])
    slopes = [0.0, 0.0]
    for label in (0, 1):
        weight = (share if label else 1 - share) * (len(held[0]) + len(held[1])) / len(held[label])
        for d in held[label]:
            p = 1 / (1 + math.exp(-(model.slope * differ[d] + model.offset)))
            slopes[0] += weight * (p - label) * differ[d] / scale
            slopes[1] += weight * (p - label)
    assert slopes[0] + 0.1 * model.slope * scale == pytest.approx(0, abs=1e-4) and slopes[1] + 0.1 * model.offset == pytest.approx(0, abs=1e-4)


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(cc, "fit", lambda good, bad, *a: seen.append((good, bad)) or cc.Model(b"", b"", 0.0, 0.0, 0.5))
    rows = [(i, "x" * 1000) for i in range(100)] + [(3, "w" * 1000)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    cc.learn(docs, labels, most_bytes=20_000, least=1)
    cc.learn(docs, labels, most_bytes=1, least=1)
    assert [sorted(map(len, x)) for x in seen[0]] == [[1000] * 10, [1000] * 10] and seen[1] == ([], [])
