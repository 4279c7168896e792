import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklog.llm import quality_rules as q
from sparklog.llm.queries import op6_quality_rules

from .helpers import SF, no_documents, odd_documents, table


def plain_base(text):
    text = text or ""
    words, current = [], ""
    for ch in text + " ":
        if ch in " \t\n\x0b\x0c\r":
            if current:
                words.append(current)
            current = ""
        else:
            current += ch
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n


@pytest.fixture(scope="module")
def rows(spark):
    return {r["doc_id"]: r for r in op6_quality_rules(spark, SF).collect()}


def test_base_against_plain_version(spark, rows):
    docs = table(spark, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        assert tuple(rows[d["doc_id"]])[1:7] == plain_base(d["text"])
        assert not (rows[d["doc_id"]]["base_failed"] and rows[d["doc_id"]]["kept"])


def test_verdicts_against_labels(spark, rows):
    labels = [(rows[r["doc_id"]], r["quality"]) for r in table(spark, "labels").collect()]
    judged = [(r, y) for r, y in labels if not r["base_failed"]]
    good = [r["kept"] for r, y in judged if y == 1]
    bad = [r["kept"] for r, y in judged if y == 0]
    assert sum(good) / len(good) >= 0.99
    assert sum(bad) / len(bad) <= 0.2


def plain_histograms(text):
    """Shares of character classes and of common words, one character and one word at a time."""
    classes = [0] * 13
    for ch in text:
        classes[next((k for k, c in enumerate(q.CLASSES) if ch in c), 11 if ord(ch) < 128 else 12)] += 1
    known = sorted({w for words in q.COMMON.values() for w in words}, key=lambda w: w.encode())
    words = [0] * (len(known) + 1)
    plain = "".join(ch.lower() if ch.isascii() and ch.isalpha() else ch if not ch.isascii() or ch.isalnum() or ch == "'" else " " for ch in text)
    for w in re.split("[ \t\n\x0b\x0c\r]+", plain):
        if w:
            words[known.index(w) if w in known else -1] += 1
    return [x / max(1, sum(classes)) for x in classes], [x / max(1, sum(words)) for x in words]


def plain_distance(p, ref):
    out = 0.0
    for a, b in zip(p, ref, strict=True):
        m = (a + b) / 2
        out += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(0.0, out / 2))


def test_verdicts_against_plain_version(spark, rows):
    docs = table(spark, "documents").collect()
    plain = {d["doc_id"]: plain_histograms(d["text"]) for d in docs if not rows[d["doc_id"]]["base_failed"]}
    refs = {}
    for lang in {d["lang"] for d in docs if d["doc_id"] in plain}:
        own = [plain[d["doc_id"]] for d in docs if d["lang"] == lang and d["doc_id"] in plain]
        refs[lang] = [[sum(x) / len(own) for x in zip(*(h[part] for h in own), strict=True)] for part in (0, 1)]
    judged = 0
    for d in docs:
        r = rows[d["doc_id"]]
        n, letters = r["n_words"], r["word_chars"]
        if r["base_failed"] or n < 60 or letters < 200:
            assert (r["class_distance"], r["word_distance"], r["kept"]) == (None, None, not r["base_failed"])
            continue
        judged += 1
        classes, words = min(([plain_distance(plain[d["doc_id"]][k], ref[k]) for k in (0, 1)] for ref in refs.values()), key=sum)
        assert (r["class_distance"], r["word_distance"]) == (pytest.approx(classes, abs=1e-9), pytest.approx(words, abs=1e-9))
        noise = 1 / math.sqrt(n)
        assert r["kept"] == (classes <= 0.14 + noise and words <= 0.33 + noise and classes + words <= 0.38 + 1.2 * noise)
    assert judged > 100


def test_one_language_counts_for_both_distances(spark):
    docs = table(spark, "documents")
    held = q.references(docs)
    fixed = np.array(list(held.values()))
    german = next(r["text"] for r in docs.filter("lang = 'de' and n_chars > 2000").collect()).encode()
    english = next(r["text"] for r in docs.filter("lang = 'en' and n_chars > 2000").collect()).encode()
    mixed = b" ".join(w for pair in zip(english.split(), [b"der", b"die", b"und", b"nicht", b"ist"] * 400, strict=False) for w in pair)
    apart = min(q.distance(q.histograms(mixed)[0], fixed[:, :13])) + min(q.distance(q.histograms(mixed)[1], fixed[:, 13:]))
    assert sum(q.distances(mixed, fixed)) > apart
    assert q.distances(german, fixed) != q.distances(english, fixed)


def test_other_labels_are_judged_as_well(spark, rows):
    docs = table(spark, "documents")
    given = q.references(docs)
    forms = F.create_map(*[F.lit(x) for pair in {"en": "EN", "de": " de-AT", "fr": "unknown", "es": ""}.items() for x in pair])
    for lang in (forms[F.col("lang")], F.lit("it"), F.lit(None).cast("string")):
        found = q.quality(docs.withColumn("lang", lang), given=given).collect()
        assert all(r["quality"]["kept"] == rows[r["doc_id"]]["kept"] for r in found)
    again = q.references(docs.withColumn("lang", F.upper("lang")))
    assert set(again) == set(given) and all(again[k] == pytest.approx(given[k]) for k in given)


def test_frequent_labels_get_a_reference(spark):
    docs = table(spark, "documents").withColumn("lang", F.when(F.col("lang") == "fr", "oc-FR").when(F.col("doc_id") % 50 == 0, "rare").otherwise(F.col("lang")))
    n = docs.filter("lang = 'oc-FR'").count()
    assert q.referenced(docs, own_reference=n) == [*q.COMMON, "oc"]
    assert "oc" in q.references(docs, own_reference=n) and "oc" not in q.references(docs, own_reference=n + 1)


def test_odd_rows(spark):
    docs = odd_documents(spark, "quality string")
    found = q.quality(docs, out="found").collect()
    assert len(found) == docs.count()
    for r in found:
        assert tuple(r["found"])[:6] == plain_base(r["text"])
    assert q.kept_documents(docs).columns == docs.columns
    assert q.kept_documents(no_documents(spark)).count() == 0
    unlisted = spark.createDataFrame([(1, " ".join(f"x{i}" for i in range(99)), "xx")], "doc_id long, text string, lang string")
    assert q.kept_documents(unlisted).count() == 1  # there is no reference at all
    assert q.kept_documents(unlisted, given=q.references(table(spark, "documents"))).count() == 0
