import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklog.llm import mixing
from sparklog.llm import topics as topic_model
from sparklog.llm.queries import op3_mixing

from .helpers import SF, no_documents, odd_documents, table


def brute(rows, powers=(0.5, 0.7, 0.7), keep=0.8):
    """Probabilities by plain raking over dictionaries: rows of (source, lang, topic, tokens)."""
    cells = {}
    for *key, n in rows:
        cells[tuple(key)] = cells.get(tuple(key), 0) + n
    total, mass = sum(cells.values()), {k: n / sum(cells.values()) for k, n in cells.items()}
    targets = []
    for d, p in enumerate(powers):
        seen = {}
        for k, m in mass.items():
            seen[k[d]] = seen.get(k[d], 0) + m
        raised = {c: m**p for c, m in seen.items() if m}
        targets.append({c: m / sum(raised.values()) for c, m in raised.items()})
    for _ in range(300):
        for d in range(3):
            now = {}
            for k, m in mass.items():
                now[k[d]] = now.get(k[d], 0) + m
            mass = {k: m * targets[d][k[d]] / now[k[d]] if m else 0 for k, m in mass.items()}
    weight = {k: mass[k] * total / n if n else 1 for k, n in cells.items()}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(1, mid * weight[k]) * n for k, n in cells.items()) < keep * total:
            low = mid
        else:
            high = mid
    return {k: min(1, low * w) for k, w in weight.items()}


def test_query_against_plain_raking(spark):
    rows = op3_mixing(spark, SF).collect()
    assert len(rows) == table(spark, "documents").count()
    texts = {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}
    assert all(r["mix_tokens"] == len(texts[r["doc_id"]].encode().split()) for r in rows)
    want = brute([(r["mix_source"], r["mix_lang"], r["mix_topic"], r["mix_tokens"]) for r in rows])
    for r in rows:
        assert r["mix_probability"] == pytest.approx(want[r["mix_source"], r["mix_lang"], r["mix_topic"]], rel=1e-5)
    total = sum(r["mix_tokens"] for r in rows)
    assert sum(r["mix_tokens"] * r["mix_probability"] for r in rows) == pytest.approx(0.8 * total)
    drawn = sum(r["sampled"] for r in rows)
    expected = sum(r["mix_probability"] for r in rows)
    assert abs(drawn - expected) < 4 * sum(r["mix_probability"] * (1 - r["mix_probability"]) for r in rows) ** 0.5 + 1
    assert all(r["sampled"] for r in rows if r["mix_probability"] == 1)


def test_marginals_meet_given_targets():
    keys = [(s, lang, "t") for s in "abc" for lang in ("en", "fr")]
    tokens = np.array([100.0, 50, 30, 80, 10, 40])
    weights = mixing.rake(keys, tokens, [{"a": 0.2, "b": 0.5, "c": 0.3}, {"en": 0.6, "fr": 0.4}, 1.0])
    mass = weights * tokens / tokens.sum()
    assert mass[:2].sum() == pytest.approx(0.2) and mass[2:4].sum() == pytest.approx(0.5) and mass[::2].sum() == pytest.approx(0.6)
    with pytest.raises(ValueError):
        mixing.rake(keys, tokens, [{"z": 1.0}, 1.0, 1.0])


def test_table_equals_driver(spark):
    docs = table(spark, "documents")
    a = {r["doc_id"]: r["mix_probability"] for r in mixing.with_probabilities(docs, rounds=3, lang={"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}).collect()}
    b = {r["doc_id"]: r["mix_probability"] for r in mixing.with_probabilities(docs, rounds=3, lang={"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, driver_cells=3).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12


def test_columns_of_the_cells_names_stay(spark):
    docs = spark.createDataFrame([(1, "one two", "en", "s", "a", "b", "c", "d")], "doc_id long, text string, lang string, source string, cell_mix_source string, CELL_mix_lang string, cell_mix_topic string, mix_found string")
    row = mixing.with_probabilities(docs, keep=1.0).first()
    assert (row["cell_mix_source"], row["CELL_mix_lang"], row["cell_mix_topic"], row["mix_found"], row["mix_probability"]) == ("a", "b", "c", "d", 1.0)
    assert mixing.mixed(docs, keep=1.0).collect() == docs.collect()


def test_targets_that_cannot_be_met_are_reported(spark):
    keys, tokens = [("a", "en", "t"), ("b", "fr", "t")], np.array([5.0, 5.0])
    with pytest.warns(UserWarning, match="not met"):
        mixing.rake(keys, tokens, [{"a": 0.5, "b": 0.5}, {"en": 0.9, "fr": 0.1}, 1.0])
    docs = spark.createDataFrame([(1, "x y", "en", "a"), (2, "x y", "fr", "b")], "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="not met"):
        mixing.with_probabilities(docs, topic=F.lit("t"), source={"a": 0.5, "b": 0.5}, lang={"en": 0.9, "fr": 0.1}, rounds=4, driver_cells=1).count()


def made(rnd, subject, lang, n):
    """A text of words of a subject, written otherwise in each language, among function words."""
    return " ".join(rnd.choice([f"{lang}{chr(97 + subject)}{chr(97 + rnd.randint(0, 25))}word", "the", "of", "a"]) for _ in range(n))


def plain_buckets(texts):
    """Content words by bucket, one byte at a time."""
    out = []
    for text in texts:
        counts = [0] * 64
        for w in re.findall("[A-Za-z\x80-\U0010ffff]+", text):
            low = bytes(b + 32 if 65 <= b <= 90 else b for b in w.encode())
            if len(low) >= 4:
                counts[(sum(int(topic_model.GEAR[b]) * int(topic_model.PLACES[i % 64]) for i, b in enumerate(low)) & 0xFFFFFFFF) >> 26] += 1
        out.append(counts)
    return out


def plain_topics(rows, topics=8, rounds=5):
    """k-means one document at a time over (text, lang)."""
    vectors = []
    for counts in plain_buckets([text for text, _ in rows]):
        length = math.sqrt(sum(counts))
        vectors.append([round(math.sqrt(c) * 127 / length) if length else 0 for c in counts])
    means = {}
    for lang in {lang for _, lang in rows}:
        own = [v for v, (_, x) in zip(vectors, rows, strict=True) if x == lang]
        means[lang] = [sum(c) / len(own) for c in zip(*own, strict=True)]
    moved = [[a - b for a, b in zip(v, means[lang], strict=True)] for v, (_, lang) in zip(vectors, rows, strict=True)]
    centers = (np.random.Generator(np.random.PCG64(20240301)).choice([-1.0, 1.0], (topics, 64)) / 8).tolist()
    pick = lambda m: max(range(topics), key=lambda k: (sum(a * b for a, b in zip(m, centers[k], strict=True)), -k))
    for _ in range(rounds):
        groups = [[] for _ in range(topics)]
        for v, m in zip(vectors, moved, strict=True):
            if any(v):
                groups[pick(m)].append(m)
        for k, group in enumerate(groups):
            total = [sum(c) for c in zip(*group, strict=True)] if group else [0.0]
            length = math.sqrt(sum(x * x for x in total))
            centers[k] = [x / length for x in total] if length else centers[k]
    return [f"t{pick(m)}" if any(v) else "none" for v, m in zip(vectors, moved, strict=True)]


def test_counts_of_words_in_blocks(monkeypatch):
    rnd = random.Random(2)
    texts = ["", "a", " \t\n", "Été à la plage 日本語", "x" * 300 + " it", "don't Stop-now 12ab34"] + [made(rnd, k, "q", rnd.randint(0, 300)).replace(" the", "\nThe,") for k in range(30)]
    data = [t.encode() for t in texts]
    tokens, buckets = topic_model.counted(data)
    assert tokens.tolist() == [len(t.split()) for t in data]
    want = plain_buckets(texts)
    assert buckets.tolist() == want
    monkeypatch.setattr(topic_model, "BLOCK", 50)
    assert topic_model.counted(data)[1].tolist() == want and topic_model.counted(data)[0].tolist() == tokens.tolist()


def test_topics_against_plain_clustering(spark):
    rnd = random.Random(6)
    rows = [(made(rnd, i % 4, "xy"[i % 2], rnd.randint(10, 60)), "xy"[i % 2]) for i in range(160)] + [("a of", "x"), ("", None)]
    df = spark.createDataFrame([(i, t, lang, "s") for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(7)
    got = {r["doc_id"]: r["mix_topic"] for r in mixing.with_probabilities(df).collect()}
    assert [got[i] for i in range(len(rows))] == plain_topics(rows)
    pure = 0  # the texts of a topic in a language are mostly of one subject
    for lang in "xy":
        for topic in set(got.values()):
            own = [i % 4 for i, (_, x) in enumerate(rows[:160]) if got[i] == topic and x == lang]
            pure += max(map(own.count, own), default=0)
    assert pure >= 0.85 * 160


def test_odd_rows(spark):
    docs = odd_documents(spark, "mix_source string, CELL_x string".replace(", CELL_x string", ""))
    found = mixing.mixed(docs, keep=1.0)
    assert found.columns == docs.columns and found.count() == docs.count()
    assert {r["mix_source"] for r in found.collect()} == {"x"}
    assert mixing.mixed(no_documents(spark)).count() == 0
    empty = docs.filter("text = ''")
    assert mixing.with_probabilities(empty).first()["mix_weight"] == 1.0
