import hashlib
import re

import duckdb
import pytest

from sparklog.llm import decontaminate as dc
from sparklog.llm.queries import op2_decontaminate, oracle_sql

from .helpers import SF, lower, no_documents, odd_documents, some_words, table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(docs, items, width=10):
    held = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            held.setdefault(tuple(w[k : k + width]), set()).add(str(item))
    sizes, out = {len(k) for k in held}, {}
    for doc, text in docs:
        w, hit, ids = WORD.findall(lower(text)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := held.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= found
        out[doc] = (len(w), len(hit), sorted(ids))
    return out


def test_query_against_brute_force(spark):
    want = brute([(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()], [tuple(r) for r in table(spark, "benchmark").collect()])
    rows = op2_decontaminate(spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        n, hit, ids = want[r["doc_id"]]
        assert tuple(r)[1:6] == (n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0)


def test_sql_against_brute_force():
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = brute(c.sql("select doc_id, text from documents").fetchall(), c.sql("select item_id, text from benchmark").fetchall())
    for doc, n, hit, items, _, contaminated in c.sql(oracle_sql()["op2_decontaminate"]).fetchall():
        assert (n, hit, items, contaminated) == (want[doc][0], want[doc][1], len(want[doc][2]), want[doc][1] > 0)


@pytest.mark.parametrize("most", [200_000, 40])
def test_short_items_overlaps_and_many_passes(spark, most):
    items = [(1, some_words(1, 30)), (2, "short One"), (3, None), (4, "..."), (5, some_words(1, 30)), (6, some_words(2, 12))]
    docs = [(1, f"x {some_words(1, 30)} y SHORT, one!"), (2, some_words(1, 12)), (3, "short one short one"), (4, None), (5, some_words(2, 11)), (6, "é " + some_words(2, 12))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = dc.contamination(df, spark.createDataFrame(items, "item_id long, text string"), max_windows=most, out="c")
    got = {r["doc_id"]: (r["c"]["n_words"], r["c"]["n_hit"], r["c"]["item_ids"]) for r in found.collect()}
    assert got == brute(docs, items)
    spans = {r["doc_id"]: [tuple(s) for s in r["c"]["spans"]] for r in found.collect()}
    text = docs[0][1]
    assert [text[a:b] for a, b in spans[1]] == [some_words(1, 30), "SHORT, one"] and spans[6] == [(2, len(docs[5][1]))]


def test_odd_rows(spark):
    docs = odd_documents(spark, "contamination string")
    items = spark.createDataFrame([(1, "a b c"), (None, "word")], "item_id long, text string")
    kept = dc.clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()} == {4, 5, 6}
    assert dc.clean_documents(docs, items.limit(0)).count() == docs.count()
    assert dc.clean_documents(no_documents(spark), items).count() == 0
