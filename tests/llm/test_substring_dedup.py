import random
from collections import defaultdict

from sparklog.llm import substring_dedup as sd
from sparklog.llm.queries import op8_substring_dedup

from .helpers import SF, no_documents, odd_documents, some_words, table


def plain_cuts(data, least=16, most=96, bits=4):
    """Ends of chunks, one byte at a time: the gear hash is summed anew at each of them."""
    whole = lambda i: i == len(data) or data[i] & 0xC0 != 0x80
    out, start = [], 0
    for i in range(len(data)):
        end = i + 1
        h = sum(int(sd.GEAR[data[j]]) << (i - j) for j in range(max(0, i - 15), end)) & 0xFFFF
        if end - start > most:  # too long: cut before the character that does not fit
            cut = start + most
            while not whole(cut):
                cut -= 1
            out.append(cut)
            start = cut
        if whole(end) and end - start >= least and h >> (16 - bits) == 0:
            out.append(end)
            start = end
    while len(data) - start > most:
        start += most
        out.append(start)
    return out + [len(data)] * (start < len(data))


def test_cuts_against_a_plain_gear_hash():
    rnd = random.Random(2)
    texts = [some_words(k, 400) for k in range(5)] + ["é🎉日本 x" * 80, "x" * 700, "y", "ab " * 33]
    texts += ["".join(rnd.choices("abcdefgh é日\n", k=900)) for _ in range(10)]
    for text in texts:
        for options in ({}, {"least": 4, "most": 40, "bits": 2}):
            assert sd.cuts(text.encode(), **options) == plain_cuts(text.encode(), **options)


def pairs_of(text):
    """(start, middle, end, bytes) of pairs of adjoining chunks."""
    data = (text or "").encode()
    edges = [0, *plain_cuts(data)] if data else [0]
    return [(a, b, c, data[a:c]) for a, b, c in zip(edges, edges[1:], edges[2:], strict=False)]


def words_in(data, lo, hi):
    return sum(1 for i in range(lo, hi) if not data[i : i + 1].isspace() and (i == 0 or data[i - 1 : i].isspace()))


def plain(docs, min_words=24):
    """(start, end, {keeper: words}) of the spans of each document, by a dictionary of the pairs' bytes."""
    keeper = {}
    held = {doc: pairs_of(text) for doc, text in docs}
    for doc, pairs in held.items():
        for *_, c in pairs:
            keeper[c] = min(keeper.get(c, doc), doc)
    out = defaultdict(list)
    for doc, text in docs:
        data, runs = (text or "").encode(), []
        for a, b, c, own in held[doc]:
            if keeper[own] < doc:
                if runs and runs[-1][-1][1] == a:
                    runs[-1].append((a, b, c, keeper[own]))
                else:
                    runs.append([(a, b, c, keeper[own])])
        for run in runs:
            lo, hi = run[0][0], run[-1][2]
            if words_in(data, lo, hi) >= min_words:
                kept = defaultdict(set)
                for a, b, c, k in run:
                    kept[k] |= {(a, b), (b, c)}
                words = {k: sum(words_in(data, *part) for part in parts) for k, parts in kept.items()}
                out[doc].append((len(data[:lo].decode()), len(data[:hi].decode()), words))
    return dict(out)


def test_query_against_plain_version(spark):
    want = plain([(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()])
    rows = {r["doc_id"]: r for r in op8_substring_dedup(spark, SF).collect()}
    assert {d: [tuple(s) for s in r["spans"]] for d, r in rows.items()} == {d: [s[:2] for s in spans] for d, spans in want.items()}
    assert len(rows) > 50
    assert {d: [[tuple(k) for k in s] for s in r["span_keepers"]] for d, r in rows.items()} == {d: [sorted(s[2].items()) for s in spans] for d, spans in want.items()}
    for d, r in rows.items():
        ids = set()
        for *_, words in want[d]:
            small = {k for k, n in words.items() if n < 24}
            ids |= words.keys() - small if sum(words[k] for k in small) < 24 else words.keys()
        assert r["keepers"] == sorted(ids)


def test_reported_spans_are_in_other_documents(spark):
    """All but few spans stand as a whole in one other document; the rest are put together from several."""
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, "documents").collect()}
    spans = [(r["doc_id"], texts[r["doc_id"]][s["start"] : s["end"]]) for r in op8_substring_dedup(spark, SF).collect() for s in r["spans"]]
    whole = sum(any(span in t for d, t in texts.items() if d < doc) for doc, span in spans)
    assert whole / len(spans) >= 0.9


def test_chance_holder_does_not_hide_the_first_holder(spark):
    passage = some_words(1, 70, 9999)
    edge = sd.cuts(passage.encode())[2]  # a document that has the first two pairs only
    docs = [(1, passage[:edge]), (2, passage), (3, passage), (4, passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r for r in sd.repeated_documents(df).collect()}
    assert {doc: r["keepers"] for doc, r in found.items()} == {3: [2], 4: [2]}
    assert all([k["keeper"] for k in r["span_keepers"][0]] == [1, 2] for r in found.values())
    assert all(r["n_words"] == 70 for r in found.values())


def test_common_chunks_in_another_order_make_no_span(spark):
    passage = some_words(1, 90, 9999)
    ends = sd.cuts(passage.encode())
    pieces = [passage[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    df = spark.createDataFrame([(1, passage), (2, " and then ".join(pieces[::2])), (3, " or else ".join(pieces[::-1]))], "doc_id long, text string")
    assert sd.repeated_documents(df).count() == 0


def test_planted_passages(spark):
    passage = some_words(1, 55, 9999)
    docs = [(i, f"{some_words(100 + i, 80, 9999)} {passage if i % 2 else some_words(500 + i, 55, 9999)} {some_words(200 + i, 3 * i, 9999)}") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r for r in sd.repeated_documents(df).collect()}
    assert set(found) == {i for i in range(3, 40) if i % 2}
    assert all(r["keepers"] == [1] for r in found.values())
    texts = {r["doc_id"]: r["text"] for r in sd.without_repeats(df).collect()}
    assert all(texts[i] == t for i, t in docs if i not in found)
    assert all(len(texts[i]) < len(t) - 100 and texts[i] in _cuts(t, found[i]["spans"]) for i, t in docs if i in found)


def _cuts(text, spans):
    for a, b in reversed(spans):
        text = text[:a] + text[b:]
    return [text]


def test_insertions_shift_little():
    text = some_words(3, 3000, 9999).encode()
    a = {text[x:y] for x, y in zip([0, *sd.cuts(text)], sd.cuts(text), strict=False)}
    moved = text[:5000] + b"inserted" + text[5000:]
    b = {moved[x:y] for x, y in zip([0, *sd.cuts(moved)], sd.cuts(moved), strict=False)}
    assert len(a - b) <= 4


def test_cuts_cover_the_text_and_split_no_character():
    for text in ("é🎉日" * 500, "a", "x" * 1000, "", some_words(4, 200)):
        data = text.encode()
        ends = sd.cuts(data) if data else []
        assert (ends[-1] if ends else 0) == len(data)
        pieces = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        assert "".join(p.decode() for p in pieces) == text
        assert all(len(p) <= 96 for p in pieces)


def test_odd_rows(spark):
    docs = odd_documents(spark, "span_doc string")
    assert sd.repeated_documents(docs).count() == 0
    same = sd.without_repeats(docs)
    assert same.columns == docs.columns and sorted(map(repr, same.collect())) == sorted(map(repr, docs.collect()))
    assert sd.repeated_documents(no_documents(spark)).count() == 0
    whole = some_words(5, 90, 9999)
    df = spark.createDataFrame([(1, whole), (2, whole), (2, whole), (None, whole)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in sd.without_repeats(df).collect()) == [(0, whole), (1, whole), (2, ""), (2, "")]
