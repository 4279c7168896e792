import random

import pytest
from tokenizers import Tokenizer, models

from sparklog.llm import token_counts as tc
from sparklog.llm.queries import op9_token_counts, tokenizer_file

from .helpers import ODD, SF, no_documents, odd_documents, table

PATH = tokenizer_file("piece_bpe_32k.model")


def reference(pieces, unknown, fallback):
    t = Tokenizer(models.Unigram(pieces, unk_id=unknown, byte_fallback=fallback))
    return lambda text: sum(len(x.ids) for x in t.encode_batch([tc.START + w.decode() for w in (text or "").encode().split()], add_special_tokens=False))


def test_query_against_the_library(spark):
    count = reference(*tc.vocabulary(PATH))
    docs = {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}
    rows = op9_token_counts(spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r["n_tokens"] == count(docs[r["doc_id"]]) for r in rows)


@pytest.mark.parametrize("fallback", [True, False])
def test_ties_unknowns_and_long_words(fallback):
    pieces, unknown, _ = tc.vocabulary(PATH)
    rnd = random.Random(3)
    tied = [("<unk>", 0.0), (tc.START, -1.0), *[(p, float(-rnd.randint(1, 3))) for p in {"".join(rnd.choices("abc", k=rnd.randint(1, 4))) for _ in range(60)}]]
    for vocabulary, u, letters in ((pieces, unknown, "abéñ日🎉\x00<s>▁.,thein☃"), (tied, 0, "abcd")):
        if vocabulary is tied and fallback:
            continue
        count, own = reference(vocabulary, u, fallback), tc.Counter(vocabulary, fallback)
        for n in [1, 2, 3, 5, 8, 13, 400] * 100:
            word = "".join(rnd.choices(letters, k=n))
            assert own.count(word) == count(word) or word.split() != [word]


def test_odd_rows(spark):
    count = reference(*tc.vocabulary(PATH))
    docs = odd_documents(spark, "n_tokens string")
    found = tc.token_counts(docs, PATH, out="n")
    assert {r["doc_id"]: r["n"] for r in found.filter("doc_id is not null").collect()} == {i: count(t) for i, t in enumerate(ODD)}
    assert tc.token_counts(docs, PATH).columns == docs.columns
    assert tc.token_counts(no_documents(spark), PATH).count() == 0
