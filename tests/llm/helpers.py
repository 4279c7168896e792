"""Fixtures and plain versions that the tests of this folder share."""

import random
import re

SF = "/root/testdata/sf0.01"
#: Null, empty, blank, no letters, one word, ties, repeated rows, non-ASCII, NUL, white space runs, a long text.
ODD = [None, "", "   \n\t ", "!!! ... ###", "word", "a b c", "a b c", "Été à la plage — 日本語 🎉", "nul\x00byte", "double  spaces \n\n and\r\ntabs\t", "ab " * 40_000]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_documents(spark, extra="extra string"):
    """ODD with ids, a null id, and columns of clashing names."""
    rows = [(i, t, "en", "s", "x") for i, t in enumerate(ODD)] + [(None, "null id", None, None, "x")]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {extra}")


def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def some_words(seed, n, vocabulary=300):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randint(0, vocabulary)}" for _ in range(n))
