"""Secret scan in DataFrame functions only: fixed patterns, and a randomness test battery on other tokens.

Spans are code points, ends exclusive. Positions come from splitting a text at a pattern: the pieces between matches
and the matches themselves, summed up.

Kinds `assign`, `access` and `hex` are fixed patterns (PATTERNS). Kind `random` is the method: runs of 20 or more
base-64 characters, with a letter and a digit, that touch none of the fixed spans. Each gets the smallest encoding that
fits (hex, base 32, 36, 62, 64) and is put to a battery of tests of "its characters are independent and uniform over
that alphabet":

* chi-squared over equal ranges of the alphabet, as many as give 5 expected characters a range (Wilson-Hilferty),
* Wald-Wolfowitz runs above and below the alphabet's middle,
* lag-1 serial correlation.

Fisher's method combines the three p-values. The likelihood ratio of that model against one of written tokens (characters
mostly stay in their class, lower, upper, digit or other) grows with the length; times the battery's p-value, which is 1
at most, it still has a mean of 1 at most over written tokens, so it is an e-value against "written" in which both the
length and all three tests count. The Benjamini-Hochberg procedure for e-values over a document's tokens keeps the
expected share of false reports under `fdr`. A token that a single test rejects (Bonferroni over the three at `reject`)
is not reported whatever its length.

Null and empty texts have no spans. Repeated rows get equal results. Other columns pass through; a column of the name
`out` is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm import common

# The patterns. A run of hex digits or key characters is maximal, so a least length can stand in them.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
KINDS = [*PATTERNS, "random"]
#: A noncharacter in place of those of `assign` spans. Runs go on through it, so that what touches such a span is seen to.
MASK = "\uffff"
TOKEN = rf"[A-Za-z0-9+/_{MASK}-]{{20,}}={{0,2}}"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Pattern that a token must fit, and the alphabet; the first that fits counts.
ENCODINGS = [("^[0-9a-f]+$", DIGITS + "abcdef"), ("^[0-9A-F]+$", DIGITS + "ABCDEF"), ("^[A-Z2-7]+$", UPPER + "234567"), ("^[a-z0-9]+$", DIGITS + LOWER), ("^[A-Z0-9]+$", DIGITS + UPPER), ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS), ("^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"), ("", UPPER + LOWER + DIGITS + "-_+/")]
#: A written token's characters: chance to stay in the class, to go to each other one, and of a character in its class.
STAY, LEAVE = 0.91, 0.03
IN_CLASS = {0: 1 / 26, 1: 1 / 26, 2: 1 / 10, 3: 1 / 4}


def running_sum(values: Column) -> Column:
    """Running sums of an array of longs, in about n ** 1.5 steps."""
    zero = F.array(F.lit(0).cast("long"))
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values)))).cast("int")

    def run(part: Column, start: Column) -> Column:
        sums = F.aggregate(part, F.array(start), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
        return F.slice(sums, F.lit(2), F.size(part))

    def cut(i: Column) -> Column:
        return F.slice(values, i * width + 1, width)

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / width).cast("int")), cut)
    starts = F.aggregate(parts, zero, lambda acc, part: F.array_append(acc, F.element_at(acc, -1) + F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)))
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), run))).otherwise(F.array().cast("array<long>"))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17), for z of 0 or more."""
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series


def _places(df: DataFrame, text: str, kind: str, pattern: str, group: int = 0, least: int = 0, masked: str | None = None) -> DataFrame:
    """Add a column `kind`: array of struct(start, end, token) of the pattern's matches with a token (the given group) of
    `least` characters; masked: a column to add, the text with each character of these matches replaced by MASK."""
    regex, empty = F.lit(pattern), F.array().cast("array<string>")
    cut, token, length, end = (common.free_name(df, f"{kind}_{x}") for x in ("cut", "token", "len", "end"))
    df = df.withColumn(kind, F.regexp_extract_all(F.col(text), regex, F.lit(0)))
    found = F.size(kind) > 0
    df = df.withColumn(cut, F.when(found, F.split(F.col(text), pattern, -1)).otherwise(empty))
    df = df.withColumn(token, F.when(found, F.regexp_extract_all(F.col(text), regex, F.lit(group))).otherwise(empty) if group else F.col(kind))
    if masked:
        kept = F.zip_with(F.col(kind), F.col(token), lambda m, t: F.when(F.char_length(t) >= least, F.repeat(F.lit(MASK), F.char_length(m))).otherwise(m))
        pieces = F.zip_with(F.col(cut), kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))  # after the last match a piece follows
        df = df.withColumn(masked, F.when(found, F.array_join(pieces, "")).otherwise(F.col(text)))
    df = df.withColumn(length, F.zip_with(F.slice(cut, F.lit(1), F.size(kind)), F.col(kind), lambda a, b: (F.char_length(a) + F.char_length(b)).cast("long")))
    df = df.withColumn(end, running_sum(F.col(length)))
    span = F.transform(
        F.arrays_zip(F.col(end).alias("end"), F.col(kind).alias("match"), F.col(token).alias("token")),
        lambda x: F.struct((x["end"] - F.char_length(x["match"])).alias("start"), x["end"].alias("end"), x["token"].alias("token")),
    )
    return df.withColumn(kind, F.filter(span, lambda x: F.char_length(x["token"]) >= least)).drop(cut, token, length, end)


def _with_encoding(x: Column) -> Column:
    token = F.rtrim(x["token"], F.lit("="))
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in ENCODINGS[-2::-1]:
        alphabet = F.when(token.rlike(pattern), letters).otherwise(alphabet)
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), token.alias("token"), alphabet.alias("alphabet"))


def _with_numbers(x: Column) -> Column:
    """n, k, the place of each character in the alphabet, and its class."""
    chars = F.split(x["token"], "")
    numbers = F.transform(chars, lambda c: F.call_function("locate", c, x["alphabet"]) - 1)
    classes = F.transform(chars, lambda c: F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3))
    k = F.char_length(x["alphabet"])
    n = F.char_length(x["token"])
    cells = F.greatest(F.lit(2), F.least(k, F.floor(n / 5).cast("int")))
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), n.alias("n"), k.alias("k"), cells.alias("cells"), numbers.alias("x"), classes.alias("c"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _count(values: Column, value: int) -> Column:
    return F.size(F.filter(values, lambda v: v == value))


def _with_moments(x: Column) -> Column:
    n, k, cells = x["n"], x["k"], x["cells"]
    high = F.size(F.filter(x["x"], lambda v: v * 2 >= k))
    pairs = F.zip_with(F.slice(x["x"], F.lit(1), n - 1), F.slice(x["x"], F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    turns = F.size(F.filter(pairs, lambda p: (p["a"] * 2 >= k) != (p["b"] * 2 >= k)))
    mean = _sum(F.transform(x["x"], lambda v: v.cast("double"))) / n
    counts = F.transform(F.sequence(F.lit(0), cells - 1), lambda j: F.size(F.filter(x["x"], lambda v: F.floor(v * cells / k) == j)))
    # A cell's share of the alphabet: whole places between its edges.
    share = F.transform(F.sequence(F.lit(0), cells - 1), lambda j: (F.ceil((j + 1) * k / cells) - F.ceil(j * k / cells)) / k)
    chi = _sum(F.zip_with(counts, share, lambda o, s: (o - n * s) * (o - n * s) / (n * s)))
    moves = F.size(F.filter(F.zip_with(F.slice(x["c"], F.lit(1), n - 1), F.slice(x["c"], F.lit(2), n - 1), lambda a, b: a != b), lambda d: d))
    within = F.lit(0.0)
    for c, p in IN_CLASS.items():
        within = within + _count(x["c"], c) * math.log(p)
    written = within + math.log(0.25) + moves * math.log(LEAVE) + (n - 1 - moves) * math.log(STAY)
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), n.alias("n"), cells.alias("cells"), high.alias("high"), (turns + 1).alias("runs"), mean.alias("mean"), chi.alias("chi"), (-n * F.ln(k) - written).alias("log_e"), x["x"].alias("x"))


def _with_tests(x: Column) -> Column:
    n, high = x["n"].cast("double"), x["high"].cast("double")
    df = (x["cells"] - 1).cast("double")
    z = (F.pow(x["chi"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    chi = F.when(z > 0, _tail(z)).otherwise(0.5)
    expected = 2 * high * (n - high) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    runs = F.when(spread > 0, 2 * _tail(F.abs(x["runs"] - expected) / F.sqrt(F.greatest(spread, F.lit(1e-9))))).otherwise(0.0)
    mean = x["mean"]
    square = _sum(F.transform(x["x"], lambda v: (v - mean) * (v - mean)))
    product = _sum(F.zip_with(F.slice(x["x"], F.lit(1), x["n"] - 1), F.slice(x["x"], F.lit(2), x["n"] - 1), lambda a, b: (a - mean) * (b - mean)))
    serial = F.when(square > 0, 2 * _tail(F.abs(product / F.greatest(square, F.lit(1e-9)) * F.sqrt(n) + 1 / F.sqrt(n)))).otherwise(0.0)
    # Fisher: minus twice the sum of the logarithms has a chi-squared distribution of 6 degrees of freedom.
    half = -(F.ln(F.greatest(chi, F.lit(1e-99))) + F.ln(F.greatest(runs, F.lit(1e-99))) + F.ln(F.greatest(serial, F.lit(1e-99))))
    battery = F.exp(-half) * (1 + half + half * half / 2)
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.least(F.lit(1.0), 3 * F.least(chi, runs, serial)).alias("p_random"), F.least(F.lit(1.0), battery).alias("p_battery"),
        F.least(F.lit(1.0), F.exp(-x["log_e"]) / F.greatest(F.least(F.lit(1.0), battery), F.lit(1e-99))).alias("p_written"),
    )


def _as_kind(found: Column, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), x["end"].alias("end")))


def secrets(docs: DataFrame, *, text_col: str = "text", out: str = "secrets", fdr: float = 0.01, reject: float = 0.001) -> DataFrame:
    """docs with a column `out`: array of struct(start, rank, kind, end), by start and then kind as in KINDS."""
    work = docs.withColumn(out, F.lit(None)) if out in docs.columns else docs
    text, masked = common.free_name(docs, "scanned_text"), common.free_name(docs, "masked_text")
    held = {kind: common.free_name(docs, f"found_{kind}") for kind in KINDS}
    df = work.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    df = _places(df, text, held["assign"], PATTERNS["assign"], 2, 6, masked)
    df = _places(df, text, held["access"], PATTERNS["access"])
    df = _places(df, text, held["hex"], PATTERNS["hex"])
    df = _places(df, masked, held["random"], TOKEN)
    r = held["random"]
    # Runs are maximal, so an access or hex span that touches one lies inside it.
    fixed = "|".join([MASK, PATTERNS["access"], PATTERNS["hex"]])
    df = df.withColumn(r, F.filter(r, lambda x: x["token"].rlike("[0-9]") & x["token"].rlike("[A-Za-z]") & ~x["token"].rlike(fixed)))
    for step in (_with_encoding, _with_numbers, _with_moments, _with_tests):
        df = df.withColumn(r, F.transform(r, step))
    sorted_p = common.free_name(docs, "sorted_p")
    df = df.withColumn(sorted_p, F.sort_array(F.transform(r, lambda x: x["p_written"])))
    good = F.filter(F.transform(sorted_p, lambda p, i: F.when(p * F.size(sorted_p) <= (i + 1) * fdr, p)), lambda p: p.isNotNull())
    df = df.withColumn(sorted_p, F.coalesce(F.array_max(good), F.lit(-1.0)))
    df = df.withColumn(r, F.filter(r, lambda x: (x["p_written"] <= F.col(sorted_p)) & (x["p_random"] >= reject)))
    spans = [_as_kind(F.col(held[kind]), k) for k, kind in enumerate(KINDS)]
    return df.withColumn(out, F.sort_array(F.concat(*spans))).drop(text, masked, sorted_p, *held.values())


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
