"""Quality rules by distribution divergence: histograms of character classes and common words against references.

A reference is the mean histogram of a language's documents that pass the base rules, from all documents: one small row
for each language of COMMON and for each other label that `own_reference` documents have (the MOST_LANGUAGES most
frequent of them). A document is compared with each reference by the Jensen-Shannon distance (square root of the
divergence in bits, 0 to 1), and the language whose two distances have the least sum counts for both: its label does not
matter, nor whether it has one. Labels count without case, blanks around and region ('EN', 'en-US'); those of NO_LABEL
count as null. A document is rejected if the distance of character classes or of common words is over its limit plus
`slack` / sqrt(words), the noise of a short text, or their sum over `joint_limit` plus `joint_slack` / sqrt(words).
Under `min_words` words, in fewer than `min_letters` characters of words, or without any reference, the method gives no
verdict and only the base rules count.

Null counts as an empty text: all counts 0, base rule failed, not kept. Repeated rows get equal verdicts. Other columns
pass through; a column of the name `out` is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm import common

# Frequent function words by language.
COMMON = {
    "en": "the of and to in is that for it was on are as with by at be this from or an a have not which but they his you were their has we been more can will there all one would".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux d'un cette ont ses mais comme on tout nous sa fait été".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos".split(),
}
MOST_LANGUAGES = 64
NO_LABEL = ("", "none", "null", "und", "unk", "unknown", "n/a")
WORDS = {w.encode(): k for k, w in enumerate(sorted({w for words in COMMON.values() for w in words}))}
CLASSES = ("aeiou", "nrstld", "bcfghjkmpqvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\t\r\f\v", ".,", "!?", "|<>#*$%&", "'\"()-:;")
#: Class of a byte: 11 other ASCII, 12 the first byte of another character, 13 its further bytes (not counted).
CLASS_OF = np.array([next((k for k, c in enumerate(CLASSES) if chr(b) in c), 11) if b < 128 else 13 if b < 192 else 12 for b in range(256)], np.uint8)
SYMBOLS = b"#*$%&|<>"
LETTERS = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not (chr(b).isalnum() or chr(b) == "'") else b for b in range(256))
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    inside = np.zeros(len(words), bool)
    often = np.array([counts[w] > 1 for w in windows])
    for k in range(3):
        inside[k : k + len(often)] |= often
    return int(inside.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text.decode()) - (len(text) - sum(map(len, words)))
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def histograms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shares of character classes, and of common words with all other words last."""
    classes = np.bincount(CLASS_OF[np.frombuffer(text, np.uint8)], minlength=14)[:13].astype(float)
    found = Counter(map(WORDS.get, text.translate(LETTERS).split()))
    words = np.zeros(len(WORDS) + 1)
    for k, n in found.items():
        words[-1 if k is None else k] += n
    return classes / max(1.0, classes.sum()), words / max(1.0, words.sum())


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of p from each row of q."""
    mean = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / mean), 0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / mean), 0).sum(axis=-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def distances(text: bytes, fixed: np.ndarray) -> tuple[float, float]:
    """Distances of classes and of words from the reference (rows of `fixed`) with the least sum of both."""
    c, w = histograms(text)
    classes, words = distance(c, fixed[:, :13]), distance(w, fixed[:, 13:])
    nearest = int((classes + words).argmin())
    return float(classes[nearest]), float(words[nearest])


def label(lang: Column) -> Column:
    """A language label as COMMON has it; null if it names none."""
    plain = F.lower(F.trim(lang.cast("string")))
    return F.when(~plain.isin(*NO_LABEL), F.element_at(F.split(plain, "[-_]"), 1))


def referenced(docs: DataFrame, lang_col: str = "lang", own_reference: int = 1000) -> list[str]:
    """Labels that get a reference: those of COMMON, and the most frequent others of `own_reference` documents or more."""
    counts = docs.select(label(F.col(lang_col)).alias("lang")).filter(F.col("lang").isNotNull() & ~F.col("lang").isin(*COMMON)).groupBy("lang").count().filter(F.col("count") >= own_reference)
    return [*COMMON, *(r["lang"] for r in counts.orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect())]


def references(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", own_reference: int = 1000) -> dict[str, list[float]]:
    """Mean histogram of each referenced language over its documents that pass the base rules; one row a task and language is shuffled."""
    size = 13 + len(WORDS) + 1
    names = referenced(docs, lang_col, own_reference)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {lang: np.zeros(size + 1) for lang in names}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), common.byte_texts(batch.column(1)), strict=True):
                words = text.split()
                if not base_failed(len(words), repeat_words(words)):
                    sums[lang] += np.concatenate((*histograms(text), [1.0]))
        kept = [k for k, x in sums.items() if x[-1]]
        yield pa.RecordBatch.from_pydict({"lang": pa.array(kept, pa.string()), "sums": pa.array([sums[k].tolist() for k in kept], pa.list_(pa.float64()))})

    listed = docs.select(label(F.col(lang_col)).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isin(names))
    total = listed.mapInArrow(gather, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    found = {lang: np.zeros(size + 1) for lang in names}
    for row in total.collect():  # referenced languages x histogram cells at most
        found[row["lang"]][row["k"]] = row["x"]
    return {k: (x[:-1] / x[-1]).tolist() for k, x in found.items() if x[-1]}


def quality(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", class_limit: float = 0.14, word_limit: float = 0.33, slack: float = 1.0, joint_limit: float = 0.38, joint_slack: float = 1.2, min_words: int = 60, min_letters: int = 200, own_reference: int = 1000, out: str = "quality", given: dict[str, list[float]] | None = None
) -> DataFrame:
    """docs with a struct column `out` (RESULT); given: references to use instead of those of docs."""
    held = references(docs, text_col=text_col, lang_col=lang_col, own_reference=own_reference) if given is None else given
    fixed = np.array(list(held.values())).reshape(len(held), 13 + len(WORDS) + 1)

    @F.arrow_udf(RESULT)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        for texts in batches:
            rows = []
            for text in common.byte_texts(texts):
                counts = base_counts(text)
                failed = base_failed(counts[0], counts[4])
                classes = words = None
                kept = not failed
                if kept and counts[0] >= min_words and counts[1] >= min_letters and len(fixed):
                    classes, words = distances(text, fixed)
                    noise = counts[0] ** -0.5
                    kept = classes <= class_limit + slack * noise and words <= word_limit + slack * noise and classes + words <= joint_limit + joint_slack * noise
                rows.append((*counts, failed, classes, words, kept))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.StructArray.from_arrays(columns, names)

    return docs.withColumn(out, judge(F.col(text_col)))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, columns as they were."""
    out = common.free_name(docs, "quality")
    return quality(docs, out=out, **options).filter(F.col(f"{out}.kept")).drop(out)
