"""Benchmark decontamination with one Aho-Corasick automaton over the windows of all test items.

Texts are normalised by lower-casing A-Z and cutting at every ASCII character but digits and letters; a window is
`width` consecutive words of an item (a shorter item, with a word, is one window). The automaton's alphabet is the
items' words, so a text is scanned once, word by word; hit words are mapped back to spans of the original text.

The items of one automaton are bounded by `max_windows` (about 0.7 kB each); more items are scanned in as many passes,
each over all documents and written to the shared folder, with the same result. Documents are not shuffled.

Null or word-less texts have no words and no hits; null items and items without words hit nothing. Repeated items and
items that share an id count once. An empty item table leaves all documents clean. Other columns pass through; a
column of the name `out` is replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm import common

#: A-Z to a-z, other separators to spaces; bytes of non-ASCII characters belong to words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
RESULT = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>, hits array<long>"
STRUCT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("hits", pa.list_(pa.int64()))])


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def windows(items: list[tuple[str, bytes]], width: int) -> dict[tuple[bytes, ...], set[str]]:
    """Each window with the ids of the items that hold it."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            found[tuple(w[i : i + width])].add(item)
    return found


class Scanner:
    """The automaton over word numbers; 0 stands for words that no item has."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        import ahocorasick

        held = windows(items, width)
        self.number = {w: k for k, w in enumerate(sorted({w for window in held for w in window}), 1)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if held else None
        for window, ids in held.items():
            self.automaton.add_word(tuple(self.number[w] for w in window), (len(window), sorted(ids)))
        if held:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[int], set[str]]:
        """Words, hit intervals as a flat list (start, end, start, ...; merged, ends exclusive), ids of hit items."""
        w = words(text)
        flat: list[int] = []
        ids: set[str] = set()
        if self.automaton is None or not w:
            return len(w), flat, ids
        get = self.number.get
        found = list(self.automaton.iter(tuple([get(x, 0) for x in w])))
        for start, end in sorted((end + 1 - n, end + 1) for end, (n, _) in found):
            if flat and start <= flat[-1]:
                flat[-1] = max(flat[-1], end)
            else:
                flat += [start, end]
        for _, (_, some) in found:
            ids.update(some)
        return len(w), flat, ids


def merged(a: list[int], b: list[int]) -> list[int]:
    flat: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if flat and start <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += [start, end]
    return flat


def original_spans(text: str, flat: list[int]) -> list[dict[str, int]]:
    """Hit intervals as code point spans of the text, first word's start to last word's end."""
    if not flat:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(flat[::2], flat[1::2])]


SCANNERS: dict[str, Scanner] = {}


def scanner_of(key: str, items: list[tuple[str, bytes]], width: int) -> Scanner:
    """The process's automaton: Spark's Python workers keep the last one from task to task."""
    if key not in SCANNERS:
        SCANNERS.clear()
        SCANNERS[key] = Scanner(items, width)
    return SCANNERS[key]


def _scan_with(items: list[tuple[str, bytes]], width: int):
    key = hashlib.sha256(repr((sorted(items), width)).encode()).hexdigest()

    def result(text: bytes, scanner: Scanner, before: dict | None) -> dict:
        n, flat, ids = scanner.scan(text)
        if before and before["hits"]:
            flat = merged(flat, before["hits"])
            ids = ids | set(before["item_ids"])
        n_hit = sum(flat[1::2]) - sum(flat[::2])
        return {"n_words": n, "n_hit": n_hit, "item_ids": sorted(ids), "spans": original_spans(text.decode(), flat) if flat else [], "hits": flat}

    @F.arrow_udf(RESULT)
    def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = scanner_of(key, items, width)
        for texts in batches:
            yield pa.array([result(t, scanner, None) for t in common.byte_texts(texts)], STRUCT)

    @F.arrow_udf(RESULT)
    def later(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scanner = scanner_of(key, items, width)
        for texts, before in batches:
            yield pa.array([result(t, scanner, b) for t, b in zip(common.byte_texts(texts), before.to_pylist(), strict=True)], STRUCT)

    return first, later


def contamination(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = 10, max_windows: int = 200_000, out: str = "contamination") -> DataFrame:
    """docs with a struct column `out`: n_words, n_hit, item_ids (sorted strings), spans (code points), hits (word intervals)."""
    item = items.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    # A window starts at a word, and a word takes two bytes with its separator.
    most = item.agg(F.coalesce(F.sum((F.octet_length("text") / 2 + 1).cast("long")), F.lit(0))).first()[0]
    if most > max_windows:
        most = item.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))), F.lit(0))).first()[0]
    passes = max(1, math.ceil(most / max_windows))
    for k in range(passes):
        some = item.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k) if passes > 1 else item
        first, later = _scan_with([(r[0], r[1].encode()) for r in some.collect()], width)
        docs = docs.withColumn(out, later(F.col(text_col), F.col(out)) if k else first(F.col(text_col)))
        if k < passes - 1:
            docs, _ = common.written(docs, "decontaminate")
    return docs


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a hit, columns as they were."""
    out = common.free_name(docs, "contamination")
    return contamination(docs, items, out=out, **options).filter(F.col(f"{out}.n_hit") == 0).drop(out)
