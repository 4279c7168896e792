"""Token counts by count-only Viterbi over a unigram vocabulary.

Text is cut at ASCII white space, and each word is counted with U+2581 before it. An Aho-Corasick automaton gives all
pieces that end at a character; dynamic programming carries the best score and the piece count of its path, no path.
Rules are those of the `tokenizers` library's Unigram model: scores are added from the left in double precision; of
equal scores the earliest start (longest last piece) wins; where no piece is one character, that character is unknown
at the least score minus 10; adjoining unknown characters are one token, or with byte fallback one for each UTF-8 byte.

Counts of words are kept in a bounded cache by each Python worker. There is no shuffle. Null, empty and blank texts
have 0 tokens. Repeated rows get equal counts. Other columns pass through; a column of the name `out` is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm import common

START = "▁"


@lru_cache(2)
def vocabulary(path: str) -> tuple[list[tuple[str, float]], int, bool]:
    """Pieces with log-probabilities of a sentencepiece file, the unknown piece's number, whether all bytes are pieces.

    A file of merges has ranks, not probabilities; by Zipf's law a piece of rank r then scores -ln(r + 3).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    scores = [model.get_score(i) for i in range(size)]
    if all(s == int(s) for s in scores):
        scores = [-math.log(3 - s) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) else -math.log(size) for i, s in enumerate(scores)]
    pieces = [(model.id_to_piece(i), scores[i]) for i in range(size)]
    return pieces, model.unk_id(), all(any(p == f"<0x{b:02X}>" for p, _ in pieces[:300]) for b in range(256))


class Counter(dict):
    """Token count of each word (UTF-8 bytes), learnt when asked for."""

    MOST = 400_000

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - 10.0
        self.byte_fallback = byte_fallback

    def count(self, word: str) -> int:
        text = START + word
        n = len(text)
        # One past each end: best score, tokens, whether the last one is unknown.
        score, tokens, unknown = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        at, single = 0, False
        for last, (length, own) in self.automaton.iter(text):
            end = last + 1
            while at + 1 < end:  # ends that no piece reached before this one
                self.close(text, at + 1, single, score, tokens, unknown)
                at, single = at + 1, False
            start = end - length
            found = own + score[start]
            if score[end] is None or found > score[end]:
                score[end], tokens[end], unknown[end] = found, tokens[start] + 1, False
            single = single or length == 1
        while at < n:
            self.close(text, at + 1, single, score, tokens, unknown)
            at, single = at + 1, False
        return tokens[n]

    def close(self, text: str, end: int, single: bool, score: list, tokens: list, unknown: list) -> None:
        """The last candidate of an end: its character alone as unknown, if no piece is that character."""
        if single:
            return
        found = self.unknown + score[end - 1]
        if score[end] is None or found > score[end]:
            more = len(text[end - 1].encode()) if self.byte_fallback else 0 if unknown[end - 1] else 1
            score[end], tokens[end], unknown[end] = found, tokens[end - 1] + more, True

    def __missing__(self, word: bytes) -> int:
        found = self.count(word.decode())
        if len(self) < self.MOST:
            self[word] = found
        return found


@lru_cache(1)
def counter(path: str) -> Counter:
    """The process's counter, kept with its cache from task to task."""
    pieces, _, fallback = vocabulary(path)
    return Counter(pieces, fallback)


def token_counts(docs: DataFrame, vocabulary_file: str, *, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with a column `out`: tokens of the text."""

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(vocabulary_file).__getitem__
        for texts in batches:
            yield pa.array(np.array([sum(map(count, t.split())) for t in common.byte_texts(texts)], np.int64))

    return docs.withColumn(out, counted(F.col(text_col)))
