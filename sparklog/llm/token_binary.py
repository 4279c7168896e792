"""Token-ID output by a static range asymmetric numeral system (rANS).

Documents are dealt out by ranges of doc_id and tokenised in that order. Each task cuts its range into *shards* of
about `shard_tokens` ids (a document is never split) and writes every shard as one self-contained file image in a row
of a Parquet table, so Spark's commit protocol covers lost executors and any store that Spark writes to will do.

File image (little-endian): header; the shard's frequency table, shared by all its blocks; document table; block
index; checkpoints; 32-bit words of all blocks; CRC-32 of all that. A block holds `BLOCK` ids in `LANES` interleaved
64-bit rANS states (id i goes to lane i mod LANES) and depends on no other block. Every `CHECK` steps a block has a
checkpoint (all lane states and the word position), so decoding can start there; each block has a CRC-32 of its ids.

Readers decode blocks in parallel: a shard of more than RANGE blocks (one with a very long document) is read in ranges of
so many, each by a task of its own, and a slice of the ids is decoded from the nearest checkpoints on (`read_ids`).

Null and empty texts become a document of the end id alone. Rows with a null doc_id come first. Repeated doc_ids are
kept, ordered by text, and where ids repeat much, ranges are cut inside an id by the texts' first PREFIX characters.
Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparklog.llm import common

MAGIC = b"SLTB"
RANGE, PREFIX = 256, 64
LOW, LANES, BLOCK, CHECK = 1 << 31, 32, 32768, 512
HEAD = struct.Struct("<4sHHIIQQIIII")
TABLE_SCHEMA = "part int, seq int, n_docs long, n_tokens long, first_doc long, image binary"
#: ASCII digits and marks without the apostrophe.
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha() and chr(c) != "'")
DOC_SCHEMA = "part int, seq int, doc long, doc_id long, at long, piece_start long, n_tokens long"


def bits_for(symbols: int) -> int:
    """Bits of the frequencies' sum: tables of 18 stay in a core's cache; more symbols need more."""
    return max(18, symbols.bit_length() + 2)


def normalised(counts: np.ndarray, bits: int = 18) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 each, as near to the counts as rounding lets them be."""
    total = 1 << bits
    if len(counts) > total:
        raise ValueError(f"{len(counts)} symbols do not fit in {bits} bits")
    share = counts.astype(np.float64) * (total / counts.sum())
    freq = np.maximum(1, np.floor(share)).astype(np.int64)
    left = total - int(freq.sum())
    if left > 0:
        freq[np.argsort(freq - share, kind="stable")[: left % len(freq)]] += 1
        freq += left // len(freq)
    while left < 0:
        order = np.argsort(-freq, kind="stable")
        order = order[freq[order] > 1][:-left]
        freq[order] -= 1
        left += len(order)
    return freq


def encode_image(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard as a file image; lengths: ids of each document, ids: of all of them (uint32)."""
    n = len(ids)
    counts = np.bincount(ids)
    symbols = np.nonzero(counts)[0]
    counts = counts[symbols]
    place = np.zeros(int(symbols[-1]) + 1, np.int64)
    place[symbols] = np.arange(len(symbols))
    index = place[ids]
    bits = bits_for(len(symbols))
    freq = normalised(counts, bits).astype(np.uint64)
    cum = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
    block = min(BLOCK, -(-n // LANES) * LANES)
    steps, blocks = block // LANES, -(-n // block)
    padded = np.full(blocks * block, int(counts.argmax()), np.int64)
    padded[:n] = index
    by_step = np.ascontiguousarray(padded.reshape(blocks, steps, LANES).transpose(1, 0, 2))
    state = np.full((blocks, LANES), LOW, np.uint64)
    marks = -(-steps // CHECK)
    states = np.empty((marks, blocks, LANES), np.uint64)
    sent, owner, read = [], [], np.zeros((steps, blocks), np.int64)
    for t in range(steps - 1, -1, -1):
        at = by_step[t]
        f = freq[at]
        full = state >= (f << np.uint64(63 - bits))
        sent.append(state[full].astype(np.uint32))
        owner.append(np.nonzero(full)[0].astype(np.uint16 if blocks < 65536 else np.int64))  # 16 bits sort by radix
        read[t] = full.sum(axis=1)
        state = np.where(full, state >> np.uint64(32), state)
        q = state // f
        state = (q << np.uint64(bits)) + (state - q * f) + cum[at]
        if t % CHECK == 0:
            states[t // CHECK] = state
    words, owners = np.concatenate(sent[::-1]), np.concatenate(owner[::-1])
    words = words[np.argsort(owners, kind="stable")]
    n_words = read.sum(axis=0)
    before = np.cumsum(read, axis=0) - read
    marked = before[::CHECK].astype("<u4")
    sums = [zlib.crc32(ids[b * block : (b + 1) * block].astype("<u4").tobytes()) for b in range(blocks)]
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    parts = [
        np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes() + lengths.astype("<u8").tobytes() + nulls.tobytes(),
        n_words.astype("<u4").tobytes() + np.array(sums, "<u4").tobytes(),
        states.astype("<u8").tobytes() + marked.tobytes(),
    ]
    packed = [zlib.compress(parts[0]), zlib.compress(parts[1]), parts[2], parts[3]]
    head = HEAD.pack(MAGIC, 1, LANES, block, blocks, len(doc_ids), n, len(symbols), len(packed[0]), len(packed[1]), CHECK)
    body = b"".join([head, *packed, words.astype("<u4").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


class Image:
    """A file image; tables are read at once, blocks on demand."""

    def __init__(self, data: bytes):
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("token file is damaged: its checksum differs")
        magic, version, self.lanes, self.block, self.blocks, docs, self.n, symbols, a, b, self.check = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file of version 1")
        at = HEAD.size
        table = np.frombuffer(zlib.decompress(data[at : at + a]), "<u4")
        self.symbols = np.cumsum(table[:symbols], dtype=np.uint32)
        self.freq = table[symbols:].astype(np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.bits = bits_for(symbols)
        self.slots = np.repeat(np.arange(symbols, dtype=np.int32), self.freq.astype(np.int64))
        at += a
        rows = zlib.decompress(data[at : at + b])
        nulls = np.frombuffer(rows, np.uint8, docs, 16 * docs)
        self.doc_ids = [None if z else d for d, z in zip(np.frombuffer(rows, "<i8", docs).tolist(), nulls.tolist(), strict=True)]
        self.lengths = np.frombuffer(rows, "<u8", docs, 8 * docs).astype(np.int64)
        at += b
        self.steps, marks = self.block // self.lanes, -(-(self.block // self.lanes) // self.check)
        n_words = np.frombuffer(data, "<u4", self.blocks, at).astype(np.int64)
        self.sums = np.frombuffer(data, "<u4", self.blocks, at + 4 * self.blocks)
        at += 8 * self.blocks
        self.states = np.frombuffer(data, "<u8", marks * self.blocks * self.lanes, at).reshape(marks, self.blocks, self.lanes)
        at += self.states.nbytes
        self.marked = np.frombuffer(data, "<u4", marks * self.blocks, at).reshape(marks, self.blocks).astype(np.int64)
        at += 4 * marks * self.blocks
        self.words = np.frombuffer(data, "<u4", int(n_words.sum()), at)
        self.first = np.cumsum(n_words) - n_words

    def decode(self, lo: int = 0, hi: int | None = None, mark: int = 0) -> np.ndarray:
        """Ids of blocks lo..hi from checkpoint `mark` of each on: (blocks, ids), with padding after the last id."""
        hi = self.blocks if hi is None else hi
        state, at = self.states[mark, lo:hi].astype(np.uint64), self.first[lo:hi] + self.marked[mark, lo:hi]
        out = np.empty((self.steps - mark * self.check, hi - lo, self.lanes), np.int32)
        mask, shift = np.uint64((1 << self.bits) - 1), np.uint64(self.bits)
        for t in range(len(out)):
            slot = state & mask
            s = out[t] = self.slots[slot.astype(np.int64)]
            state = self.freq[s] * (state >> shift) + slot - self.cum[s]
            low = state < LOW
            taken = at[:, None] + np.cumsum(low, axis=1) - 1
            state[low] = (state[low] << np.uint64(32)) | self.words[taken[low]].astype(np.uint64)
            at = at + low.sum(axis=1)
        return self.symbols[out.transpose(1, 0, 2).reshape(hi - lo, -1)]

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """All ids of blocks lo..hi; raises where a block's checksum differs."""
        hi = self.blocks if hi is None else min(hi, self.blocks)
        found = self.decode(lo, hi)
        for b in range(lo, hi):
            if zlib.crc32(found[b - lo][: self.n - b * self.block].astype("<u4").tobytes()) != self.sums[b]:
                raise ValueError(f"block {b} is damaged: its checksum differs")
        return found.reshape(-1)[: self.n - lo * self.block]

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids start..end of the shard: the first block from the checkpoint before `start` on, the others whole."""
        end = min(end, self.n)
        if start >= end:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        mark = (start - first * self.block) // (self.check * self.lanes)
        head = self.decode(first, first + 1, mark)[0]
        parts = [head] + ([self.decode(first + 1, last + 1).reshape(-1)] if last > first else [])
        skipped = first * self.block + mark * self.check * self.lanes
        return np.concatenate(parts)[start - skipped : end - skipped]


class Pieces:
    """Pieces in the order they came, each with its ids in one array."""

    def __init__(self):
        self.number: defaultdict[str, int] = defaultdict(count().__next__)  # learns what it lacks
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.length = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)
        self.done = 0  # pieces that have ids

    def fresh(self) -> list[str]:
        """The pieces that have no ids yet, the last first."""
        return [*islice(reversed(self.number), len(self.number) - self.done)]

    def put(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids = _grown(self.ids, self.used + len(ids))
        self.start, self.length = (_grown(x, len(self.number)) for x in (self.start, self.length))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[numbers] = self.used + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        self.used += len(ids)


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate((x, np.empty(max(size, 2 * len(x)) - len(x), x.dtype)))


def _taken(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of ids from each start, one after the other."""
    at = np.cumsum(length)
    return ids[np.repeat(start - at + length, length) + np.arange(at[-1] if len(at) else 0)]


class Encoder:
    """Ids of texts by a `tokenizers` file, through a bounded cache of pieces led by a space or a line break.

    A byte-level pre-tokenizer always cuts before a single space or line break between two other characters, so a text
    is cut there and each distinct piece is encoded once. The pieces that a group of texts brings are encoded together:
    those of letters, ASCII digits and marks go to the library's model, many in one string (`_joins`), the others to the
    whole tokenizer. A text's first piece is encoded after a line break, whose id is left out. A text in which white space
    meets white space is encoded whole.
    """

    CACHE, IDS = 350_000, 8_000_000  # pieces and ids in each of two generations, some 180 MB in all
    GROUP, JOINED = 1 << 21, 64  # bytes of texts taken together; pieces in a string for the model

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        cut, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.tokenize = model.tokenize  # each use of .model makes a new object
        self.known, self.older = Pieces(), Pieces()
        # The alphabet of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = np.arange(256, dtype="<u2")
        self.alphabet[[b for b in range(256) if b not in plain]] = np.arange(256, 512 - len(plain))
        vocab = self.tokenizer.get_vocab()
        space, line = (chr(self.alphabet[ord(c)]) for c in " \n")
        self.by_piece = self.tokenizer.normalizer is None and isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space and line in vocab
        self.joins = self.by_piece and isinstance(model, models.BPE) and not (model.dropout or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix) and self._joins(vocab)
        self.leads = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.leads[[n for t, n in vocab.items() if t[:1] in (space, line)]] = True

    def _joins(self, vocab: dict[str, int]) -> bool:
        """Whether the model alone cuts strings of plain pieces where the pre-tokenizer does.

        It joins two pre-tokens only into a token of both; so each such token must have something that no plain piece has.
        """
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        as_byte = {chr(c): b for b, c in enumerate(self.alphabet.tolist())}
        high, space = "".join(c for c, b in as_byte.items() if b > 127), chr(self.alphabet[32])
        inside = re.compile(rf"{space}?(?:[A-Za-z{high}]+|[0-9]+|[!-&(-/:-@\[-`{{-~]+)|.").fullmatch
        for token in vocab:
            if not inside(token) and token not in added:
                text = bytes(as_byte.get(c, 0) for c in token).decode(errors="ignore")
                if not re.search(r"['\x00-\x09\x0b-\x1f\x7f]|\s\s", text) and all(c.isascii() or c.isalpha() for c in text):
                    return False
        return True

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def joined(self, pieces: list[str]) -> np.ndarray:
        """Ids of plain pieces in a row."""
        tokenize, ids = self.tokenize, []
        for lo in range(0, len(pieces), self.JOINED):
            text = " ".join(["", *pieces[lo : lo + self.JOINED]]).replace(" \n", "\n")
            ids += [t.id for t in tokenize(self.alphabet[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le"))]
        return np.array(ids, np.uint32)

    def learn(self) -> None:
        """Give the fresh pieces their ids; a length of -1 is that of a piece that cannot be encoded alone."""
        known, before = self.known, self.older.number
        old, plain, other, bad = ([], []), ([], []), ([], []), []
        plain_number, plain_piece = plain[0].append, plain[1].append
        for n, w in zip(range(len(known.number) - 1, -1, -1), known.fresh(), strict=False):
            if w in before:
                old[0].append(n)
                old[1].append(before[w])
            elif self.joins and (w.isalpha() or w.strip(EDGES).isalpha()):
                plain_number(n)
                plain_piece(w)
            else:
                bare = w.removeprefix("\n")
                if not bare or bare[0].isspace() or bare[-1].isspace():
                    bad.append(n)
                elif self.joins and (bare.strip(EDGES).isalpha() or (bare.isascii() and bare.isprintable() and "'" not in bare)):
                    plain_number(n)
                    plain_piece(w)
                else:
                    other[0].append(n)
                    other[1].append(w if w[0] == "\n" else f" {w}")
        if old[0]:
            length = self.older.length[old[1]]
            known.put(old[0], _taken(self.older.ids, self.older.start[old[1]], length.clip(0)), length.clip(0))
            known.length[old[0]] = length
        if plain[0]:
            ids = self.joined(plain[1])
            edges = np.flatnonzero(self.leads[ids])
            if len(edges) != len(plain[0]):
                raise ValueError(f"{len(plain[0])} pieces were encoded as {len(edges)}")
            known.put(plain[0], ids, np.diff(edges, append=len(ids)))
        if other[0]:
            found = self.whole(other[1])
            known.put(other[0], np.concatenate(found), np.array([*map(len, found)]))
        known.put(bad, np.empty(0, np.uint32), np.zeros(len(bad), np.int64))
        known.length[bad] = -1
        known.done = len(known.number)

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """32-bit ids of each text; null counts as empty."""
        return [*self.encoded(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)]

    def encoded(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = pc.binary_length(texts).to_numpy()
        edges = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // self.GROUP, prepend=-1, append=-1)).tolist()
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield from self.group(texts[lo:hi]) if self.by_piece else self.whole(texts[lo:hi].to_pylist())

    def group(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.known.number) > self.CACHE or self.known.used > self.IDS:
            self.known, self.older = Pieces(), self.known
        known = self.known
        nothing, line = (pa.scalar(x, texts.type) for x in ("", "\n"))
        rows = pc.split_pattern(pc.binary_join_element_wise(nothing, pc.replace_substring(texts, "\n", " \n"), line), " ")
        sizes, pieces = pc.list_value_length(rows).to_numpy(), rows.flatten().dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(known.number.__getitem__, distinct), np.int64, len(distinct))
        if known.done < len(known.number):
            self.learn()
        at = pieces.indices.to_numpy()
        start, length = known.start[numbers][at], known.length[numbers][at]
        first = np.cumsum(sizes) - sizes
        alone = np.minimum.reduceat(length, first) < 0
        length[np.repeat(alone, sizes)] = 0
        start[first] += 1
        length[first[~alone]] -= 1
        out = np.split(_taken(known.ids, start, length), np.cumsum(np.add.reduceat(length, first))[:-1])
        for k in np.flatnonzero(alone).tolist():
            out[k] = self.whole([texts[k].as_py()])[0]
        return out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The process's encoder: Spark's Python workers keep it, with its cache, from task to task."""
    return Encoder(path)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_tokens: int = 2_000_000) -> None:
    """Tokenise docs and write them in ascending id order to a table of file images at path.

    One shuffle (by ranges of the id). Memory of a task: its current shard, about 20 bytes an id.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, end = encoder(tokenizer).encoded, np.array([end_id], np.uint32)
        part, seq, doc_ids, found, held = TaskContext.get().partitionId(), 0, [], [], 0

        def shard() -> pa.RecordBatch:
            lengths = np.array([len(x) + 1 for x in found], np.int64)
            image = encode_image(doc_ids, lengths, np.concatenate([x for ids in found for x in (ids, end)]))
            row = {"part": part, "seq": seq, "n_docs": len(doc_ids), "n_tokens": int(lengths.sum()), "first_doc": doc_ids[0], "image": image}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("image", pa.binary())])
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
                doc_ids.append(doc)
                found.append(ids)
                held += len(ids) + 1
                if held >= shard_tokens:
                    yield shard()
                    seq, doc_ids, found, held = seq + 1, [], [], 0
        if doc_ids:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = F.col("doc_id").asc_nulls_first()
    n, distinct = rows.agg(F.count(F.lit(1)), F.approx_count_distinct("doc_id")).first()
    # The order is by id and text; a cut inside an id, if many rows share one (or null), follows it too.
    ranges = [first, F.left("text", F.lit(PREFIX)).asc_nulls_first()] if n > 1.5 * distinct + 100 else [first]
    ordered = rows.repartitionByRange(*ranges).sortWithinPartitions(first, F.col("text").asc_nulls_first())
    ordered.mapInArrow(encode, TABLE_SCHEMA).write.option("compression", "none").parquet(path)


def _images(spark: SparkSession, path: str, blocks: int) -> DataFrame:
    """part, seq, image, lo: a row for each range of `blocks` blocks of a shard."""
    shards = spark.read.parquet(path)
    count = F.floor((F.col("n_tokens") - 1) / (BLOCK * blocks))
    return shards.select("part", "seq", "image", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), count), lambda k: k * blocks)).alias("lo"))


def read_token_files(spark: SparkSession, path: str, *, blocks: int = RANGE) -> DataFrame:
    """Decode a table of file images: part, seq, doc, doc_id, at, piece_start (ids before the piece in its shard), n_tokens, ids (array).

    doc numbers the documents of a shard. A document is a row, or, where its blocks are of several ranges, a row a range;
    `at` is the place of the piece's first id in its document.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, seq, doc, doc_ids, at, start, ids, edges in _decoded(batches, blocks):
            columns = _columns(part, seq, doc, doc_ids, at, start, edges)
            columns["ids"] = pa.ListArray.from_arrays(edges.astype(np.int32), pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_pydict(columns)

    return _images(spark, path, blocks).mapInArrow(decode, DOC_SCHEMA + ", ids array<long>")


def _columns(part: int, seq: int, doc: np.ndarray, doc_ids: list[int | None], at: np.ndarray, start: np.ndarray, edges: np.ndarray) -> dict[str, pa.Array]:
    n = len(doc)
    return {
        "part": pa.array([part] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int32()), "doc": pa.array(doc, pa.int64()), "doc_id": pa.array(doc_ids, pa.int64()), "at": pa.array(at, pa.int64()),
        "piece_start": pa.array(start, pa.int64()), "n_tokens": pa.array(np.diff(edges), pa.int64()),
    }


def _decoded(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[tuple]:
    """For each range of blocks: part, seq, number, id and place of the pieces of documents in it, its ids and the pieces' edges in them."""
    for batch in batches:
        for part, seq, image, lo in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            shard = Image(image.as_py())
            ids = shard.ids(lo, lo + blocks).astype("<u4")
            first, last = lo * shard.block, lo * shard.block + len(ids)
            ends = np.cumsum(shard.lengths)
            doc = np.arange(np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "left") + 1)
            start = np.maximum(ends[doc] - shard.lengths[doc], first)
            edges = np.concatenate((start - first, [last - first]))
            yield part, seq, doc, [shard.doc_ids[d] for d in doc], start - (ends - shard.lengths)[doc], start, ids, edges


def _bases(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, base: ids in all shards before; running totals over one row a task, then over the shards of each."""
    shards = spark.read.parquet(path).select("part", "seq", F.col("n_tokens").alias("held"))
    zero = F.lit(0).cast("long")
    tasks = shards.groupBy("part").agg(F.sum("held").alias("held"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("part", F.coalesce(F.sum("held").over(earlier), zero).alias("task_base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = shards.select("part", "seq", F.coalesce(F.sum("held").over(inside), zero).alias("own"))
    return own.join(tasks, "part").select("part", "seq", (F.col("task_base") + F.col("own")).alias("base"))


def read_ids(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Ids start..end of all documents in a row: start (of the row's ids), ids (array); only the blocks that hold them are decoded."""
    bases = _bases(spark, path)
    shards = spark.read.parquet(path).join(bases, ["part", "seq"]).filter((F.col("base") < end) & (F.col("base") + F.col("n_tokens") > start))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, base in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ids = Image(image.as_py()).slice(max(0, start - base), end - base)
                yield pa.RecordBatch.from_pydict({"start": pa.array([max(start, base)], pa.int64()), "ids": pa.array([ids.tolist()], pa.list_(pa.int64()))})

    return shards.select("image", "base").mapInArrow(decode, "start long, ids array<long>")


def token_digests(spark: SparkSession, path: str, *, blocks: int = RANGE) -> DataFrame:
    """Per document, decoded from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, seq, doc, doc_ids, at, start, ids, edges in _decoded(batches, blocks):
            view = memoryview(ids.tobytes())
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_pydict(_columns(part, seq, doc, doc_ids, at, start, edges) | {"ids_crc32": pa.array(sums, pa.int64())})

    pieces = _images(spark, path, blocks).mapInArrow(digest, DOC_SCHEMA + ", ids_crc32 long").join(_bases(spark, path), ["part", "seq"])
    pieces = pieces.select("part", "seq", "doc", "doc_id", "at", (F.col("base") + F.col("piece_start")).alias("start"), "n_tokens", "ids_crc32")
    found = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if not spark.read.parquet(path).filter(F.col("n_tokens") > BLOCK * blocks).take(1):
        return pieces.select(*found)

    joined = F.udf(lambda parts: reduce(lambda total, p: crc32_combine(total, p["crc"], 4 * p["n"]), sorted(parts), 0), "long")
    # A document's pieces are a row for RANGE blocks of it: few, whatever its length.
    docs = pieces.groupBy("part", "seq", "doc").agg(F.max("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.collect_list(F.struct("at", F.col("n_tokens").alias("n"), F.col("ids_crc32").alias("crc"))).alias("parts"))
    whole = docs.filter(F.size("parts") == 1).withColumn("ids_crc32", F.col("parts")[0]["crc"])
    return whole.select(*found).unionByName(docs.filter(F.size("parts") > 1).withColumn("ids_crc32", joined("parts")).select(*found))


def crc32_combine(a: int, b: int, length: int) -> int:
    """CRC-32 of two strings in a row, from those of each and the second one's length in bytes.

    Zero bytes after a string change its register linearly: bit k to the image of bit k, by squaring for 1, 2, 4, ... bytes.
    """

    def applied(images: list[int], x: int) -> int:
        out = 0
        for k in range(32):
            if x >> k & 1:
                out ^= images[k]
        return out

    step = []
    for k in range(32):  # one zero byte after a register that has bit k alone
        x = 1 << k
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        step.append(x)
    while length:
        if length & 1:
            a = applied(step, a)
        step = [applied(step, x) for x in step]
        length >>= 1
    return a ^ b


def token_output(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write docs to token files in the shared folder, read them back and return token_digests()."""
    spark = docs.sparkSession
    path = common.scratch_path(spark, "tokens")
    write_token_files(docs, path, tokenizer, **options)
    return token_digests(spark, path)
