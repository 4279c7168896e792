import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from sparklog.llm import token_binary as tb
from sparklog.llm.queries import op1_token_binary, tokenizer_file

from .helpers import ODD, SF, no_documents, odd_documents, table

PATH = tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def want(rows, plain):
    start, out = 0, []
    for doc, text in rows:
        ids = np.array([*plain(text), 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_against_plain_encoding(spark, plain):
    rows = sorted((r["doc_id"], r["text"]) for r in table(spark, "documents").collect())
    assert sorted(tuple(r) for r in op1_token_binary(spark, SF).collect()) == want(rows, plain)


def test_odd_rows_and_ids(spark, plain, tmp_path):
    docs = odd_documents(spark)
    tb.write_token_files(docs, str(tmp_path / "t"), PATH, shard_tokens=50)
    found = sorted((tuple(r) for r in tb.token_digests(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    assert found == want([(None, "null id"), *enumerate(ODD)], plain)
    ids = {r["doc_id"]: r["ids"] for r in tb.read_token_files(spark, str(tmp_path / "t")).collect()}
    assert ids[4] == [*plain("word"), 2]
    assert spark.read.parquet(str(tmp_path / "t")).count() >= 2


def test_very_long_documents_are_decoded_in_ranges(spark, plain, tmp_path):
    rnd = np.random.default_rng(4)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta"], n)) for n in (5, 150_000, 3, 70_000, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = str(tmp_path / "t")
    tb.write_token_files(docs.coalesce(1), path, PATH, shard_tokens=160_000)
    rows = want(list(enumerate(texts)), plain)
    for blocks in (1, 2, 256):
        assert sorted(tuple(r) for r in tb.token_digests(spark, path, blocks=blocks).collect()) == rows
        pieces = tb.read_token_files(spark, path, blocks=blocks).orderBy("doc_id", "at").collect()
        assert (len(pieces) > 5) == (blocks < 256)
        ids = {k: [x for r in pieces if r["doc_id"] == k for x in r["ids"]] for k in range(5)}
        assert ids == {k: [*plain(t), 2] for k, t in enumerate(texts)}
    every = [x for k in range(5) for x in ids[k]]
    for start, end in ((0, 7), (16_384, 16_390), (40_000, 200_123), (len(every) - 3, len(every) + 9), (5, 5)):
        found = [x for r in tb.read_ids(spark, path, start, end).orderBy("start").collect() for x in r["ids"]]
        assert found == every[start:end]


def test_crc_of_parts():
    rnd = np.random.default_rng(1)
    for a, b in ((0, 0), (3, 0), (0, 5), (4, 4), (1000, 77), (5, 100_000)):
        x, y = rnd.bytes(a), rnd.bytes(b)
        assert tb.crc32_combine(zlib.crc32(x), zlib.crc32(y), b) == zlib.crc32(x + y)


def test_one_id_of_many_rows_is_dealt_out(spark, plain, tmp_path):
    rows = [(None if k % 3 else 7, f"text {k * 7919 % 1000} of many") for k in range(1200)] + [(8, "x"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tb.write_token_files(docs.repartition(6), str(tmp_path / "t"), PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(str(tmp_path / "t")).select("part").distinct().count() > 2
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    found = sorted((tuple(r) for r in tb.token_digests(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    assert found == want(order, plain)


def test_no_documents(spark):
    assert tb.token_output(no_documents(spark), PATH).collect() == []


def test_repeated_ids(spark, plain):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted((tuple(r) for r in tb.token_output(docs, PATH).collect()), key=lambda r: r[1]) == want([(1, "a"), (1, "a"), (1, "b")], plain)


def test_pieces_equal_whole_texts(plain):
    encoder = tb.Encoder(PATH)
    texts = ["a  b", "a \nb", " lead", "trail ", "\n\nx", "it's don't x'll", "a'b 'c", "x_y 1.5 3,4 ª²½", "tab\there  two", "日本語 テスト。é'é", "!!' '' ’s", "<|endoftext|> a<|endoftext|>", "w.'s x,'ll", "a.\nB c\nd.\n e", "one\ntwo,\nThree.!", "x\n\ny z"]
    for t in texts * 2:
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == plain(t)


def test_pieces_are_learnt_many_a_call(plain):
    encoder, calls = tb.Encoder(PATH), []
    tokenize = encoder.tokenize
    encoder.tokenize = lambda text: calls.append(text) or tokenize(text)
    text = " ".join(f"word{chr(97 + k // 676)}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}," for k in range(3000))
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == plain(text)
    assert 0 < len(calls) < 100


def test_random_pieces_in_small_groups_and_caches(plain):
    rnd = np.random.default_rng(8)
    parts = ["a", "Zo", "é", "ñandú", "日本", "ª", "²", "½", "’", "…", "—", "\u0301", "😀", "'", "'s", "'ll", ".", ",", '"', "_", "-", "7", "42", "٣", "\n", "\n", "\t", "\r\n", "\u00a0", "\x1c", "\x00", "<|endoftext|>", " ", " ", " ", " ", " ", " "]
    texts = ["".join(rnd.choice(parts, rnd.integers(0, 12))) for _ in range(3000)] + ["", None, " ".join(["x"] * 3000), "y" * 3000]
    encoder = tb.Encoder(PATH)
    encoder.CACHE, encoder.GROUP, encoder.JOINED = 50, 200, 5
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [plain(t) for t in texts]


@pytest.mark.parametrize("merge", [("a", "b"), ("a", ","), ("a", "Ġ"), ("Ċ", "a"), ("1", "a"), ("©", "."), ("a", "\'")])
def test_merges_over_cuts(tmp_path, merge):
    alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
    model = models.BPE({t: k for k, t in enumerate([*alphabet, "".join(merge)])}, [merge])
    library = Tokenizer(model)
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    library.save(path := str(tmp_path / "t.json"))
    encoder = tb.Encoder(path)
    assert encoder.joins == (merge in (("a", "b"), ("a", "'")))
    texts = ["ab a, a b\na b", "é. a1a\na a' a's", "a,a 1a a"]
    assert [x.tolist() for x in encoder.encode(texts)] == [library.encode(t).ids for t in texts]


@pytest.mark.parametrize("n", [1, 31, 32, 33, 40_000, 100_001])
def test_image_round_trip_and_checkpoints(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_000).astype(np.uint32)
    image = tb.Image(data := tb.encode_image([7, None], np.array([n - 1, 1]), ids))
    assert (image.ids() == ids).all()
    assert (image.doc_ids, image.lengths.tolist()) == ([7, None], [n - 1, 1])
    last = image.blocks - 1
    if image.steps > tb.CHECK:
        skipped = tb.CHECK * tb.LANES
        assert (image.decode(0, 1, 1)[0] == ids[skipped : image.block]).all()
        tail = ids[last * image.block + skipped :]
        assert (image.decode(last, last + 1, 1)[0][: len(tail)] == tail).all()
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        tb.Image(bytes(broken))


def test_frequencies():
    for counts in ([1], [1] * 5000, [10**9, 1, 1], list(range(1, 3000))):
        freq = tb.normalised(np.array(counts))
        assert freq.sum() == 1 << 18 and freq.min() >= 1
    assert (tb.bits_for(50_000), tb.bits_for(250_000)) == (18, 20)
