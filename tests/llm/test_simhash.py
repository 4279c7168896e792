import random
import re

import pytest
import xxhash

from sparklog.llm import simhash
from sparklog.llm.queries import op4_simhash

from .helpers import SF, lower, no_documents, odd_documents, table


def plain_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, distance=4):
    ids, parent = sorted(prints), {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_query_against_all_pairs(spark):
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in table(spark, "documents").collect()}
    want = plain_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op4_simhash(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("most", "blocks"), [(16384, None), (2, 5), (3, 6), (16384, 8)])
def test_links_of_dense_clusters(spark, most, blocks):
    rnd = random.Random(9)
    prints = set()
    for _ in range(6):
        center = rnd.getrandbits(64)
        for _ in range(40):
            x = center
            for _ in range(rnd.randint(0, 6)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    prints |= {rnd.getrandbits(64) for _ in range(50)} | {0, 1, 3, (1 << 64) - 1}
    ordered = sorted(prints, key=signed)
    want = plain_components(dict(enumerate(ordered)))
    fps = spark.createDataFrame([(signed(x),) for x in ordered], "fp long")
    found = simhash.links(fps, most=most, blocks=blocks).collect()
    place = {signed(x): i for i, x in enumerate(ordered)}
    assert all((ordered[place[r["a"]]] ^ ordered[place[r["b"]]]).bit_count() <= 4 for r in found)
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame([tuple(r) for r in found], "a long, b long")).collect()}
    assert {i: place[roots.get(signed(x), signed(x))] for i, x in enumerate(ordered)} == want


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)] + [(200, 200 + k) for k in range(1, 50)]
    random.Random(1).shuffle(edges)
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {101: 100} | {200 + k: 200 for k in range(1, 50)}


def test_long_texts_in_parts():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash.fingerprint_of(text.encode()) == plain_fingerprint(text)


def test_odd_rows(spark):
    docs = odd_documents(spark, "gone string")
    found = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert found[0] == found[1] == found[2] == (0, 0)
    assert found[5][1] == found[6][1] == 5
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 3, 4, 5, 7, 8, 9, 10]
    assert simhash.near_duplicates(no_documents(spark)).count() == simhash.deduplicated(no_documents(spark)).count() == 0
    twice = spark.createDataFrame([(1, "one two three four five"), (1, "one two three four five"), (2, "x")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.deduplicated(twice).collect()) == [1, 2]


@pytest.mark.parametrize(("distance", "most"), [(1, 2), (2, 2), (3, 2), (3, 16384), (5, 16384)])
def test_links_of_any_distance(spark, distance, most):
    rnd = random.Random(3)
    u = 0x0123456789ABCDEF
    prints = {u, u ^ 7, u ^ 1 << 10, u ^ 7 ^ 1 << 11} | {rnd.getrandbits(64) for _ in range(20)}
    for _ in range(3):
        x = rnd.getrandbits(64)
        for _ in range(25):
            x ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, distance + 1)))
            prints.add(x)
    ordered = sorted(prints, key=signed)
    place = {signed(x): i for i, x in enumerate(ordered)}
    fps = spark.createDataFrame([(signed(x),) for x in ordered], "fp long")
    found = simhash.links(fps, distance=distance, most=most)
    assert all((ordered[place[r["a"]]] ^ ordered[place[r["b"]]]).bit_count() <= distance for r in found.collect())
    roots = {r["node"]: r["root"] for r in simhash.components(found).collect()}
    assert {i: place[roots.get(signed(x), signed(x))] for i, x in enumerate(ordered)} == plain_components(dict(enumerate(ordered)), distance)


def test_rows_of_one_id_are_one_document(spark):
    rows = [(3, "a one two three four"), (5, "a one two three four"), (5, "bb six seven eight nine"), (7, "bb six seven eight nine"), (None, "bb six seven eight nine"), (9, "c ten"), (None, "d eleven")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1, 1000):
        found = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(df, hot=hot).collect())
        assert found == [(0, 0), (0, 3), (3, 3), (5, 3), (5, 3), (7, 3), (9, 9)]
    kept = simhash.deduplicated(df)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "bb six seven eight nine"), (0, "d eleven"), (3, "a one two three four"), (9, "c ten")]


def test_least_text_of_an_id_stays(spark):
    rows = [(1, "b", "x", {"k": 1}), (1, None, "y", None), (1, None, "a", {"k": 2}), (2, "q", "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, m map<string,int>")
    assert sorted((r["doc_id"], r["text"], r["gone"]) for r in simhash.deduplicated(df).collect()) == [(1, None, "a"), (2, "q", "x")]


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    held = spark.conf.get("spark.checkpoint.dir")

    class Session:
        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app"

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        simhash.common.shared_dir(Session)
    Session.sparkContext.master = "local[2]"
    assert simhash.common.shared_dir(Session) == simhash.common.shared_dir(Session)
    assert spark.conf.get("spark.checkpoint.dir") == held
