"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

Fingerprint of a text: lower-case A-Z, words between ASCII white space, shingles of `width` words (a shorter text is
one shingle), XXH64 with seed 42 of each shingle; a bit is set if more than half the hashes have it. A text without
words has fingerprint 0 and links like any other.

Links (at most `distance` differing bits) are sought between *distinct* fingerprints. 64 bits are cut into m blocks;
two linked fingerprints agree on all but `distance` blocks at least, so they share the value of one choice of
m - distance blocks. Fingerprints are grouped by choice and value, and each group is verified:

* two members: compared in the JVM;
* up to `most` members: one task walks the group and returns a spanning forest of its verified links, not all pairs;
* more: members emit every value within half the distance, rounded up, in the bits that the group leaves open; two
  members are linked exactly if they share such a midpoint that lies within half the distance, rounded down, of one of
  them, so all at a midpoint link to the least of those that are that near.

m grows with the number of fingerprints so that groups of unrelated ones stay small; any m gives the same links.
Components come from alternating large-star and small-star rounds over the link table, each written to the shared
folder; nothing of it goes to the driver. Copies are never paired: they share a fingerprint.

Null and empty texts link to each other (fingerprint 0). Rows with a null id get a fingerprint and the component of
their group, but never name one unless the whole group has null ids (then null). Rows that share an id are one document:
their fingerprints are linked. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm import common

SALTS = 16


def fingerprint_of(text: bytes, width: int = 4) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    import xxhash

    words = text.lower().split()
    n = len(words) - width + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n < 1:
        return xxhash.xxh64_intdigest(joined, 42)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 15):
        hi = min(n, lo + (1 << 15))
        hashes = np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts[lo:hi], starts[lo + width : hi + width], strict=True)], "<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    @F.arrow_udf("long")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint_of(t, width) for t in common.byte_texts(texts)], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col)).alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(blocks: int, distance: int) -> list[int]:
    """A mask of the agreeing blocks for each choice of blocks - distance out of blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    one = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(one, blocks - distance)]


def blocks_for(n: int, distance: int) -> int:
    """The least m whose choices have at least as many values as there are fingerprints."""
    m = distance + 2
    while m < 20 and (1 << (64 * (m - distance) // m)) < n:
        m += 1
    return m


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _forest(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among members (distinct fingerprints)."""
    left, edges = members.view(np.uint64), []  # numpy counts the bits of a signed number's absolute value
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                edges += [(int(x.view(np.int64)), y) for y in found.view(np.int64).tolist()]
                front += list(found)
                left = left[~near]
    return edges


def links(fps: DataFrame, *, distance: int = 4, most: int = 16384, blocks: int | None = None) -> DataFrame:
    """Links a, b (fingerprints) that connect the distinct fingerprints of fps(fp) just as all links of `distance` do."""
    m = blocks or blocks_for(fps.count(), distance)
    masks = block_masks(m, distance)
    choice = F.array(*[F.struct(F.lit(c).cast("int").alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("v")) for c, mask in enumerate(masks)])
    keys = fps.select("fp", F.inline(choice))
    groups, path = common.written(keys.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "groups")
    pairs = groups.filter("n = 2").filter(_near(F.col("a"), F.col("b"), distance)).select("a", "b")

    @F.arrow_udf("array<struct<a:long,b:long>>")
    def forest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for lists in batches:
            yield pa.array([[{"a": a, "b": b} for a, b in _forest(np.array(x, np.int64), distance)] for x in lists.to_pylist()], kind)

    middle = groups.filter((F.col("n") > 2) & (F.col("n") <= most)).select("c", "v")
    walked = keys.join(middle, ["c", "v"]).groupBy("c", "v").agg(F.collect_list("fp").alias("fps")).select(F.inline(forest("fps")))
    found = pairs.unionByName(walked)
    large = groups.filter(F.col("n") > most).select("c", "v")
    if large.take(1):
        found = found.unionByName(_by_midpoints(keys.join(large, ["c", "v"]), masks, distance))
    return found.distinct()


def _by_midpoints(members: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """Links within groups of any size, in rows linear in their members (c, v, fp)."""
    parts, half = [], distance // 2
    for c, mask in enumerate(masks):
        bits = [1 << i for i in range(64) if not mask >> i & 1]
        flips = [{"flip": _signed(sum(x)), "moved": r} for r in range(distance - half + 1) for x in combinations(bits, r)]
        moves = F.explode(F.from_json(F.lit(json.dumps(flips)), "array<struct<flip:long,moved:int>>"))  # folded to one literal
        parts.append(members.filter(F.col("c") == c).select("c", "v", "fp", moves.alias("move")))
    points = reduce(DataFrame.unionByName, parts).select("c", "v", "fp", F.col("fp").bitwiseXOR(F.col("move.flip")).alias("mid"), F.col("move.moved").alias("moved"))
    least = points.filter(F.col("moved") <= half).groupBy("c", "v", "mid").agg(F.min("fp").alias("a"))
    return points.join(least, ["c", "v", "mid"]).filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def _salted(left: DataFrame, right: DataFrame, key: str, by: str, how: str) -> DataFrame:
    """left joined with right (unique by key) on key, a hot key of left dealt out by `by` over SALTS tasks."""
    left = left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    return left.join(right, [key, "salt"], how).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges(a, b); root is the least node reachable. Stars, round by round.

    Edges are held as (a, b) with a > b. Large star: b becomes the least neighbour of b; small star: a's smaller
    neighbours and a itself go to the least of them. At the end every node has one edge, to its root.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, path = common.written(edges, "edges")
    spark, before = edges.sparkSession, None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = edges.select(F.col("a").alias("b"), F.col("b").alias("m")).unionByName(edges.select("b", F.col("a").alias("m")))
        least = both.groupBy("b").agg(F.min("m").alias("m")).filter("m < b")
        large = _salted(edges, least, "b", "a", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        large, mid = common.written(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _salted(large, least, "a", "b", "inner")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges, new = common.written(small, "edges")
        common.drop_path(spark, path)
        common.drop_path(spark, mid)
        path = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _same_ids(fps: DataFrame) -> DataFrame:
    """Links a, b between the fingerprints of an id that has several."""
    several = fps.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").drop("z")
    return _salted(fps, several, "doc_id", "fp", "inner").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, most: int = 16384, blocks: int | None = None, hot: int = 1000) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id reachable by links, a document's own included.

    Fingerprints that more than a `hot`-th of all rows have (fewer than `hot` of them) get their component by a broadcast
    of these few rows, the others by a join, so no key of it has more rows than that.
    """
    fps, _ = common.written(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fps")
    nodes, nodes_at = common.written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "nodes")
    found = links(nodes.select("fp"), distance=distance, most=most, blocks=blocks)
    stars = components(found.unionByName(_same_ids(fps))).select(F.col("node").alias("fp"), "root")
    named = nodes.join(stars, "fp", "left").select("fp", "rep", "rows", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    named = _salted(named, least, "root", "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"), "rows")
    named, _ = common.written(named, "named")
    common.drop_path(docs.sparkSession, nodes_at)
    most_rows = (named.agg(F.sum("rows")).first()[0] or 0) / hot
    few = F.broadcast(named.filter(F.col("rows") > most_rows).drop("rows"))  # fewer than `hot` rows
    cold = fps.join(few.select("fp"), "fp", "left_anti").join(named.filter(F.col("rows") <= most_rows).drop("rows"), "fp")
    return fps.join(few, "fp").unionByName(cold).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents whose component has a smaller id; of rows that share an id the least text stays (of equal texts the least row as JSON)."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = common.free_name(docs, "gone")
    dropped = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    own = F.col(f"`{id_col}`").cast("long")
    kept = docs.join(dropped, own == F.col(gone), "left_anti")
    again = found.filter("doc_id is not null").groupBy(F.col("doc_id").alias(gone)).count().filter("count > 1").select(gone)
    if not again.take(1):
        return kept
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row, order = F.struct(*columns), F.struct(F.col(f"`{text_col}`").alias("t"), F.to_json(F.struct(*columns)).alias("j"))
    several = kept.join(again, own == F.col(gone), "left_semi").groupBy(own.alias(gone)).agg(F.min_by(row, order).alias("row")).select("row.*")
    return kept.join(again, own == F.col(gone), "left_anti").unionByName(several)
