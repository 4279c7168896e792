import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sparklog.llm import chat_format as chat
from sparklog.llm.queries import op5_chat_format

from .helpers import SF, table


def test_held_out_roles(spark):
    rows = op5_chat_format(spark, SF).join(table(spark, "conversations").select("conv_id", "turn", F.col("role").alias("true")), ["conv_id", "turn"])
    rows = rows.filter("held_out").collect()
    assert len(rows) > 100
    assert sum(r["role"] == r["true"] for r in rows) / len(rows) >= 0.95


@pytest.mark.parametrize(("partitions", "chunk", "size"), [("8", 3, 1 << 20), ("40", 2, 1 << 20), ("8", 999, 60)])
def test_chunks_equal_one_viterbi(spark, partitions, chunk, size):
    rows = table(spark, "conversations").filter("conv_id < 60")
    rows = rows.withColumn("conv_id", F.when(F.col("conv_id") < 30, 0).otherwise(F.col("conv_id"))).withColumn("turn", F.monotonically_increasing_id())
    known = chat.segments(rows, role_col="role")
    model = chat.learn(known)
    by_conv = {}
    for r in sorted(known.collect(), key=lambda r: (r["conv_id"], r["turn"], r["segment"])):
        by_conv.setdefault(r["conv_id"], []).append(r)
    want = {}
    for conv, segs in by_conv.items():
        before = None
        roles = [chat.ROLES[k] for k in model.decode([s["obs"] for s in segs], None, None)]
        for k, (s, role) in enumerate(zip(segs, roles, strict=True)):
            opened = chat.OPEN.format(role) + s["text"]
            text = opened if before is None else "\n" + s["text"] if role == before else chat.CLOSE + opened
            want[conv, s["turn"], s["segment"]] = (role, text + (chat.CLOSE if k == len(segs) - 1 else ""))
            before = role
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["conv_id"], r["turn"], r["segment"]): (r["role"], r["rendered"]) for r in chat.recovered(rows, chunk=chunk, chunk_bytes=size).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want


def test_markers_and_odd_rows(spark):
    rows = [(1, 0, "User: hello\nAssistant: fine\nthanks?\n[Human] > again", "user", "x"), (1, 1, None, None, "x"), (1, 1, "", "tool", "x"), (None, None, "System: rules", None, "x"), (2, 5, "z" * 300_000, None, "x"), (2, 5, "z" * 300_000, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string, known_role string")
    got = [(r["conv_id"], r["turn"], r["segment"], r["role"], r["rendered"][:60]) for r in chat.recovered(df).orderBy("conv_id", "turn", "segment").collect()]
    assert len(got) == 8
    assert got[0][3:] == ("system", "<|system|>\nrules<|end|>\n")
    assert [g[3] for g in got[1:4]] == ["user", "assistant", "user"]
    assert got[2][4] == "<|end|>\n<|assistant|>\nfine\nthanks?"
    assert chat.recovered(df.limit(0)).count() == 0
    assert chat.recovered(df, role_col=None).count() == 8


WORDS = {"system": "system instruction instructions", "user": "user human customer question q", "assistant": "assistant ai bot agent answer a"}


def plain_segments(text):
    """(marker's role or None, text) of each segment, line by line."""
    out = [[None, []]]
    for k, line in enumerate((text or "").split("\n")):
        names = {n: role for role, words in WORDS.items() for n in words.split()}
        m = re.match(r"[ \t]*(?:<\||\[|\*\*|###?[ ])?([a-z]+)(?:\|>|\]|\*\*)?[ \t]*[:>][ \t]*", line, re.IGNORECASE)
        if m and m[1].lower() in names:
            if k:
                out.append([None, []])
            out[-1][0] = names[m[1].lower()]
            line = line[m.end() :]
        out[-1][1].append(line)
    return [(marker, "\n".join(lines)) for marker, lines in out]


def plain_features(marker, text, first):
    rest = text.rstrip(" ")
    last = 1 if rest.endswith("?") else 2 if rest.endswith(".") else 3 if not rest else 0
    return (ROLES.index(marker) + 1 if marker else 0, min(int(math.log2(len(text) + 1)), 15), min(text.count("\n"), 4), last, int(first))


ROLES = ("system", "user", "assistant")


def plain_roles(conversations):
    """Roles of the segments of each conversation: tables counted by hand, then every path is tried."""
    sizes = (4, 16, 5, 4, 2)
    emit = [[[0.0] * n for n in sizes] for _ in ROLES]
    first, then, made = [0.0] * 3, [[0.0] * 3 for _ in ROLES], {}
    for conv, turns in conversations.items():
        segs = []
        for text, role in turns:
            for k, (marker, body) in enumerate(plain_segments(text)):
                known = ROLES.index(role) if role in ROLES and marker in (None, role) else None
                segs.append((plain_features(marker, body, k == 0), known))
        made[conv] = segs
        for k, (features, known) in enumerate(segs):
            if known is None:
                continue
            for j, v in enumerate(features):
                emit[known][j][v] += 1
            if k == 0:
                first[known] += 1
            elif segs[k - 1][1] is not None:
                then[segs[k - 1][1]][known] += 1
    for r in range(3):
        emit[r][0][r + 1] += 10 + 0.2 * sum(emit[r][0])
        for k in range(1, 4):
            emit[r][0][k] -= 0.99 if k != r + 1 else 0
    log = lambda row: [math.log((x + 1) / (sum(row) + len(row))) for x in row]
    first, then, emit = log(first), [log(x) for x in then], [[log(t) for t in e] for e in emit]
    out = {}
    for conv, segs in made.items():
        def score(path, segs=segs):
            total = first[path[0]] + sum(emit[path[0]][j][v] for j, v in enumerate(segs[0][0]))
            for k in range(1, len(path)):
                total += then[path[k - 1]][path[k]] + sum(emit[path[k]][j][v] for j, v in enumerate(segs[k][0]))
            return total

        ranked = sorted(itertools.product(range(3), repeat=len(segs)), key=score, reverse=True)
        out[conv] = (ranked[0], len(ranked) > 1 and score(ranked[0]) - score(ranked[1]) < 1e-9)
    return out


def test_roles_against_all_paths(spark):
    rnd = random.Random(8)
    texts = ["hello there", "What is it?", "It is a thing.", "User: hi\nAssistant: yes.\nmore", "Be brief.\nAlways.", "", "[Human] > ok?\nBot: no", "x" * 300, "a: one\nq: two?"]
    conversations = {c: [(rnd.choice(texts), rnd.choice(["user", "assistant", "system", None, "tool", "user", "assistant"])) for _ in range(rnd.randint(1, 4))] for c in range(60)}
    rows = [(c, t, text, role) for c, turns in conversations.items() for t, (text, role) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string").repartition(5)
    got = {}
    for r in chat.recovered(df).orderBy("conv_id", "turn", "segment").collect():
        got.setdefault(r["conv_id"], []).append(ROLES.index(r["role"]))
    want = {c: path for c, (path, tie) in plain_roles({c: t for c, t in conversations.items()}).items() if not tie and len(path) <= 9}
    assert len(want) > 40
    assert {c: tuple(got[c]) for c in want} == want
