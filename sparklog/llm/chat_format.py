"""Chat formatting: a hidden Markov model recovers speaker roles, and turns are rendered in one canonical form.

A transcript is the rows of a conversation in order of turn. Each text is cut before lines that begin with a speaker
marker (MARKERS); such a segment's features are its marker, length, number of lines, last character and whether it
opens a row. Roles are hidden states; features are emitted independently given the role. The model is counted from
rows with known roles (add-one smoothing): a table of roles by features, and of roles by roles that follow at once (what
follows a segment of unknown role, or comes before it, is not counted, nor is it a conversation's first). A marker
counts beforehand as a sixth of its role's segments and other roles' markers as a hundredth of one, since many transcripts with known roles have no markers.

Viterbi is exact for conversations of any size. Segments are dealt out by ranges of (conversation, turn, segment), so
that a long conversation lies in consecutive tasks; each task cuts its rows into chunks of `chunk` segments or CHUNK_BYTES
(more only for a longer segment) and sums up each in a max-plus matrix (best score from the role before the chunk to the role at its end). Only conversations at
the edges of a task can go on in the next one: their products, two a task at most, go to the driver, which finds the
roles at all edges. With the roles before and at the end of a chunk, its segments are decoded alone.

A line break at the end of a segment is dropped. Rendering: a role's first segment opens a turn, further ones continue it after a line break, a change of role or the
end closes it. The result is a row a segment, so no conversation is ever one value.

Null texts count as empty; an empty text is one empty segment. A null conversation id is a conversation of its own, null
turns come first. Repeated turns are ordered by a hash of their text. Rows with other or null roles are not learnt from. Without
any known role all weights are equal and ties go to the first of ROLES. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm import common

# Roles, and the names that markers give them.
ROLES = ("system", "user", "assistant")
MARKERS = {"system": ("system", "instruction", "instructions"), "user": ("user", "human", "customer", "question", "q"), "assistant": ("assistant", "ai", "bot", "agent", "answer", "a")}
NAMES = "|".join(sorted((n for names in MARKERS.values() for n in names), key=lambda n: (-len(n), n)))
MARKER = rf"^[ \t]*(?:<\||\[|\*\*|###?[ ])?({NAMES})(?:\|>|\]|\*\*)?[ \t]*[:>][ \t]*"
FEATURES = {"marker": 4, "length": 16, "lines": 5, "last": 4, "opens": 2}
CHUNK_BYTES = 1 << 20
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
CHUNK = "part int, run int, chunk int, starts boolean, ends boolean, conv_id long, turns array<long>, segments array<int>, obs array<int>, texts array<string>, matrix array<double>"


def segments(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str | None = None) -> DataFrame:
    """conv_id, turn, row (hash of the row's text), segment, obs (the features in one number), text (without marker), role (null if role_col is)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = F.col(role_col).cast("string") if role_col else F.lit(None).cast("string")
    pieces = F.split(text, rf"(?im)(?={MARKER})", -1)
    cut = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.xxhash64(text).alias("row"), given.alias("role"), F.posexplode(pieces).alias("segment", "piece"))
    cut = cut.filter((F.col("segment") == 0) | (F.col("piece") != ""))
    name = F.lower(F.regexp_extract("piece", f"(?i){MARKER}", 1))
    marker = F.lit(0)
    for k, role_name in enumerate(ROLES, 1):
        marker = F.when(name.isin(*MARKERS[role_name]), k).otherwise(marker)
    own_marker = F.lit(False)
    for k, role_name in enumerate(ROLES, 1):
        own_marker = own_marker | ((F.col("role") == role_name) & (marker == k))
    role = F.when((marker == 0) | own_marker, F.col("role"))  # a row's role is not that of another speaker's segment
    body = F.regexp_replace(F.regexp_replace("piece", f"(?i){MARKER}", ""), r"\n\z", "")
    own = cut.select("conv_id", "turn", "row", role.alias("role"), "segment", marker.alias("marker"), body.alias("text"))
    length = F.least(F.floor(F.log2(F.char_length("text") + 1)), F.lit(15)).cast("int")
    lines = F.least(F.regexp_count("text", F.lit("\n")), F.lit(4))
    last = F.when(F.rtrim("text").endswith("?"), 1).when(F.rtrim("text").endswith("."), 2).when(F.rtrim("text") == "", 3).otherwise(0)
    obs, values = F.lit(0), {"marker": F.col("marker"), "length": length, "lines": lines, "last": last, "opens": (F.col("segment") == 0).cast("int")}
    for feature, size in FEATURES.items():
        obs = obs * size + values[feature]
    return own.select("conv_id", "turn", "row", "segment", obs.cast("int").alias("obs"), "text", "role")


def parts_of(obs: int) -> list[int]:
    """The features in a number, in the order of FEATURES."""
    found = []
    for size in reversed(FEATURES.values()):
        found.append(obs % size)
        obs //= size
    return found[::-1]


class Model:
    """Log-probabilities: first[role], then[role, next role], emit[role, obs]."""

    def __init__(self, first: np.ndarray, then: np.ndarray, emitted: dict[str, np.ndarray]):
        log = lambda counts: np.log((counts + 1) / (counts + 1).sum(axis=-1, keepdims=True))
        self.first, self.then = log(first), log(then)
        tables = [log(emitted[f]) for f in FEATURES]
        size = int(np.prod(list(FEATURES.values())))
        self.emit = np.array([[sum(t[r, v] for t, v in zip(tables, parts_of(o), strict=True)) for o in range(size)] for r in range(len(ROLES))])

    def matrix(self, obs: list[int]) -> np.ndarray:
        """Best score from the role before (last row: none, a conversation starts) to the role at the end."""
        out = np.vstack((self.then, self.first)) + self.emit[:, obs[0]]
        for o in obs[1:]:
            out = product(out, self.then + self.emit[:, o])
        return out

    def decode(self, obs: list[int], before: int | None, last: int | None) -> list[int]:
        """Best roles after `before` (None: obs starts a conversation) that end in `last` (None: any)."""
        best = (self.first if before is None else self.then[before]) + self.emit[:, obs[0]]
        back = []
        for o in obs[1:]:
            paths = best[:, None] + self.then
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + self.emit[:, o]
        roles = [int(best.argmax()) if last is None else last]
        for b in reversed(back):
            roles.append(int(b[roles[-1]]))
        return roles[::-1]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).max(axis=1)


def _ordered(rows: DataFrame) -> DataFrame:
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("row"), F.col("segment")]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def learn(known: DataFrame) -> Model:
    """A model from segments with roles; every table is roles by a fixed size."""
    number = {r: k for k, r in enumerate(ROLES)}
    emitted = {f: np.zeros((len(ROLES), size)) for f, size in FEATURES.items()}
    for role, obs, n in known.filter(F.col("role").isin(*ROLES)).groupBy("role", "obs").count().collect():
        for f, v in zip(FEATURES, parts_of(obs), strict=True):
            emitted[f][number[role], v] += n
    size = len(ROLES)
    for r in range(size):  # a marker names its role, also where the known rows have no markers
        emitted["marker"][r, r + 1] += 10 + 0.2 * emitted["marker"][r].sum()
        emitted["marker"][r, [k for k in range(1, size + 1) if k != r + 1]] -= 0.99  # beside the 1 of smoothing

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, edge, before = np.zeros((size + 1, size)), None, None
        for batch in batches:
            for conv, role in zip(batch.column(0).to_pylist(), map(number.get, batch.column(1).to_pylist()), strict=True):
                edge = edge or (conv, role)
                if before is not None:
                    add(counts, before, (conv, role))
                before = (conv, role)
        if before:
            row = {"part": TaskContext.get().partitionId(), "counts": counts.reshape(-1).tolist(), "conv_a": edge[0], "role_a": edge[1], "conv_z": before[0], "role_z": before[1]}
            yield pa.RecordBatch.from_pylist([row], kinds)

    def add(counts: np.ndarray, before: tuple | None, now: tuple) -> None:
        """Count a segment (conversation, role) after the one before it."""
        starts = before is None or before[0] != now[0]
        if now[1] is not None and (starts or before[1] is not None):
            counts[0 if starts else before[1] + 1, now[1]] += 1

    kinds = pa.schema([("part", pa.int64()), ("counts", pa.list_(pa.float64())), ("conv_a", pa.int64()), ("role_a", pa.int64()), ("conv_z", pa.int64()), ("role_z", pa.int64())])
    ordered = _ordered(known.select("conv_id", "turn", "row", "segment", "role")).select("conv_id", "role")
    seen = ordered.mapInArrow(count, "part long, counts array<double>, conv_a long, role_a long, conv_z long, role_z long").orderBy("part").collect()  # a row a task
    table, before = np.zeros((size + 1, size)), None
    for row in seen:
        table += np.array(row["counts"]).reshape(size + 1, size)
        add(table, before, (row["conv_a"], row["role_a"]))
        before = (row["conv_z"], row["role_z"])
    return Model(table[0], table[1:], emitted)


def _chunks(found: DataFrame, model: Model, chunk: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks with their matrices; run: number of the conversation in its task; starts, ends: it is seen to, inside the task."""
    kinds = pa.schema([
        ("part", pa.int32()), ("run", pa.int32()), ("chunk", pa.int32()), ("starts", pa.bool_()), ("ends", pa.bool_()), ("conv_id", pa.int64()), ("turns", pa.list_(pa.int64())),
        ("segments", pa.list_(pa.int32())), ("obs", pa.list_(pa.int32())), ("texts", pa.list_(pa.string())), ("matrix", pa.list_(pa.float64())),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, run, held, conv, starts, size = TaskContext.get().partitionId(), 0, -1, [], None, False, 0

        def row(ends: bool) -> pa.RecordBatch:
            turns, places, obs, texts = zip(*held, strict=True)
            matrix = model.matrix(obs).reshape(-1).tolist()
            return pa.RecordBatch.from_pylist([dict(zip(kinds.names, (part, run, number, starts, ends, conv, turns, places, obs, texts, matrix), strict=True))], kinds)

        for batch in batches:
            for c, *segment in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                new = run < 0 or c != conv
                if held and (new or len(held) == chunk or size + len(segment[-1]) > chunk_bytes):
                    yield row(new)
                    number, held, starts, size = number + 1, [], False, 0
                if new:
                    conv, run, starts = c, run + 1, run >= 0
                held.append(segment)
                size += len(segment[-1])
        if held:
            yield row(False)

    return _ordered(found.drop("role")).select("conv_id", "turn", "segment", "obs", "text").mapInArrow(cut, CHUNK)


def recovered(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str | None = "role", learn_from: Column | None = None, chunk: int = 128, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """conv_id, turn, segment, role (recovered), rendered (its part of the canonical form). learn_from: rows whose roles count as known."""
    own = common.free_name(rows, "known_role")
    known = F.col(role_col).cast("string") if role_col else F.lit(None).cast("string")
    rows = rows.withColumn(own, F.when(learn_from, known) if learn_from is not None else known)
    found = segments(rows, conv_col=conv_col, turn_col=turn_col, text_col=text_col, role_col=own)
    model = learn(found)
    chunks, _ = common.written(_chunks(found, model, chunk, chunk_bytes), "chunks")
    return _decoded(chunks, model)


def _states(matrices: list[np.ndarray], before: int | None, last: int | None) -> list[int]:
    """Best role at the end of each matrix in a row, from `before` (None: a start) to `last` (None: any)."""
    best, back = matrices[0][len(ROLES) if before is None else before], []
    for m in matrices[1:]:
        paths = best[:, None] + m[: len(ROLES)]
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0)
    out = [int(best.argmax()) if last is None else last]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def _solved(edges: list[dict]) -> dict[tuple[int, int], tuple[int | None, int, bool]]:
    """For conversations at the edges of tasks, by (part, run): role before, role at the end, whether it ends there."""
    edges = sorted(edges, key=lambda e: (e["part"], e["run"]))
    chains: list[list[dict]] = []
    for e in edges:
        before = chains[-1][-1] if chains else None
        if before and before["open"] and e["run"] == 0 and before["conv_id"] == e["conv_id"]:
            chains[-1].append(e)
        else:
            chains.append([e])
    out = {}
    for chain in chains:
        ends = _states([np.array(e["matrix"]).reshape(-1, len(ROLES)) for e in chain], None, None)
        for k, e in enumerate(chain):
            out[e["part"], e["run"]] = (ends[k - 1] if k else None, ends[k], k == len(chain) - 1)
    return out


def _decoded(chunks: DataFrame, model: Model) -> DataFrame:
    shape = (-1, len(ROLES))
    whole = F.col("starts") & F.col("ends")  # a conversation in one chunk
    open_ones = chunks.filter(~whole).select("part", "run", "chunk", "ends", "conv_id", "matrix")

    def ordered(table: pa.Table) -> list[dict]:
        return sorted(table.to_pylist(), key=lambda r: r["chunk"])

    def summed(table: pa.Table) -> pa.Table:
        rows = ordered(table)
        is_open = not rows[-1]["ends"]
        out = []
        if rows[0]["run"] == 0 or is_open:
            m = np.array(rows[0]["matrix"]).reshape(shape)
            for r in rows[1:]:
                m = product(m, np.array(r["matrix"]).reshape(shape)[: len(ROLES)])
            out.append({"part": rows[0]["part"], "run": rows[0]["run"], "conv_id": rows[0]["conv_id"], "open": is_open, "matrix": m.reshape(-1).tolist()})
        return pa.Table.from_pylist(out, pa.schema([("part", pa.int32()), ("run", pa.int32()), ("conv_id", pa.int64()), ("open", pa.bool_()), ("matrix", pa.list_(pa.float64()))]))

    by_run = open_ones.groupBy("part", "run")
    edges = by_run.applyInArrow(summed, "part int, run int, conv_id long, open boolean, matrix array<double>").collect()  # two a task at most
    solved = _solved([e.asDict() for e in edges])

    def bounded(table: pa.Table) -> pa.Table:
        rows = ordered(table)
        before, last, closes = solved.get((rows[0]["part"], rows[0]["run"]), (None, None, True))
        ends = _states([np.array(r["matrix"]).reshape(shape) for r in rows], before, last)
        n = len(rows)
        out = [{"part": r["part"], "chunk": r["chunk"], "before": ends[k - 1] if k else before, "last": ends[k], "closes": closes and k == n - 1} for k, r in enumerate(rows)]
        return pa.Table.from_pylist(out, pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("before", pa.int32()), ("last", pa.int32()), ("closes", pa.bool_())]))

    bounds = by_run.applyInArrow(bounded, "part int, chunk int, before int, last int, closes boolean")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                roles = model.decode(r["obs"], r["before"], r["last"])
                rendered, before = [], r["before"]
                for role, text in zip(roles, r["texts"], strict=True):
                    opened = OPEN.format(ROLES[role]) + text
                    rendered.append(opened if before is None else f"\n{text}" if role == before else CLOSE + opened)
                    before = role
                if r["closes"] or r["closes"] is None:
                    rendered[-1] += CLOSE
                n = len(roles)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["conv_id"]] * n, pa.int64()), pa.array(r["turns"], pa.int64()), pa.array(r["segments"], pa.int32()), pa.array([ROLES[x] for x in roles]), pa.array(rendered)],
                    names=["conv_id", "turn", "segment", "role", "rendered"],
                )

    joined = chunks.select("part", "chunk", "conv_id", "turns", "segments", "obs", "texts").join(bounds, ["part", "chunk"], "left")
    joined = joined.select("conv_id", "turns", "segments", "obs", "texts", "before", "last", "closes")
    return joined.mapInArrow(decode, "conv_id long, turn long, segment int, role string, rendered string")
