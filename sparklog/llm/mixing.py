"""Mixing sources to target weights by iterative proportional fitting (raking), then calibrated sampling.

Documents are summed to cells (source, language, topic) of tokens. Topics come from the texts (topics.py) unless a column
is given; tokens are words between ASCII white space. Raking scales the cells in turn until the marginals
meet their targets; a document's weight is its cell's raked share over its observed share. Its probability is
min(1, scale x weight), with the scale that makes the expected tokens `keep` of all, and it is sampled if a hash of its
id, uniform in [0, 1), lies below. Targets are shares by category, or a power: observed shares raised to it, normalised.
Given categories that no cell has are left out and the rest normalised; categories without a given target get none.
Where the targets cannot all be met (or not in `rounds` rounds), a warning tells how far the marginals are off.

Up to `driver_cells` cells are raked on the driver and broadcast; more are raked as a table, by aggregates over the
marginals written to the shared folder each round. Documents themselves are never shuffled by the first way.

A null category is a category of its own. Null and empty texts have no tokens and are sampled with their cell's
probability (a cell without tokens has weight 1). Null ids share one hash. Repeated rows are sampled together. An empty
table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm import common, topics as topic_model

KEYS = ("mix_source", "mix_lang", "mix_topic")
Target = float | dict[str | None, float]


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _report(off: float, tolerance: float) -> None:
    if off > max(tolerance, 1e-3):
        warnings.warn(f"the target marginals are not met: a category is off by a factor of {1 + off:.4g}", stacklevel=3)


def shares(observed: dict[str | None, float], target: Target) -> dict[str | None, float]:
    """Target share of each observed category."""
    wanted = {k: target.get(k, 0.0) for k in observed} if isinstance(target, dict) else {k: v**target if v > 0 else 0.0 for k, v in observed.items()}
    total = sum(wanted.values())
    if total <= 0:
        raise ValueError("no category that a target names has tokens")
    return {k: v / total for k, v in wanted.items()}


def rake(keys: list[tuple], tokens: np.ndarray, targets: list[Target], rounds: int = 100, tolerance: float = 1e-9) -> np.ndarray:
    """Weights of the cells: raked over observed share."""
    total = tokens.sum()
    if not total:
        return np.ones(len(tokens))
    mass, plans = tokens / total, []
    for d, target in enumerate(targets):
        names = sorted({k[d] for k in keys}, key=lambda x: (x is not None, x or ""))
        number = {n: i for i, n in enumerate(names)}
        place = np.array([number[k[d]] for k in keys])
        seen = np.bincount(place, mass, len(names))
        wanted = shares(dict(zip(names, seen.tolist(), strict=True)), target)
        plans.append((place, np.array([wanted[n] for n in names])))
    off = 0.0
    for _ in range(rounds):
        off = 0.0
        for place, wanted in plans:
            now = np.bincount(place, mass, len(wanted))
            factor = np.divide(wanted, now, out=np.ones_like(wanted), where=now > 0)
            off = max(off, float(np.abs(factor[now > 0] - 1).max(initial=0)))
            mass = mass * factor[place]
        if off < tolerance:
            break
    _report(off, tolerance)
    return np.divide(mass * total, tokens, out=np.ones(len(tokens)), where=tokens > 0)


def scale_for(weights: np.ndarray, tokens: np.ndarray, keep: float) -> float:
    """The scale at which min(1, scale x weight) keeps that share of the tokens in expectation."""
    wanted, scale = keep * tokens.sum(), 0.0
    if not wanted:
        return keep
    full = np.zeros(len(tokens), bool)
    while True:
        free = (weights * tokens)[~full].sum()
        if free <= 0:
            return max(scale, 1e300)
        scale = (wanted - tokens[full].sum()) / free
        new = weights * scale >= 1
        if (new == full).all():
            return float(scale)
        full = new | full


def _rake_table(cells: DataFrame, targets: list[Target], rounds: int, tolerance: float) -> DataFrame:
    """cells with a column `weight`, as rake() makes it, for any number of cells."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumn("weight", F.lit(1.0))
    mass = cells.withColumn("mass", F.col("tokens") / F.lit(float(total)))
    wanted = []
    for key, target in zip(KEYS, targets, strict=True):
        seen = mass.groupBy(key).agg(F.sum("mass").alias("seen"))
        if isinstance(target, dict):
            given = spark.createDataFrame([(k, float(v)) for k, v in target.items()], f"{key} string, share double")
            seen = seen.alias("a").join(given.alias("b"), F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "left").select(f"a.{key}", F.coalesce("share", F.lit(0.0)).alias("share"))
        else:
            seen = seen.select(key, F.when(F.col("seen") > 0, F.pow("seen", F.lit(target))).otherwise(0.0).alias("share"))
        seen, _ = common.written(seen, "targets")
        whole = seen.agg(F.sum("share")).first()[0]
        if not whole:
            raise ValueError("no category that a target names has tokens")
        wanted.append(seen.withColumn("share", F.col("share") / F.lit(whole)))
    mass, path = common.written(mass, "cells")
    off = 0.0
    for _ in range(rounds):
        off = 0.0
        for key, share in zip(KEYS, wanted, strict=True):
            now = mass.groupBy(key).agg(F.sum("mass").alias("now"))
            factor = now.alias("a").join(share.alias("b"), F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")))
            factor = factor.select(F.col(f"a.{key}").alias("category"), F.when(F.col("now") > 0, F.col("share") / F.col("now")).otherwise(1.0).alias("factor"), "now")
            factor, used = common.written(factor, "factor")
            off = max(off, factor.filter("now > 0").agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0.0)
            scaled = mass.join(factor, F.col(key).eqNullSafe(F.col("category")))
            scaled, new = common.written(scaled.select(*KEYS, "tokens", (F.col("mass") * F.col("factor")).alias("mass")), "cells")
            for old in (path, used):
                common.drop_path(spark, old)
            mass, path = scaled, new
        if off < tolerance:
            break
    _report(off, tolerance)
    return mass.select(*KEYS, "tokens", F.when(F.col("tokens") > 0, F.col("mass") * float(total) / F.col("tokens")).otherwise(1.0).alias("weight"))


def _scale_table(cells: DataFrame, keep: float) -> float:
    """scale_for() by aggregates over the cells."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return keep
    scale, full_before = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(scale) >= 1
        n, held, free = cells.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight") * F.col("tokens"))), F.lit(0.0))).first()
        if n == full_before:
            return scale
        if free <= 0:
            return max(scale, 1e300)
        full_before, scale = n, (keep * total - held) / free


def with_probabilities(
    docs: DataFrame, *, source_col: str = "source", lang_col: str = "lang", text_col: str = "text", topic: Column | None = None,
    source: Target = 0.5, lang: Target = 0.7, topics: Target = 0.7, keep: float = 0.8, rounds: int = 100, tolerance: float = 1e-9, driver_cells: int = 100_000,
) -> DataFrame:
    """docs with mix_source, mix_lang, mix_topic, mix_tokens, mix_weight and mix_probability (such columns are replaced)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {*KEYS, "mix_tokens", "mix_weight", "mix_probability"}])
    text, named = F.col(text_col), {"mix_source": F.col(source_col).cast("string"), "mix_lang": F.col(lang_col).cast("string")}
    if topic is None:
        # The texts are read twice: for the vectors, from which topics and cells come, and for the result.
        held = docs.select(*[c.alias(k) for k, c in named.items()], topic_model.features(text).alias("found"))
        rows, _ = common.written(held.select(*named, "found.tokens", "found.vector"), "vectors")
        model = topic_model.fit(rows.select("vector", F.col("mix_lang").alias("lang")))
        cells = rows.withColumn("mix_topic", topic_model.topic_of_vector(F.col("vector"), F.col("mix_lang"), model)).groupBy(*KEYS).agg(F.sum("tokens").alias("tokens"))
        own = common.free_name(docs, "mix_found")
        docs = docs.withColumns(named).withColumn(own, topic_model.topic_of_text(text, F.col("mix_lang"), model))
        docs = docs.withColumns({"mix_tokens": F.col(f"{own}.tokens"), "mix_topic": F.col(f"{own}.topic")}).drop(own)
    else:
        docs = docs.withColumns(named | {"mix_tokens": n_tokens(text), "mix_topic": topic.cast("string")})
        cells = docs.groupBy(*KEYS).agg(F.sum("mix_tokens").alias("tokens"))
    cells, _ = common.written(cells, "cells")
    targets = [source, lang, topics]
    rows = cells.limit(driver_cells + 1).collect()
    if len(rows) <= driver_cells:
        rows.sort(key=lambda r: tuple((x is not None, x or "") for x in r[:3]))
        tokens = np.array([r[3] for r in rows], float)
        weights = rake([tuple(r[:3]) for r in rows], tokens, targets, rounds, tolerance)
        scale = scale_for(weights, tokens, keep)
        held = [(*r[:3], float(w)) for r, w in zip(rows, weights, strict=True)]
        cells = docs.sparkSession.createDataFrame(held, ", ".join(f"{k} string" for k in KEYS) + ", mix_weight double")
        cells = F.broadcast(cells)  # driver_cells rows at most
    else:
        cells = _rake_table(cells, targets, rounds, tolerance)
        scale = _scale_table(cells, keep)
        cells = cells.select(*KEYS, F.col("weight").alias("mix_weight"))
    own = {k: common.free_name(docs, f"cell_{k}") for k in KEYS}
    cells = cells.select(*[F.col(k).alias(own[k]) for k in KEYS], "mix_weight")
    same = [F.col(k).eqNullSafe(F.col(own[k])) for k in KEYS]
    joined = docs.join(cells, same[0] & same[1] & same[2]).drop(*own.values())
    return joined.withColumn("mix_probability", F.least(F.lit(1.0), F.col("mix_weight") * F.lit(scale)))


def sampled(id_col: str = "doc_id", seed: int = 17) -> Column:
    """Whether a document with probabilities is sampled: its id's hash in [0, 1) is below its probability."""
    unit = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11) * F.lit(2.0**-53)
    return unit < F.col("mix_probability")


def mixed(docs: DataFrame, *, id_col: str = "doc_id", seed: int = 17, **options) -> DataFrame:
    """The sampled documents, columns as they were."""
    clash = {c: common.free_name(docs, f"own_{c}") for c in docs.columns if c.lower().startswith("mix_")}
    found = with_probabilities(docs.withColumnsRenamed(clash), **options).filter(sampled(id_col, seed))
    return found.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])
