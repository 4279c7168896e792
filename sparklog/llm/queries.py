"""Queries of this subpackage for __spark_entry__.py: one a dealt operator, with production parameters, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.llm import chat_format, compression_classifier, decontaminate, mixing, quality_rules, secret_scan, simhash, substring_dedup, token_binary, token_counts
from sparklog.llm.common import table

#: Folder of the public vocabulary files; the installed package's, unless set.
TOKENIZERS = os.environ.get("SPARKLOG_TOKENIZERS", "")


def tokenizer_file(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_output(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), out="found")
    ids = F.col("found.item_ids")
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.with_probabilities(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "mix_source", "mix_lang", "mix_topic", "mix_tokens", "mix_weight", "mix_probability", mixing.sampled().alias("sampled"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles are learnt from two thirds of the conversations; held_out has the others."""
    held = compression_classifier.held_out(F.col("conv_id"))
    found = chat_format.recovered(table(spark, sf_dir, "conversations"), learn_from=~held)
    return found.withColumn("held_out", held)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"), out="found").select("doc_id", "found.*")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"), out="found")
    count = {k: F.size(F.filter(F.col("found.kind"), F.lit(k).__eq__)).cast("long") for k in secret_scan.KINDS}
    base = F.filter("found", lambda x: x["kind"] != "random")
    return found.select("doc_id", *[count[k].alias(f"n_{k}") for k in secret_scan.KINDS], F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("found")).alias("spans"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_documents(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")).select("doc_id", "n_tokens")


def op10_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compression_classifier.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", compression_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The other queries are beyond SQL (tokenisers, hashes with seeds, iterations, trained models); tests/llm compares them with plain versions.
ORACLES = {
    "op2_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
      k AS (SELECT DISTINCT item, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM b WHERE len(w) > 0),
      x AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n),
      h AS (SELECT doc_id, item, i, n FROM x JOIN k USING (n, g)), p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
      s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
      SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
