"""One query for each operator, over its whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, langid, media, mix, quality, simhash, substring, tokens, warc
from .common import spread
from .common import table as stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(stored(spark, sf_dir, name))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("_rest.doc_id", "n_words", "n_removed", "kept_sha256")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.main_text(pages, html.fit(pages))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger under both versions of the policy; `kept` is the current one's verdict."""
    entries = quality.stored_ledger(table(spark, sf_dir, "documents"))
    for version, mask in quality.POLICIES.items():
        entries = quality.apply_policy(entries, mask).withColumnRenamed("kept", f"kept_{version}")
    base_failed = F.col("failed").bitwiseAND(F.lit(quality.BASE).cast("long")) != 0
    verdict = (F.col(f"kept_{quality.POLICY}") & ~base_failed).alias("kept")
    measured = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")
    return entries.select("doc_id", *measured, base_failed.alias("base_failed"), verdict, "failed", *[f"kept_{v}" for v in quality.POLICIES])


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each version of the policy and each of its rules, how many documents fail it, and how many only it drops."""
    entries = quality.stored_ledger(table(spark, sf_dir, "documents"))
    parts = [quality.ablations(entries, mask).select(F.lit(version).alias("policy"), "rule", "n_failed", "n_only") for version, mask in quality.POLICIES.items()]
    return reduce(DataFrame.unionByName, parts)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_mix, op2_token_counts, op3_substring_dedup, op4_main_text, op5_quality_rules, op6_media, op7_byte_bpe, op8_warc, op9_language, op10_simhash, quality_ablations)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {k: v for k, v in oracles.SQL.items() if k in queries()}
