"""Quality rules as a bitmask ledger, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOL = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A rule's bit in the ledger, and the condition on the measurements under which a document fails it."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 20 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "short_or_long_words", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    Rule(5, "shouting", "100 * n_upper > 60 * n_letters"),
)
BASE = 0b11
#: Versions of the policy: which rules' bits make it drop a document. A version never changes; new ones are added.
POLICIES = {"v1": 0b001111, "v2": 0b111111}
POLICY = "v2"


def _repeated_words(words: str) -> Column:
    """Words that lie in a 3-word window found twice or more; the windows of one text meet in a sorted array."""
    hashes = f"transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2]))"
    covered = (
        "transform(array(sort_array(transform(h, (x, i) -> struct(x, i)))), s -> "
        "size(array_distinct(flatten(transform(filter(s, (e, j) -> get(s, j - 1).x <=> e.x OR get(s, j + 1).x <=> e.x), e -> array(e.i, e.i + 1, e.i + 2))))))[0]"
    )
    return F.expr(f"CASE WHEN size({words}) < 4 THEN 0 ELSE transform(array({hashes}), h -> CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE {covered} END)[0] END")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, measurements, failed): every rule evaluated once for every row, the failures as bits.

    Measurements: n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word), n_dup_lines (those
    equal to an earlier line), n_repeat_words, n_letters, n_upper. Null text is an empty text. A null id stays null,
    repeated rows have a row each, other columns are not looked at. Texts are measured whole, each inside its own row:
    no shuffle and no Python.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col),
        text.alias("_t"),
        F.filter(F.split(text, _SPACE + "+"), lambda w: w != "").alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD)).alias("_l"),
    )
    measured = split.select(
        F.col(id_col),
        F.size("_w").cast("long").alias("n_words"),
        (F.length("_t") - F.regexp_count("_t", F.lit(_SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(_SYMBOL)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeated_words("_w").cast("long").alias("n_repeat_words"),
        F.regexp_count("_t", F.lit("[A-Za-z]")).cast("long").alias("n_letters"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.expr(f"CASE WHEN {rule.fails} THEN {1 << rule.bit}L ELSE 0L END"))
    return measured.withColumn("failed", bits)


def stored_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger written to the shared folder and read again: policies and ablations read its few numbers, never the texts."""
    return cut(ledger(docs, id_col, text_col, rules), "quality-ledger")


def apply_policy(entries: DataFrame, mask: int) -> DataFrame:
    """The ledger with `kept`: no rule of the policy's mask failed."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablations(entries: DataFrame, mask: int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it drops (kept if the rule went).

    One pass of the ledger with partial sums; an empty ledger gives zeros.
    """
    failed = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    used = [r for r in rules if mask >> r.bit & 1]
    sums = [F.struct(F.lit(r.name).alias("rule"), F.count_if(failed.bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias("n_failed"), F.count_if(failed == (1 << r.bit)).alias("n_only")) for r in used]
    return entries.agg(F.array(*sums).alias("_a")).select(F.explode("_a").alias("_r")).select("_r.*")
