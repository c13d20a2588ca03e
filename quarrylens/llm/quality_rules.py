"""Quality rules as a bitmask ledger.

``ledger(docs)`` evaluates every rule once and stores, for each document, the measurements and one
long of failure bits.  Policies are versioned masks over those bits: ``apply_policy`` decides with a
single bitwise AND and ``ablations`` recomputes what each rule contributes, both without touching a
text again.  Rules are integer comparisons over the measures, so they compile to plain Spark
expressions and mean the same in any SQL engine.

Defined cases: a null or empty text has all measures 0 and fails ``few_words``; a null ``doc_id``
stays null; repeated rows are judged one by one; an empty table gives an empty ledger; columns of
the input other than the key and the text are not carried, so clashing names cannot matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textstats import MEASURES, with_stats


@dataclass(frozen=True)
class Rule:
    """Fails where ``predicate`` (SQL over the measures) holds."""

    bit: int
    name: str
    predicate: str


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules: a document is kept if none of them fails."""

    name: str
    version: int
    rules: tuple[str, ...]


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 3 * n_words"),
    Rule(3, "shouting", "100 * n_bang_words > 3 * n_words"),
    Rule(4, "upper_case", "n_words >= 20 AND 100 * n_upper_words > 15 * n_words"),
    Rule(5, "stutter", "100 * n_adjacent_repeats > 12 * n_words"),
    Rule(6, "table_bars", "100 * n_bare_symbol_words > 3 * n_words"),
    Rule(7, "dup_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule(8, "word_length", "n_words > 0 AND (word_chars > 15 * n_words OR 2 * word_chars < 5 * n_words)"),
)

BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, tuple(r.name for r in RULES))


def mask_of(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    known = {r.name: 1 << r.bit for r in rules}
    return reduce(lambda a, name: a | known[name], policy.rules, 0)


def fail_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = [F.when(F.expr(r.predicate), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")) for r in rules]
    return reduce(Column.bitwiseOR, bits)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", key_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Key columns, all measures, ``fail_bits``."""
    return with_stats(docs, text_col, key_cols).withColumn("fail_bits", fail_bits(rules))


def apply_policy(found: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, out: str = "kept") -> DataFrame:
    return found.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy, rules)).cast("long")) == 0)


def patterns(found: DataFrame) -> DataFrame:
    """How many documents have each combination of failures (at most 2 ** rules rows)."""
    return found.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"))


def ablations(found: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that stay kept without it."""
    mask = mask_of(policy, rules)
    chosen = [r for r in rules if r.name in policy.rules]
    active = patterns(found).select(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits"), "n_docs")
    rows = active.select(
        "bits", "n_docs", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen])).alias("r")
    ).select("bits", "n_docs", "r.rule", "r.bit")
    n = F.col("n_docs")
    return rows.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, n)), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), n)), F.lit(0)).alias("n_failed_alone"),
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, n)), F.lit(0)).alias("n_kept_without"),
    )


OUTPUT_MEASURES = tuple(m for m in MEASURES if m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
