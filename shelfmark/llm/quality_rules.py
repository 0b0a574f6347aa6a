"""Quality rules as a bitmask ledger (DataFrame functions only).

`ledger` evaluates every rule once per document and stores the measurements together with `fail_bits`,
one bit a rule. A policy is a named mask over those bits, so a new policy, or the question what a rule
costs (`ablation`), reads the ledger and never the texts again. Nothing is shuffled to judge a document:
repeated windows are found by sorting the window hashes inside the row.

Edge cases: a null or blank text has no words and all measurements 0; it fails `few_words`. Repeated rows
are judged each on its own. Columns of the input are read by name (`text`, and those carried) and extra columns
are ignored. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # a SQL condition on the measurements


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule(4, "shouting", "10 * n_upper > 5 * word_chars"),
    Rule(5, "exclamations", "10 * n_exclaims > 5 * n_words"),
    Rule(6, "echoes", "10 * n_echo_words > 3 * n_words"),
    Rule(7, "word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
)
BASE_MASK = 0b11
#: Policies are versioned and immutable: a change gets a new name.
POLICIES = {"base.v1": BASE_MASK, "strict.v1": (1 << len(RULES)) - 1}


def _covered(positions: Column, width: int = 3) -> Column:
    """How many items the windows of `width` that start at the sorted positions cover."""
    steps = F.transform(positions, lambda p, i: F.when(i == 0, F.lit(width)).otherwise(F.least(F.lit(width), p - F.get(positions, i - 1))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_echo_words", "n_exclaims", "n_repeat_words")


def measure(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and MEASURES of every whole text, one row a document; a carried column of a measure's name is replaced by it."""
    held = F.struct(*carry).alias("_carried")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    base = docs.select(
        held,
        words(text).alias("_w"),
        lines.alias("_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    sized = base.select(
        "_carried", "n_symbols", "n_upper", "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))),
            lambda w, i: F.struct(F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("p")),
        ).alias("_windows"),
    )
    echoes = F.size(F.filter("_w", lambda w, i: (i > 0) & (w == F.get("_w", i - 1)))).cast("long")
    exclaims = F.size(F.filter("_w", lambda w: w.endswith("!"))).cast("long")
    ranked = sized.select("*", F.sort_array("_windows").alias("_sorted"), echoes.alias("n_echo_words"), exclaims.alias("n_exclaims")).drop("_w", "_windows")
    again = F.filter("_sorted", lambda x, i: (x.h == F.get("_sorted", i - 1).h) | (x.h == F.get("_sorted", i + 1).h))
    hits = ranked.select("*", F.sort_array(F.transform(again, lambda x: x.p)).alias("_hits")).drop("_sorted")
    all_of = hits.select("*", F.when(F.size("_hits") > 0, _covered(F.col("_hits"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))
    # What a generator makes is not replaced by the expressions behind it: a filter on a measure stays above it, instead
    # of being pushed down as copies of them into the lambdas, where they would be worked out again for every word.
    row = F.struct(*(F.col("_carried")[c].alias(c) for c in carry if c not in MEASURES), *MEASURES)
    return all_of.select(F.inline(F.array(row)))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Carried columns, measurements and fail_bits (bit `rule.bit` is set where the rule fails), one row a document."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, carry).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, policy: str = "strict.v1") -> DataFrame:
    """The ledger with `policy` and `kept`: kept where none of the policy's rules fails."""
    return led.withColumn("policy", F.lit(policy)).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def keep(docs: DataFrame, policy: str = "strict.v1") -> DataFrame:
    """The documents, with all their columns, that the policy keeps."""
    judged = apply_policy(ledger(docs.select(F.struct(*docs.columns).alias("_doc"), "text"), carry=("_doc",)), policy)
    return judged.where("kept").select("_doc.*")


def ablation(led: DataFrame, policy: str = "strict.v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: rule, n_failed, n_only (documents that would be kept without it), n_docs.

    One pass: the ledger is first counted by distinct mask, at most 2**rules rows, whatever its size.
    """
    mask = POLICIES[policy]
    by_mask = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("n"))
    own = [r for r in rules if mask >> r.bit & 1]
    table = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("one")) for r in own))).alias("r")
    return (
        by_mask.select("m", "n", table)
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("m").bitwiseAND(F.col("r.one")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("m") == F.col("r.one"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum("n").alias("n_docs"),
        )
    )
