"""Quality rules as a ledger of failure bits and measurements; versioned policies and ablations are bit arithmetic on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import cut

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 3

# What a text is measured by, in the order of the ledger's columns.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_marked_lines", "n_cut_lines",
)


@dataclass(frozen=True)
class Rule:
    """Fails where `fails`, a SQL condition on the measurements in whole numbers, holds. The bit never changes its meaning."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a row is rejected by any rule in `strict`, or by `enough` of those in `weak`."""

    version: str
    strict: tuple[str, ...]
    weak: tuple[str, ...] = ()
    enough: int = 2


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "short_words", "word_chars < 3 * n_words"),
    Rule(3, "long_words", "word_chars > 10 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > n_words"),
    Rule(5, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(6, "few_letters", "100 * n_letter_words < 80 * n_words"),
    Rule(7, "bullets", "100 * n_marked_lines > 90 * n_lines"),
    Rule(8, "cut_lines", "100 * n_cut_lines > 30 * n_lines"),
    Rule(9, "many_words", "n_words > 100000"),
)
BASE = ("few_words", "repeated_words")
POLICIES = {
    p.version: p for p in (
        Policy("base", BASE),
        Policy("v1", (*BASE, "short_words", "long_words", "symbols", "repeated_lines", "few_letters", "bullets", "cut_lines")),
        Policy("v2", (*BASE, "symbols", "few_letters"), ("short_words", "long_words", "repeated_lines", "bullets", "cut_lines")),
        Policy("v3", (*BASE, "symbols", "few_letters", "many_words"), ("short_words", "long_words", "repeated_lines", "bullets", "cut_lines"), 1),
    )
}
CURRENT = "v2"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside windows of three words that the text has twice or more, each word once, the first window's included.

    The windows' hashes are sorted with their places, so equal ones stand side by side and a text
    costs n log n; the places found, in order, cover up to three words each.
    """
    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))),
        )

    def places(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("hash"), i.alias("at"))))
        return _let(ordered, lambda s: F.sort_array(F.transform(
            F.filter(
                F.transform(s, lambda x, i: F.struct(
                    x["at"].alias("at"),
                    ((i > 0) & (F.get(s, i - 1)["hash"] == x["hash"]) | F.coalesce(F.get(s, i + 1)["hash"] == x["hash"], F.lit(False))).alias("twice"),
                )), lambda x: x["twice"],
            ), lambda x: x["at"],
        )))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x,
        )

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(places(h), covered)).otherwise(0)

    return _let(words, lambda w: F.when(F.size(w) > WINDOW, _let(windows(w), counted)).otherwise(0))


def measured(text: Column) -> Column:
    """The measurements of a text as a struct of longs, each text read as a whole; null counts as empty.

    Words are runs of anything but ASCII white space, lines are parts between \\n that hold a
    word. Marked lines begin with a bullet, cut lines end with an ellipsis, letter words hold a letter.
    """
    def values(w: Column, lines: Column) -> Column:
        found = {
            "n_words": F.size(w),
            "word_chars": F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)),
            "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS[1:-1]}]+", "")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(w),
            "n_lines": F.size(lines),
            "n_letter_words": F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))),
            "n_marked_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))),
            "n_cut_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
        }
        return F.struct(*(F.coalesce(found[m], F.lit(0)).cast("long").alias(m) for m in MEASURES))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda x: x != "")
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(words, lambda w: _let(lines, lambda x: values(w, x)))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, measurements, failed): every rule evaluated once for every row; bit b of failed is set where the rule of bit b fails.

    Null and empty texts have no words and all measurements 0, so they fail what asks for words. Repeated
    rows and null keys have a row each. Other columns of docs are not looked at. The ledger is
    written to the shared folder: policies and ablations read it and no text.
    """
    bits = None
    for rule in rules:
        bit = F.when(F.expr(rule.fails), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long"))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    rows = docs.select(F.col(key).alias("key"), measured(F.col(text).cast("string")).alias("m"))
    return cut(rows.select("key", "m.*").withColumn("failed", bits).withColumnRenamed("key", key))


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    """The bits of the rules of these names; an unknown name is an error."""
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in set(names))


def rejected(failed: Column, policy: Policy, without: int = 0, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether the policy rejects a row with these failure bits, the rules of the bits `without` left out."""
    keep = ~without
    strict, weak = mask(policy.strict, rules) & keep, mask(policy.weak, rules) & keep
    return (failed.bitwiseAND(F.lit(strict).cast("long")) != 0) | (F.bit_count(failed.bitwiseAND(F.lit(weak).cast("long"))) >= policy.enough)


def judged(entries: DataFrame, policy: Policy) -> DataFrame:
    """entries with `policy` (its version) and `kept`; only the failure bits are read."""
    return entries.withColumns({"policy": F.lit(policy.version), "kept": ~rejected(F.col("failed"), policy)})


def ablations(entries: DataFrame, policies: dict[str, Policy] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(policy, rule, rows, failed, kept, kept_without, sole) for each rule of each policy.

    failed: rows that fail the rule; kept: rows the policy keeps; kept_without: rows it would keep without
    the rule; sole: rows that only this rule rejects. The rows are first counted by their bits, one
    row for each pattern that occurs (2 ** rules at most), and the rest is bit arithmetic on patterns.
    An empty ledger gives counts of 0.
    """
    patterns = cut(entries.groupBy("failed").agg(F.count("*").alias("n")))
    used = [(p, r) for p in policies.values() for r in rules if r.name in p.strict + p.weak]

    def total(holds: Column) -> Column:
        return F.coalesce(F.sum(F.when(holds, F.col("n"))), F.lit(0))

    rows = []
    for policy, rule in used:
        bit, failed = 1 << rule.bit, F.col("failed")
        now, less = ~rejected(failed, policy, rules=rules), ~rejected(failed, policy, bit, rules)
        rows.append(F.struct(
            F.lit(policy.version).alias("policy"), F.lit(rule.name).alias("rule"), total(F.lit(True)).alias("rows"),
            total(failed.bitwiseAND(F.lit(bit).cast("long")) != 0).alias("failed"), total(now).alias("kept"), total(less).alias("kept_without"),
            total(less & ~now).alias("sole"),
        ))
    return patterns.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def shared_failures(entries: DataFrame, by: list[Column]) -> DataFrame:
    """(by, rows, any, all, odd) for each group: bits that some row fails, that all fail, and that an odd number fail.

    Bitwise aggregates are combined before the shuffle, so a group may hold any share of the rows.
    """
    return entries.groupBy(*by).agg(
        F.count("*").alias("rows"), F.bit_or("failed").alias("any"), F.bit_and("failed").alias("all"), F.bit_xor("failed").alias("odd"),
    )


def base_rules(docs: DataFrame, policy: Policy = POLICIES[CURRENT]) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed, policy) of every row."""
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    return judged(ledger(docs), policy).select("doc_id", *MEASURES[:5], base.alias("base_failed"), "kept", "failed", "policy")
