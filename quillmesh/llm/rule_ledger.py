"""Quality rules as a ledger: every rule is evaluated once and leaves one failure bit.

``ledger`` adds the measurements and a bitmask of failed rules to every row. A policy is a
mask over those bits, so old and new policies are applied to the same ledger without
reading a text again, and ``ablations`` gets what each rule alone rejects from a count per
distinct bitmask (at most two to the number of rules rows, whatever the input).

Only built-in column functions are used. Nothing is shuffled: a text's repeated windows are
found inside its own row by sorting window hashes with their positions.

Defined results: a null or blank text has no words, fails ``few_words`` and keeps zero
measurements; repeated rows and ties are measured row by row; an empty table gives an empty
ledger; columns of the input are kept, and one that has a ledger column's name is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of, words_of


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: Callable[[Mapping[str, Column]], Column]


#: What a rule sees by name; each is a long.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs")

RULES = (
    Rule("few_words", 0, lambda m: m["n_words"] < 50),
    Rule("repeated_windows", 1, lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 50),
    Rule("symbol_heavy", 2, lambda m: m["n_symbols"] * 10 > m["word_chars"]),
    Rule("repeated_lines", 3, lambda m: m["n_dup_lines"] * 10 > m["n_lines"] * 3),
    Rule("long_words", 4, lambda m: m["word_chars"] > m["n_words"] * 15),
    Rule("shouting", 5, lambda m: m["n_bangs"] * 2 > m["n_words"]),
    Rule("many_repeated_lines", 6, lambda m: (m["n_dup_lines"] >= 3) & (m["n_dup_lines"] * 10 > m["n_lines"] * 3)),
)

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbol_heavy", "repeated_lines"),
    "v3": ("few_words", "repeated_windows", "symbol_heavy", "repeated_lines", "long_words", "shouting"),
    "v4": ("few_words", "repeated_windows", "symbol_heavy", "many_repeated_lines", "long_words", "shouting"),
}
BASE_POLICY, CURRENT_POLICY = "v1", "v3"
#: What deletes documents: one or two repeated lines of a short text are no evidence against it.
DELETING_POLICY = "v4"


def policy_mask(policy: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _windows(words: Column) -> Column:
    """The hash of each 3-word window, in order."""
    return F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    )


def _covered(starts: Column) -> Column:
    """Words inside the 3-word windows that begin at these ascending positions."""
    reach = F.transform(starts, lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(starts, i + 1), p + 3) - p))
    return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeated(windows: Column) -> Column:
    """Words in windows found twice or more.

    Structs of a window's hash and its position are sorted, so equal windows are neighbours
    however many there are.
    """

    def positions(placed: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(placed, j)["h"] == F.get(placed, k)["h"], F.lit(False))
        found = F.filter(placed, lambda v, j: same(j, j + 1) | same(j, j - 1))
        return F.sort_array(F.transform(found, lambda v: v["i"]))

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    counted = let(placed, lambda p: let(positions(p), _covered))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(counted)


def _measured(text: Column) -> Column:
    """All measurements of a text as one struct."""

    def of_lines(lines: Column, words: Column, t: Column) -> Column:
        n_chars = F.length(t)
        values = {
            "n_words": F.size(words),
            "word_chars": F.length(_without(t, " \n\t\x0b\x0c\r")),
            "n_symbols": n_chars - F.length(_without(t, "#*$%&|<>")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": let(_windows(words), _repeated),
            "n_lines": F.size(lines),
            "n_bangs": n_chars - F.length(_without(t, "!")),
        }
        return F.struct(*[values[k].cast("long").alias(k) for k in MEASURES])

    def of_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        return let(words_of(t), lambda words: let(lines, lambda ls: of_lines(ls, words, t)))

    return let(text_of(text), of_text)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``measures`` (a struct) and ``failed`` (the bits of the failed rules)."""
    measured = docs.withColumn("measures", _measured(F.col(f"`{text}`")))
    m = {k: F.col("measures")[k] for k in MEASURES}
    failed = F.lit(0).cast("long")
    for rule in RULES:
        failed = failed.bitwiseOR(F.when(rule.fails(m), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", failed)


def passes(policy: str, failed: Column | None = None) -> Column:
    """Whether a ledger's row passes a policy."""
    bits = F.col("failed") if failed is None else failed
    return bits.bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def ablations(entries: DataFrame) -> DataFrame:
    """What each policy rejects and what it would reject without each of its rules.

    One row for each policy and rule: ``rejected`` documents by the policy, ``by_rule``
    failing this rule, ``only_by_rule`` failing no other rule of the policy.
    """
    counts = entries.groupBy("failed").count()
    masks = [(p, name, policy_mask(p), 1 << r.bit) for p in POLICIES for name in POLICIES[p] for r in RULES if r.name == name]
    table = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(n).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for p, n, m, b in masks]))
    hit = F.col("failed").bitwiseAND(F.col("m.mask"))
    total = lambda c, name: F.sum(F.when(c, F.col("count")).otherwise(0)).alias(name)
    return (
        counts.select("failed", "count", table.alias("m"))
        .groupBy("m.policy", "m.rule")
        .agg(total(hit != 0, "rejected"), total(hit.bitwiseAND(F.col("m.bit")) != 0, "by_rule"), total(hit == F.col("m.bit"), "only_by_rule"))
    )
