"""Mixing sources to target weights by entropy balancing.

Every document of a source starts from rate 1 and may be taken up to ``most`` times. Among
all rates that meet the source's token target the chosen ones are nearest to the start in
relative entropy; the convex dual has one multiplier per source, and its optimum tilts the
odds of a document exponentially: rate = most / (1 + exp(-(bias + lambda * size / mean))).
Newton steps on the dual need two sums per source, which Spark computes from counts per
source and size, so an iteration reads a small table and never the texts.

Rates become whole copies by one threshold per source. Each document has a fixed uniform
number from its id and its text, and adding a shift to all of them moves the taken total
monotonically; the shift that meets the target is found by three rounds of histograms. A
source misses its target by about one document at most.

What is known of the sources (sizes, targets, multipliers, brackets, shifts) is a table with a
row for each source that every step rewrites in the shared folder; the driver sees single
numbers only, whatever the number of sources. Up to ``MAX_SENT`` sources that table is sent to
the executors; more of them are joined by shuffle, each source dealt into ``SALT`` parts. Sums
are exact (decimals and longs), so they do not depend on the order of rows.

Defined results: a null or blank text has size 0, is never needed for a target and keeps one
copy; null is a source of its own, last in order; rows without an id or with a repeated one
are told apart by their texts, and rows equal in both are taken alike; a source without words
has target 0; an empty table gives an empty mix; ``mixed`` keeps all columns of the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from .common import Scratch, Table, materialize, n_words_of

WEIGHTS = (3.0, 1.0, 2.0)
BINS = 1024
#: So many sources at most are sent to the executors; more are joined by shuffle in so many parts.
MAX_SENT, SALT = 100_000, 64


def _sized_columns(text: str, source: str, key: str) -> list[Column]:
    """key, source, its name in joins (never null), size and the text's hash."""
    name = F.col(f"`{source}`").cast("string")
    return [F.col(f"`{key}`").alias("key"), name.alias("source"), F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("part"), n_words_of(F.col(f"`{text}`")).alias("size"), F.xxhash64(F.col(f"`{text}`")).alias("mark")]


def with_sources(rows: DataFrame, sources: DataFrame, few: bool, *spread: str) -> DataFrame:
    """The rows joined with the table of sources; a hot source's rows are dealt by the columns ``spread``."""
    if few:
        return rows.join(F.broadcast(sources), "part")  # at most MAX_SENT rows
    salted = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALT)).cast("int")).join(salted, ["part", "_salt"]).drop("_salt")


# ---------------------------------------------------------------- targets


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: int, stored: Scratch) -> DataFrame:
    """Adds target to (part, source, total): ``share`` of all sizes by weight, no source above ``most`` times its size.

    The unit of weight that is left for the open sources is found by turns with the sources
    that it fills; every turn is one aggregate.
    """
    ranked = stored(numbered(sources.withColumn("last", F.col("source").isNull()), "rank", "last", "source"), "mix-ranked")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int"))
    ranked = ranked.withColumn("weight", weight).drop("last", "rank")
    full = ranked.agg(F.sum("total").alias("n")).first()["n"] or 0
    unit, filled = -1.0, -1
    while True:
        # What an earlier unit filled stays filled, as units only grow.
        closed = F.lit(unit) * F.col("weight") >= F.col("total") * most if unit >= 0 else F.lit(False)
        row = ranked.agg(F.coalesce(F.sum(F.when(closed, F.col("total"))), F.lit(0)).alias("taken"), F.sum(F.when(~closed, F.col("weight"))).alias("weights"), F.count_if(closed).alias("n")).first()
        if row["n"] == filled or not row["weights"]:
            break
        unit, filled = (share * full - most * row["taken"]) / row["weights"], row["n"]
    capped = F.col("total") * F.lit(float(most))
    return ranked.withColumn("target", F.least(capped, F.lit(max(unit, 0.0)) * F.col("weight")) if row["weights"] else capped).drop("weight")


# ---------------------------------------------------------------- rates


def _rate(most: int) -> Column:
    """The rate by size, lam and mean: 1 at lambda 0; lambda beyond 700 stands for a source that is taken wholly."""
    bias = -math.log(most - 1.0) if most != 2 else 0.0
    return F.when(F.col("lam") >= 700.0, F.lit(float(most))).otherwise(F.lit(float(most)) / (F.lit(1.0) + F.exp(-(F.lit(bias) + F.col("lam") * F.col("size") / F.col("mean")))))


def multipliers(counts: DataFrame, sources: DataFrame, few: bool, most: int, stored: Scratch, tolerance: float = 1e-7, rounds: int = 60) -> DataFrame:
    """Adds the dual optimum ``lam`` to the sources, by Newton steps kept inside a shrinking bracket."""
    capped = F.col("target") >= F.col("total") * most
    state = sources.withColumn("moving", (F.col("target") > 0) & ~capped).withColumn("lam", F.when(capped & (F.col("total") > 0), 1000.0).otherwise(0.0))
    state = Table(state.withColumns({"low": F.lit(-1.0), "high": F.lit(1.0), "low_known": F.lit(False), "high_known": F.lit(False)}), "mix-state")
    weighted = F.col("n") * F.col("size") * F.col("rate")
    exact = lambda c: F.sum(c.cast("decimal(30,6)")).cast("double")
    for _ in range(rounds):
        if not state.df.where("moving").limit(1).count():
            break
        moving = state.df.where("moving").select("part", "lam", "mean")
        rated = with_sources(counts, moving, few, "size").withColumn("rate", _rate(most))
        sums = rated.groupBy("part").agg(exact(weighted).alias("taken"), exact(weighted * F.col("size") / F.col("mean") * (F.lit(1.0) - F.col("rate") / F.lit(float(most)))).alias("slope"))
        over, under = F.col("off") > 0, F.col("off") < 0
        step = state.df.where("moving").join(sums, "part").withColumn("off", F.col("taken") - F.col("target")).withColumn("done", F.abs("off") <= tolerance * F.greatest("target", F.lit(1.0)))
        step = step.withColumns({"high": F.when(over, F.col("lam")).otherwise(F.col("high")), "high_known": F.col("high_known") | over, "low": F.when(over, F.col("low")).otherwise(F.col("lam")), "low_known": F.col("low_known") | ~over})
        step = step.withColumns({"low": F.when(~F.col("low_known") & over, F.least("low", "lam") * 2).otherwise(F.col("low")), "high": F.when(~F.col("high_known") & under, F.greatest("high", "lam") * 2).otherwise(F.col("high"))})
        newton = F.col("lam") - F.col("off") / F.when(F.col("slope") > 0, F.col("slope"))
        inside = F.coalesce((F.col("low") < newton) & (newton < F.col("high")), F.lit(False))
        step = step.withColumn("lam", F.when(F.col("done"), F.col("lam")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2))
        step = step.withColumn("moving", ~F.col("done") & (F.col("high") - F.col("low") >= 1e-13 * F.greatest(F.lit(1.0), F.abs("lam"))))
        after = Table(step.select(*state.df.columns).unionByName(state.df.where("not moving")), "mix-state")
        state.drop()
        state = after
    stored.tables.append(state)
    return state.df.drop("moving", "low", "high", "low_known", "high_known")


# ---------------------------------------------------------------- whole copies


def shifts(rated: DataFrame, sources: DataFrame, few: bool, most: int, stored: Scratch) -> DataFrame:
    """(part, shift): the shift of the uniform numbers whose whole copies come nearest to the source's target.

    Copy number k of a document is taken from shift k - rate - u on; the sums of sizes by
    those shifts are histogrammed over ever smaller intervals.
    """
    start, width = -float(most) - 1.0, 2.0 * most + 2.0
    state = sources.where((F.col("target") > 0) & (F.col("target") < F.col("total") * most)).select("part", "target", F.lit(start).alias("start"), F.lit(0).cast("long").alias("below"), F.lit(start).alias("shift"))
    state = stored(state, "mix-shifts")
    at = F.explode(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: k - F.col("rate") - F.col("u")))
    events = rated.where("size > 0").select("part", "key", "mark", "size", at.alias("at"))
    for _ in range(3):
        step = width / BINS
        dealt = with_sources(events, state.select("part", "start"), few, "key", "mark").withColumn("bin", F.floor((F.col("at") - F.col("start")) / F.lit(step)).cast("int"))
        bins = dealt.where((F.col("bin") >= 0) & (F.col("bin") < BINS)).groupBy("part", "bin").agg(F.sum("size").alias("n"))
        running = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("bin")))  # BINS rows for each source at most
        crossed = running.join(state.select("part", "target", "below"), "part").groupBy("part").agg(
            F.min(F.when(F.col("below") + F.col("upto") > F.col("target"), F.struct("bin", "n", "upto"))).alias("x"), F.max("upto").alias("whole")
        )
        total = F.col("below") + F.col("x.upto") - F.col("x.n")
        near = F.col("x.bin") + F.when(F.col("target") - total > F.col("x.n") / 2, 1).otherwise(0)
        found = state.join(crossed, "part", "left").select(
            "part",
            "target",
            F.when(F.col("x").isNull(), F.col("start") + width).otherwise(F.col("start") + F.col("x.bin") * step).alias("start"),
            F.when(F.col("x").isNull(), F.col("below") + F.coalesce("whole", F.lit(0))).otherwise(total).cast("long").alias("below"),
            F.when(F.col("x").isNull(), F.col("start") + width).otherwise(F.col("start") + near * step).alias("shift"),
        )
        state, width = stored(found, "mix-shifts"), step
    return state.select("part", "shift")


class Plan:
    """The solved mix: a table of sources with target, multiplier and shift."""

    def __init__(self, sources: DataFrame, few: bool, most: int):
        self.sources, self.few, self.most = sources, few, most

    def rated(self, rows: DataFrame) -> DataFrame:
        """Adds the source's columns, u and rate to rows that have key, part, size and mark."""
        u = F.pmod(F.xxhash64(F.col("key"), F.col("mark"), F.lit(20240229)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
        rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate(self.most))
        return with_sources(rows, self.sources.drop("source"), self.few, "key", "mark").withColumn("u", u).withColumn("rate", rate)

    def applied(self, rows: DataFrame) -> DataFrame:
        """Adds source_size, target, rate, copies and taken."""
        shifted = F.least(F.lit(self.most), F.greatest(F.lit(0), F.floor(F.col("rate") + F.col("u") + F.col("shift")).cast("int")))
        copies = F.when(F.col("size") == 0, F.lit(1)).when(F.col("shift").isNotNull(), shifted).otherwise(F.round("rate").cast("int"))
        return self.rated(rows).withColumn("copies", copies).withColumn("source_size", F.col("total")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def solve(base: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2, max_sent: int = MAX_SENT) -> Plan:
    """The plan for rows of key, source, part, size and mark (a written table: it is read once per iteration)."""
    stored = Scratch()
    counts = stored(base.groupBy("part", "source", "size").agg(F.count("*").alias("n")), "mix-counts")
    sources = stored(counts.groupBy("part", "source").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("docs")), "mix-sources")
    few = sources.limit(max_sent + 1).count() <= max_sent
    sized = targets(sources, weights, share, most, stored).withColumn("mean", F.greatest(F.col("total") / F.col("docs"), F.lit(1e-9)))
    solved = multipliers(counts.where("size > 0").drop("source"), sized, few, most, stored)
    rated = stored(Plan(solved, few, most).rated(base).select("key", "mark", "part", "size", "u", "rate"), "mix-rated")
    known = materialize(solved.join(shifts(rated, solved, few, most, stored), "part", "left"), "mix-plan")
    stored.drop()
    return Plan(known, few, most)


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **settings) -> DataFrame:
    """The documents' keys with size, source_size, target, rate, copies and taken (copies times size)."""
    base = materialize(docs.select(*_sized_columns(text, source, key)), "mix-sizes")
    out = solve(base, **settings).applied(base)
    return out.select(F.col("key").alias(key), "source", "size", "source_size", "target", "rate", "copies", "taken")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **settings) -> DataFrame:
    """The mix itself: every row as often as the mix takes it, with the input's columns."""
    plan = solve(materialize(docs.select(*_sized_columns(text, source, key)), "mix-sizes"), **settings)
    rows = docs.select(F.struct("*").alias("row"), *_sized_columns(text, source, key))
    return plan.applied(rows).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
