"""Symbols: concepts in clusters with a glyph each, and symbolic streams of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import GLYPHS, SYMBOL_PALETTE
from ..functions.text import round_to

MAX_SYMBOLS, MAX_MEMBERS = 1500, 100
MAX_CONCEPTS, MAX_STREAM_CONCEPTS, MAX_STREAM_PHRASES = 800, 8, 12
BONUS = {"decision": ("decision", 20), "error": ("conflict", 20), "request": ("procedure", 20), "task": ("procedure", 20), "quote": ("summary", 10)}


def neighbours(edges: DataFrame) -> DataFrame:
    """(a, b, weight): the largest weight between two concepts, in both directions."""
    rows = edges.where(F.col("type").isin("often_cooccurs_with", "related_to", "subconcept_of")).select("src", "dst", "weight")
    both = rows.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight").unionByName(rows.select(F.col("dst").alias("a"), F.col("src").alias("b"), "weight"))
    return both.groupBy("a", "b").agg(F.max("weight").alias("weight"))


def clusters(spark: SparkSession, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(symbol_no, seed_label, concept_id): greedy clusters by importance.

    Each cluster takes what earlier ones left, so the order matters; there are at most 800
    concepts, and this bounded step runs on the driver.
    """
    rows = concepts.select("concept_id", "label", "importance", "rank").orderBy(F.desc("importance"), "rank").limit(MAX_CONCEPTS).collect()
    known = {r["concept_id"] for r in rows}
    near: dict[str, list[tuple[float, str]]] = {}
    for r in neighbours(edges).join(F.broadcast(concepts.select(F.col("concept_id").alias("a"))), "a", "left_semi").collect():  # pairs of at most 800 concepts
        near.setdefault(r["a"], []).append((-r["weight"], r["b"]))
    taken: set[str] = set()
    out = []
    for number, seed in enumerate((r for r in rows if r["concept_id"] not in taken), start=1):
        members = [seed["concept_id"]]
        taken.add(seed["concept_id"])
        for _, b in sorted(near.get(seed["concept_id"], ())):
            if b in known and b not in taken and len(members) < MAX_MEMBERS:
                members.append(b)
                taken.add(b)
        out += [(number, seed["label"], m) for m in members]
    return spark.createDataFrame([x for x in out if x[0] <= MAX_SYMBOLS], "symbol_no int, label string, concept_id string")


def glyph(number: Column) -> Column:
    """The palette's entry, counted from 1, then braille patterns."""
    palette = F.array(*map(F.lit, SYMBOL_PALETTE))
    braille = F.decode(F.unhex(F.lpad(F.hex(F.lit(0x2800) + (number - 1) % 256), 4, "0")), "UTF-16BE")
    return F.coalesce(F.get(palette, number - 1), braille)


def symbol_library(members: DataFrame, concepts: DataFrame) -> DataFrame:
    rows = members.join(concepts.select("concept_id", "importance"), "concept_id").groupBy("symbol_no", "label")
    table = rows.agg(round_to(F.least(F.lit(1.0), F.avg("importance")), 4).alias("bin_weight"), F.count("*").cast("int").alias("token_count"), F.sort_array(F.collect_list("concept_id")).alias("concept_ids"))
    return table.select(F.format_string("sym_%06d", "symbol_no").alias("symbol_id"), "symbol_no", "label", glyph(F.col("symbol_no")).alias("glyph"), "bin_weight", "token_count", "concept_ids")


def glyph_scores(text: Column, kind: Column, artifact: Column) -> list[Column]:
    """The families' scores in tenths, in their order."""
    low = F.lower(text)
    out = []
    for name, (_, words) in GLYPHS.items():
        score = sum((F.when(low.contains(w), 10).otherwise(0) for w in words), start=F.lit(0))
        if name == "artifact":
            score = score + F.when(artifact.isNotNull(), 32).otherwise(0)
        for k, (family, bonus) in BONUS.items():
            if family == name:
                score = score + F.when(kind == k, bonus).otherwise(0)
        out.append(score)
    return out


def glyph_profile(text: Column, kind: Column, artifact: Column) -> Column:
    """struct(glyph, probability): the first best family and its share of all scores."""
    scores = F.array(*glyph_scores(text, kind, artifact))
    best, total = F.array_max(scores), F.aggregate(scores, F.lit(0), lambda a, x: a + x)
    signs = F.array(*[F.lit(g) for g, _ in GLYPHS.values()])
    share = F.when(total > 0, F.greatest(F.lit(0.08), F.least(F.lit(0.99), best / F.greatest(total, F.lit(1))))).otherwise(0.1)
    return F.struct(F.get(signs, (F.array_position(scores, best) - 1).cast("int")).alias("glyph"), round_to(share, 2).alias("probability"))


def streams(chunks: DataFrame, links: DataFrame, members: DataFrame, phrase_ids: DataFrame | None = None) -> DataFrame:
    """One record per chunk in its session's order: concepts, symbols, glyph."""
    top = links.where(F.col("link_rank") <= MAX_STREAM_CONCEPTS).join(F.broadcast(members.select("concept_id", F.format_string("sym_%06d", "symbol_no").alias("symbol_id"))), "concept_id", "left")  # at most 800 concepts
    per = top.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("link_rank", "concept_id", "symbol_id"))).alias("l"))
    rows = chunks.join(per, "chunk_id", "left").withColumn("g", glyph_profile(F.col("text"), F.col("kind"), F.col("artifact_type")))
    none = F.array().cast("array<string>")
    ids = lambda f: F.coalesce(F.array_distinct(F.filter(F.transform("l", lambda x: x[f]), lambda v: v.isNotNull())), none)
    return rows.select("session_id", F.col("seq_in_session").alias("seq"), "chunk_id", "kind", F.col("g.glyph").alias("summary_glyph"), F.col("g.probability").alias("glyph_probability"), ids("concept_id").alias("concept_ids"), ids("symbol_id").alias("symbol_ids"), "artifact_type")
