"""Concepts: weighted phrases of chunks, aggregated by normalized key, ranked and linked.

Weights are hundredths in integers, so sums don't depend on their order. Phrases are summed
up inside each chunk's row before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CONCEPT_LIMITS
from ..functions.numbering import numbered
from ..functions.text import concept_key, content_tokens, normalize_space, round_to

QUOTED = r"\"([^\"\n]{3,80})\"|'([^'\n]{3,80})'"
TITLE = r"(?<![A-Za-z0-9_])([A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+){1,4})(?![A-Za-z0-9_])"
#: Hundredths for a quoted span, a title-case run, and n-grams.
QUOTED_WEIGHT, TITLE_WEIGHT, GRAM_WEIGHTS = 200, 150, {2: 120, 3: 100, 4: 85}


def grams(words: Column, n: int) -> Column:
    """The n-grams of a token array, those with a token under three characters left out."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    found = F.transform(at, lambda i: F.slice(words, i, n))
    return F.transform(F.filter(found, lambda g: F.forall(g, lambda t: F.length(t) >= 3)), lambda g: F.array_join(g, " "))


def candidates(chunks: DataFrame, chunk: str = "chunk_id", session: str = "session_id", text: str = "text") -> DataFrame:
    """(session_id, chunk_id, surface, key, weight) of phrases that weigh 100 or more in a chunk."""
    t = F.coalesce(F.col(text), F.lit(""))
    weighted = lambda items, w: F.transform(items, lambda s: F.struct(s.alias("surface"), F.lit(w).alias("weight")))
    quoted = F.filter(F.transform(F.regexp_extract_all(t, F.lit(f"({QUOTED})"), F.lit(1)), lambda q: normalize_space(F.substr(q, F.lit(2), F.length(q) - 2))), lambda q: F.length(q) >= 3)
    titles = F.filter(F.transform(F.regexp_extract_all(t, F.lit(TITLE), F.lit(1)), normalize_space), lambda q: F.length(q) >= 3)
    rows = chunks.select(F.col(session).alias("session_id"), F.col(chunk).alias("chunk_id"), quoted.alias("q"), titles.alias("c"), content_tokens(normalize_space(t)).alias("w"))
    found = F.concat(weighted(F.col("q"), QUOTED_WEIGHT), weighted(F.col("c"), TITLE_WEIGHT), *[weighted(grams(F.col("w"), n), x) for n, x in GRAM_WEIGHTS.items()])
    rows = rows.select("session_id", "chunk_id", F.explode(found).alias("x")).groupBy("session_id", "chunk_id", "x.surface").agg(F.sum("x.weight").cast("long").alias("weight")).where("weight >= 100")
    rows = rows.withColumn("key", concept_key(F.col("surface")))
    return rows.where((F.length("key") >= 3) & (F.size(F.split("key", " ")) <= 6))


def concept_table(found: DataFrame, n_chunks: DataFrame, level: str = "medium") -> DataFrame:
    """Ranked concepts: label, importance, mentions; ``n_chunks`` is one row with column n.

    Label ties go to the smaller surface; the ranking is by importance, mentions and label.
    """
    min_chunks, min_total, factor = CONCEPT_LIMITS[level]
    surfaces = found.groupBy("key", "surface").agg(F.sum("weight").alias("weight"))
    labels = surfaces.groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("k"), "surface"))["surface"].alias("label"))
    totals = found.groupBy("key").agg(F.sum("weight").alias("total"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("chunk_id").alias("chunk_mentions"))
    kept = totals.where((F.col("chunk_mentions") >= min_chunks) & (F.col("total") >= 100 * min_total))
    peaks = kept.agg(F.greatest(F.max("total"), F.lit(100)).alias("max_total"), F.greatest(F.max("sessions"), F.lit(1)).alias("max_sessions"))
    one = F.broadcast(peaks.crossJoin(n_chunks.select("n")))  # one row
    scored = kept.crossJoin(one).withColumn("raw", F.least(F.lit(1.0), 0.46 * (F.col("total") / F.col("max_total")) + 0.32 * (F.col("sessions") / F.col("max_sessions")) + 0.22 * (F.col("chunk_mentions") / F.greatest("n", F.lit(1)))))
    most = F.greatest(F.lit(10), F.least(F.lit(800), F.floor(F.col("n") * F.lit(factor) + 0.5)))
    ranked = scored.join(labels, "key").select("key", "label", "total", "sessions", "chunk_mentions", "raw", most.cast("int").alias("most"))
    # At most 800 concepts are kept, so the sort ends in a bounded top-k of every task.
    top = ranked.orderBy(F.desc("raw"), F.desc("total"), "label", "key").limit(800)
    order = Window.orderBy(F.desc("raw"), F.desc("total"), "label", "key")
    return top.withColumn("rank", F.row_number().over(order)).where("rank <= most").select(F.format_string("concept_%06d", "rank").alias("concept_id"), "rank", "key", "label", F.array().cast("array<string>").alias("aliases"), round_to(F.col("raw"), 4).alias("importance"), "raw", F.col("chunk_mentions").alias("recurrence_count"), "total", "sessions")


def chunk_concepts(found: DataFrame, concepts: DataFrame) -> DataFrame:
    """Links (chunk_id, concept_id, score, link_rank), best first inside each chunk."""
    mentions = found.groupBy("key", "session_id", "chunk_id").agg(F.sum("weight").alias("weight"))
    links = mentions.join(F.broadcast(concepts.select("concept_id", "key", "raw")), "key")  # at most 800 concepts
    links = links.withColumn("score", F.col("weight") / 100.0 + F.col("raw"))
    order = Window.partitionBy("chunk_id").orderBy(F.desc("score"), "concept_id")
    return links.select("session_id", "chunk_id", "concept_id", "score", F.row_number().over(order).alias("link_rank"))


def global_ids(rows: DataFrame, prefix: str, *order: str) -> DataFrame:
    """Rows with a dense id in the given order."""
    return numbered(rows, "_n", *order).withColumn(f"{prefix}_no", F.col("_n")).withColumn(f"{prefix}_gid", F.format_string(f"{prefix}_%06d", "_n")).drop("_n")
