"""The memory graph: typed, weighted edges between concepts, chunks, sessions and artifacts.

Every rule is an equi-join or a window; edges are unique by (src, dst, type), the weight of
the rule that comes first being kept. Weights lie in [0, 1] with four decimals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_tokens, jaccard, round_to, token_set

MAX_LINKS = 6  # concept links of a chunk that count
MAX_PAIRED = 2000  # concepts compared by label
COMPARED_CHARS = 1200  # characters of a chunk that are compared; None compares whole texts


def _leading(column: str, chars: int | None) -> Column:
    return F.col(column) if chars is None else F.substring(column, 1, chars)


def _edge(src, dst, kind, weight: Column | float, order: int) -> list[Column]:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return [F.col(src).alias("src") if isinstance(src, str) else src.alias("src"), F.col(dst).alias("dst") if isinstance(dst, str) else dst.alias("dst"), F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), round_to(F.least(F.lit(1.0), F.greatest(F.lit(0.0), w)), 4).alias("weight"), F.lit(order).alias("ord")]


def topic_edges(links: DataFrame) -> DataFrame:
    """A chunk's best concept is its primary topic, the next five are mentioned in it."""
    top = links.where(F.col("link_rank") <= MAX_LINKS)
    first = F.col("link_rank") == 1
    return top.select(*_edge("concept_id", "chunk_id", F.when(first, "primary_topic_of").otherwise("mentioned_in"), F.when(first, 0.65 + 0.05 * F.col("score")).otherwise(0.40 + 0.04 * F.col("score")), 0))


def artifact_mentions(links: DataFrame, versions: DataFrame) -> DataFrame:
    v = versions.select("chunk_id", F.col("version_id"))
    return links.where(F.col("link_rank") <= MAX_LINKS).join(v, "chunk_id").select(*_edge("concept_id", "version_id", "mentioned_in_artifact", 0.42 + 0.04 * F.col("score"), 1))


def sequence_edges(chunks: DataFrame, chars: int | None = COMPARED_CHARS) -> DataFrame:
    """Edges between neighbouring chunks of a session: adjacency, similarity, references."""
    order = Window.partitionBy("session_id").orderBy("seq_in_session")
    rows = chunks.select("session_id", "seq_in_session", "chunk_id", _leading("text", chars).alias("text")).withColumn("tokens", token_set(F.col("text")))
    rows = rows.withColumn("prev_id", F.lag("chunk_id").over(order)).withColumn("similarity", jaccard(F.lag("tokens").over(order), F.col("tokens"))).where("prev_id is not null")
    near = rows.select(*_edge("prev_id", "chunk_id", "adjacent_to", 1.0, 2))
    follows = rows.where(F.col("similarity") >= 0.25).select(*_edge("chunk_id", "prev_id", "follows_from", 0.35 + F.col("similarity"), 3))
    refers = rows.where(F.lower("text").rlike(r"(?<![a-z0-9_])(?:above|earlier|previous|reference|as discussed)(?![a-z0-9_])")).select(*_edge("chunk_id", "prev_id", "references", 0.62, 4))
    return near.unionByName(follows).unionByName(refers)


def session_edges(sessions: DataFrame) -> DataFrame:
    """Edges between consecutive sessions (source_id, session_no, session_id, concept_ids) that share concepts."""
    order = Window.partitionBy("source_id").orderBy("session_no")
    rows = sessions.withColumn("prev_id", F.lag("session_id").over(order)).withColumn("prev_concepts", F.lag("concept_ids").over(order)).where("prev_id is not null")
    overlap = F.size(F.array_intersect("concept_ids", "prev_concepts")) / F.greatest(F.size("concept_ids"), F.size("prev_concepts"))
    rows = rows.where((F.size("concept_ids") > 0) & (F.size("prev_concepts") > 0)).withColumn("overlap", overlap)
    goes_on = rows.where("overlap > 0").select(*_edge("prev_id", "session_id", "continues", 0.36 + F.col("overlap"), 5))
    return goes_on.unionByName(rows.where("overlap >= 0.2").select(*_edge("prev_id", "session_id", "same_theme_as", 0.42 + F.col("overlap"), 6)))


def artifact_edges(versions: DataFrame, chars: int | None = COMPARED_CHARS) -> DataFrame:
    """Edges of artifact versions (artifact_id, version_id, previous_version_id, chunk_id, session_id, texts)."""
    parts = [
        versions.select(*_edge("artifact_id", "version_id", "contains", 0.97, 7)),
        versions.select(*_edge("version_id", "artifact_id", "revision_of", 0.94, 8)),
        versions.select(*_edge("version_id", "chunk_id", "materialized_as", 0.99, 9)),
        versions.select("session_id", "artifact_id").distinct().select(*_edge("session_id", "artifact_id", "contains", 0.76, 10)),
        versions.where("previous_version_id is not null").select(*_edge("version_id", "previous_version_id", "derived_from", 0.48 + 0.45 * jaccard(token_set(_leading("text", chars)), token_set(_leading("previous_text", chars))), 11)),
    ]
    return reduce(DataFrame.unionByName, parts)


def cooccurrence_edges(links: DataFrame) -> DataFrame:
    """Concepts that share three chunks or more.

    A chunk's links are joined with each other by chunk, both sides keyed by chunk; counts are
    partial in every task before the pair's shuffle.
    """
    a = links.select("chunk_id", F.col("concept_id").alias("a"))
    b = links.select("chunk_id", F.col("concept_id").alias("b"))
    pairs = a.join(b, "chunk_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 3")
    return pairs.select(*_edge("a", "b", "often_cooccurs_with", 0.35 + 0.08 * F.col("n"), 12))


def label_edges(concepts: DataFrame) -> DataFrame:
    """Concepts with similar labels, and with one label inside another (at most 2000 concepts)."""
    top = concepts.where(F.col("rank") <= MAX_PAIRED).select("concept_id", "label", "rank", F.array_distinct(content_tokens(F.col("label"))).alias("tokens"))
    left = top.select(F.col("concept_id").alias("a"), F.col("rank").alias("ra"), F.col("label").alias("la"), F.col("tokens").alias("ta"))
    right = top.select(F.col("concept_id").alias("b"), F.col("rank").alias("rb"), F.col("label").alias("lb"), F.col("tokens").alias("tb"))
    shared = left.withColumn("t", F.explode("ta")).join(right.withColumn("t", F.explode("tb")), "t").where("ra < rb").select("a", "b", "ta", "tb").dropDuplicates(["a", "b"])
    empty = left.where(F.size("ta") == 0).join(right.where(F.size("tb") == 0), F.expr("ra < rb")).select("a", "b", "ta", "tb")
    similar = shared.unionByName(empty).withColumn("s", jaccard(F.col("ta"), F.col("tb"))).where("s >= 0.45").select(*_edge("a", "b", "related_to", 0.30 + F.col("s"), 13))
    pairs = left.join(F.broadcast(right), F.expr("ra < rb and (contains(lower(la), lower(lb)) or contains(lower(lb), lower(la))) and lower(la) <> lower(lb)"))  # at most 2000 rows
    longer = F.length("la") > F.length("lb")
    inside = pairs.select(*_edge(F.when(longer, F.col("a")).otherwise(F.col("b")), F.when(longer, F.col("b")).otherwise(F.col("a")), "subconcept_of", 0.65, 14))
    return similar.unionByName(inside)


def unique_edges(*parts: DataFrame) -> DataFrame:
    """All edges, one for each (src, dst, type): the one of the earliest rule."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("src", "dst", "type").agg(F.min_by("weight", "ord").alias("weight"))


def degrees(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """How many edges touch each concept, in all and by the other end's kind."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("me"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("me"), F.col("src").alias("other")))).alias("e")).select("e.*")
    kind = lambda pattern: F.coalesce(F.count_if(F.col("other").rlike(pattern)), F.lit(0))
    counts = ends.where(F.col("me").startswith("concept_")).groupBy(F.col("me").alias("concept_id")).agg(F.count("*").alias("degree_total"), kind(r"(?:^|/)chunk_").alias("chunk_degree"), kind(r"^concept_").alias("concept_degree"), kind(r"^artifact_").alias("artifact_degree"))
    rows = concepts.select("concept_id", "label").join(counts, "concept_id", "left")
    return rows.select("concept_id", "label", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("degree_total", "chunk_degree", "concept_degree", "artifact_degree")])
