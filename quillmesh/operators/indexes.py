"""Indexes, manifests and lookups over concepts, chunks and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_tokens, estimated_duration_ms, preview

ADJACENT = ("often_cooccurs_with", "related_to", "subconcept_of")


def keyword_index(concepts: DataFrame) -> DataFrame:
    """(keyword, concept_id), each pair once."""
    return concepts.select(F.explode(F.array_distinct(content_tokens(F.col("label")))).alias("keyword"), "concept_id").distinct()


def concept_index(concepts: DataFrame) -> DataFrame:
    """A label's concept; the last one where a label occurs again."""
    return concepts.groupBy("label").agg(F.max("concept_id").alias("concept_id"))


def concept_adjacency(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(concept_id, neighbour, type, weight) of outgoing edges; a concept without any has nulls."""
    out = edges.where(F.col("type").isin(*ADJACENT)).select(F.col("src").alias("concept_id"), F.col("dst").alias("neighbour"), "type", "weight")
    return concepts.select("concept_id").join(out, "concept_id", "left")


def concept_chunks(links: DataFrame) -> DataFrame:
    return links.select("concept_id", "chunk_id").distinct()


def concept_sessions(links: DataFrame) -> DataFrame:
    return links.select("concept_id", "session_id").distinct()


def session_concepts(links: DataFrame) -> DataFrame:
    """Sessions with their sorted distinct concepts."""
    return links.groupBy("session_id").agg(F.sort_array(F.collect_set("concept_id")).alias("concept_ids"))


def chunk_manifest(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "session_id", "seq_in_session", "start_offset", "end_offset", "kind", "artifact_type", "artifact_label", preview(F.col("text")).alias("preview"))


def session_index(sessions: DataFrame, chunks: DataFrame, rollup: DataFrame) -> DataFrame:
    """Sessions with their chunk counts, speaker flags and rollups."""
    counts = chunks.groupBy("source_id", "session_no").agg(F.count("*").alias("chunk_count"))
    rows = sessions.join(counts, ["source_id", "session_no"], "left").join(rollup, ["source_id", "session_no"], "left")
    return rows.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).withColumn("has_human", F.coalesce(F.col("human_turn_count") > 0, F.lit(False))).withColumn("has_ai", F.coalesce(F.col("ai_turn_count") > 0, F.lit(False)))


def corpus_totals(sources: DataFrame, sessions: DataFrame, chunks: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row of totals with the estimated duration."""
    n = sources.agg(F.count("*").alias("sources"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("text_bytes"))
    rows = n.crossJoin(sessions.agg(F.count("*").alias("sessions"))).crossJoin(chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chunk_chars"))).crossJoin(concepts.agg(F.count("*").alias("concepts")))  # one row each
    return rows.withColumn("estimated_processing_duration_ms", estimated_duration_ms(F.col("text_bytes"), F.col("sessions"), F.col("chunks")))


def compression(bundle: dict[str, DataFrame], chunks: DataFrame, input_bytes: int) -> DataFrame:
    """Input bytes, and chunk characters, over the stored literals' bytes."""
    stored = bundle["literals"].agg(F.sum(F.octet_length("literal")).alias("literal_bytes"))
    return chunks.agg(F.sum(F.length("text")).alias("chunk_chars")).crossJoin(stored).select(F.lit(input_bytes).alias("input_bytes"), "chunk_chars", "literal_bytes", (F.lit(input_bytes) / F.col("literal_bytes")).alias("input_ratio"), (F.col("chunk_chars") / F.col("literal_bytes")).alias("chunk_ratio"))


def retrieve(term: str | DataFrame, concepts: DataFrame, edges: DataFrame, links: DataFrame, chunks: DataFrame, hops: int = 1) -> DataFrame:
    """Chunks of the concepts whose labels hold the term, and of their neighbours, best first.

    The term is a text, or a table of them in column t. A direct hit scores its link; a neighbour's link is multiplied by the edges' weights.
    """
    words = keyword_index(concepts)
    words = words.where(F.col("keyword") == term.lower()) if isinstance(term, str) else words.join(term.select(F.lower("t").alias("keyword")).distinct(), "keyword", "left_semi")
    hits = words.select("concept_id", F.lit(1.0).alias("strength")).distinct()
    near = edges.where(F.col("type").isin(*ADJACENT))
    both = near.select(F.col("src").alias("concept_id"), F.col("dst").alias("to"), "weight").unionByName(near.select(F.col("dst").alias("concept_id"), F.col("src").alias("to"), "weight"))
    reached = hits
    for _ in range(hops):
        step = reached.join(both, "concept_id").select(F.col("to").alias("concept_id"), (F.col("strength") * F.col("weight")).alias("strength"))
        reached = reached.unionByName(step).groupBy("concept_id").agg(F.max("strength").alias("strength"))
    scored = links.join(F.broadcast(reached), "concept_id").groupBy("chunk_id").agg(F.max(F.col("score") * F.col("strength")).alias("score"))  # at most 800 concepts
    return scored.join(chunks.select("chunk_id", "session_id", "text"), "chunk_id").select("chunk_id", "session_id", "score", "text")


def reconstruct_session(streams: DataFrame, refs: DataFrame, texts: DataFrame, roles: DataFrame) -> DataFrame:
    """Sessions' texts from decoded records: ``ROLE: text`` per chunk, a blank line between."""
    rows = streams.select("session_id", "seq", "chunk_id").join(refs, "chunk_id").join(texts, "record").join(roles, "chunk_id", "left")
    line = F.concat(F.upper(F.coalesce("speaker_role", F.lit("unknown"))), F.lit(": "), F.col("text"))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("text"))
