"""Registered queries over whole tables, one for each operator family.

Where a stage needs chunks but its own rules are the point, the unit is a chat message
(``messages``): chunk_id ``c<conv>/<turn>``, the conversation its session. The folds that
make real sessions and chunks have queries of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import materialize
from ..operators import blocks, chunks, concepts, graph, indexes, obsessions, sessions, speaker, symbols, textpack
from ..operators.artifacts import artifact_versions
from ..sources import conversations, json_flatten, normalize
from .corpus import Corpus, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    QUERIES[f"q_{f.__name__}"] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.text_sources(table(spark, sf_dir, "documents"), "doc_id", "text", "doc")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.render_transcripts(table(spark, sf_dir, "conversations"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages as chunks."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.normalize_space(F.col("text")).alias("text")).where("text <> ''")
    kind = chunks.chunk_kind(F.col("text"))
    shape = chunks.artifact_type(F.col("text"))
    return rows.select(
        F.format_string("c%06d", "conv_id").alias("session_id"), F.format_string("c%06d/%04d", "conv_id", "turn").alias("chunk_id"), "conv_id", F.col("turn").alias("seq_in_session"), "role", "text", kind.alias("kind"), shape.alias("artifact_type"), chunks.artifact_label(F.col("text"), shape).alias("artifact_label"), F.lit(0).alias("start_offset")
    )


def _concepts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, ranked concepts and links; phrases, concepts and links are written once for all that read them."""
    m = messages(spark, sf_dir)
    found = materialize(concepts.candidates(m), "candidates")
    ranked = materialize(concepts.concept_table(found, m.agg(F.count("*").alias("n"))), "concepts")
    return m, ranked, materialize(concepts.chunk_concepts(found, ranked), "links")


# ---------------------------------------------------------------- sources


@_query
def line_normalize(spark, sf_dir):
    return documents(spark, sf_dir).select("source_id", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def html_to_text(spark, sf_dir):
    return normalize.html_sources(table(spark, sf_dir, "pages")).select("source_id", "text")


@_query
def transcript_render(spark, sf_dir):
    return transcripts(spark, sf_dir).select("source_id", "text")


@_query
def role_normalize(spark, sf_dir):
    role = normalize.chat_role(F.col("role"))
    return table(spark, sf_dir, "conversations").select(role.alias("chat_role"), normalize.speaker_label(role).alias("label")).groupBy("chat_role", "label").agg(F.count("*").alias("n"))


@_query
def json_flatten_props(spark, sf_dir):
    return json_flatten.flatten_json(table(spark, sf_dir, "events"), "event_id", "props").select("event_id", "line_no", "path", "value")


@_query
def json_fragment_udtf(spark, sf_dir):
    """Events' properties cut out of their braces, as a slice of a larger file would be."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("substring(props, 2, length(props) - 2)").alias("part"))
    return json_flatten.flatten_json(rows, "event_id", "part").select("event_id", "path", "value")


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as exports: a mapping of linked nodes in reverse, with a branch that was given up."""
    name = lambda i: F.format_string("n%06d", i)
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    message = lambda role, text: F.struct(F.struct(role.alias("role")).alias("author"), F.struct(F.array(text).alias("parts")).alias("content"))
    node = lambda m, parent: F.struct(m.alias("message"), parent.alias("parent"))
    said = F.transform("t", lambda x, i: F.struct(name(i).alias("key"), node(message(x["role"], x["text"]), F.when(i > 0, name(i - 1))).alias("value")))
    side = F.array(F.struct(F.lit("side").alias("key"), node(message(F.lit("assistant"), F.lit("given up")), name(F.lit(0))).alias("value")))
    nodes = F.map_from_entries(F.reverse(F.when(F.size("t") > 1, F.concat(said, side)).otherwise(said)))
    whole = F.struct(F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"), nodes.alias("mapping"), name(F.size("t") - 1).alias("current_node"))
    return turns.select(F.format_string("conv:%06d", "conv_id").alias("source_id"), F.to_json(whole).alias("raw"))


@_query
def mapping_order(spark, sf_dir):
    """Exports rendered by their current node's chain of parents."""
    return conversations.json_texts(exports(spark, sf_dir), "source_id", "raw").where(F.col("text").startswith("# Conversation: ")).select("source_id", "text")


@_query
def json_path_filter(spark, sf_dir):
    """Content lines of the exports by what is kept of their paths."""
    lines = json_flatten.flatten_json(exports(spark, sf_dir), "source_id", "raw").select(json_flatten.compact_path(F.col("path")).alias("path"))
    return lines.where("path <> ''").groupBy("path").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- blocks


@_query
def line_types(spark, sf_dir):
    return blocks.typed_lines(documents(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"), F.count(F.when(F.col("trimmed").rlike(blocks.TIMESTAMP), 1)).alias("n_timestamp"))


@_query
def blocks_of_documents(spark, sf_dir):
    return blocks.blocks(documents(spark, sf_dir)).select("source_id", "block_no", "type", "leading_blank_lines", "start_offset", "end_offset", "text", "has_timestamp")


@_query
def block_speaker(spark, sf_dir):
    return blocks.blocks(transcripts(spark, sf_dir)).select("source_id", "block_no", "type", "leading_blank_lines", F.col("speaker.label").alias("label"), F.col("speaker.role").alias("role"), F.col("speaker.source").alias("source"), F.col("speaker.confidence").alias("confidence"))


@_query
def session_speakers(spark, sf_dir):
    t = Corpus(transcripts(spark, sf_dir)).turns
    return speaker.session_speakers(t).select("source_id", "session_no", "role", "turn_count", "block_count", F.array_join("labels", ",").alias("labels"))


@_query
def session_rollup(spark, sf_dir):
    return speaker.session_rollup(Corpus(transcripts(spark, sf_dir)).turns)


@_query
def turn_inference(spark, sf_dir):
    """Every document's blocks as one session."""
    rows = blocks.blocks(documents(spark, sf_dir)).withColumn("session_no", F.lit(1))
    t = speaker.inferred_turns(speaker.turns(speaker.with_turns(rows)))
    return t.select("source_id", "turn_index", "block_count", F.col("speaker.role").alias("role"), F.col("speaker.source").alias("source"), F.col("speaker.confidence").alias("confidence"))


# ---------------------------------------------------------------- sessions and chunks


@_query
def boundary_scores(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("source_id").orderBy("block_no")
    return blocks.blocks(documents(spark, sf_dir)).withColumn("score", sessions.boundary_score(order)).select("source_id", "block_no", F.when(F.col("block_no") > 1, F.col("score")).alias("score"))


@_query
def sessions_of_documents(spark, sf_dir):
    return sessions.session_texts(sessions.with_sessions(blocks.blocks(documents(spark, sf_dir)))).select("source_id", "session_no", "title", "start_offset", "end_offset", "block_count")


@_query
def sentences(spark, sf_dir):
    rows = documents(spark, sf_dir).select("source_id", F.posexplode(T.sentences(F.col("text"))).alias("k", "s"))
    return rows.select("source_id", "k", F.col("s.text").alias("text"), F.col("s.start").cast("long").alias("start"))


@_query
def chunks_of_documents(spark, sf_dir):
    return Corpus(documents(spark, sf_dir)).chunks.select("source_id", "session_no", "seq_in_session", "start_offset", "end_offset", "kind", "artifact_type", "speaker_role", "speaker_confidence", "turn_count", "text")


@_query
def chunk_kind(spark, sf_dir):
    rows = documents(spark, sf_dir).select("source_id", F.posexplode(T.sentences(F.col("text"))).alias("k", "s"))
    return rows.select(chunks.chunk_kind(F.col("s.text")).alias("kind"), F.coalesce(chunks.artifact_type(F.col("s.text")), F.lit("none")).alias("artifact_type")).groupBy("kind", "artifact_type").agg(F.count("*").alias("n"))


@_query
def artifact_labels(spark, sf_dir):
    return messages(spark, sf_dir).where("artifact_type is not null").select("chunk_id", "artifact_type", "artifact_label")


# ---------------------------------------------------------------- concepts


@_query
def concept_candidates(spark, sf_dir):
    return concepts.candidates(messages(spark, sf_dir)).select("chunk_id", "surface", "key", "weight")


@_query
def concepts_topk(spark, sf_dir):
    return _concepts(spark, sf_dir)[1].select("concept_id", "key", "label", "importance", "recurrence_count", "total", "sessions")


@_query
def chunk_concepts(spark, sf_dir):
    return _concepts(spark, sf_dir)[2].select("chunk_id", "concept_id", T.round_to(F.col("score"), 6).alias("score"), "link_rank")


@_query
def artifact_version_list(spark, sf_dir):
    rows = artifact_versions(messages(spark, sf_dir).withColumn("ord", F.col("session_id")))
    return rows.select("artifact_key", "artifact_type", "label", "version_index", "chunk_id", "previous_chunk_id")


# ---------------------------------------------------------------- textpack


@_query
def lexicon(spark, sf_dir):
    return textpack.lexicon(messages(spark, sf_dir))


@_query
def templates(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.col("source_id").alias("chunk_id"), "text")
    return textpack.templates(rows).select("prefix", "suffix", "recurrence_count")


@_query
def dedupe_records(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.col("source_id").alias("chunk_id"), "text")
    r = textpack.records(rows, "chunk_id")
    return r.select(F.col("first.chunk_id").alias("chunk_id"), F.size("chunk_ids").cast("long").alias("n_chunks"), F.sha2("text", 256).alias("text_hash"))


@_query
def textpack_roundtrip(spark, sf_dir):
    """Decodes every record of the messages' bundle; all must come back."""
    m = messages(spark, sf_dir)
    bundle = textpack.encode(m, "session_id", "seq_in_session", sample=None)
    bad = textpack.validate(bundle, m).agg(F.count("*").alias("failures"))
    return m.agg(F.count("*").alias("chunks")).crossJoin(bad)


@_query
def reconstruct_session(spark, sf_dir):
    """Conversations put together again from the messages' decoded records."""
    m = messages(spark, sf_dir)
    bundle = textpack.encode(m, "session_id", "seq_in_session", sample=None)
    return indexes.reconstruct_session(m.select("session_id", F.col("seq_in_session").alias("seq"), "chunk_id"), bundle["refs"], textpack.decode(bundle), m.select("chunk_id", F.col("role").alias("speaker_role")))


# ---------------------------------------------------------------- graph


def _sessions(m: DataFrame, links: DataFrame) -> DataFrame:
    rows = m.select("session_id").distinct().withColumn("source_id", F.lit("all")).withColumn("session_no", F.substring("session_id", 2, 20).cast("long"))
    return rows.join(indexes.session_concepts(links), "session_id", "left").withColumn("concept_ids", F.coalesce("concept_ids", F.array().cast("array<string>")))


@_query
def edges_topic(spark, sf_dir):
    return graph.topic_edges(_concepts(spark, sf_dir)[2]).drop("ord")


@_query
def edges_sequence(spark, sf_dir):
    return graph.sequence_edges(messages(spark, sf_dir), chars=None).drop("ord")


@_query
def edges_cooccur(spark, sf_dir):
    return graph.cooccurrence_edges(_concepts(spark, sf_dir)[2]).drop("ord")


@_query
def edges_labels(spark, sf_dir):
    return graph.label_edges(_concepts(spark, sf_dir)[1]).drop("ord")


@_query
def edges_continues(spark, sf_dir):
    """Edges between conversations that follow one another and share concepts."""
    m, _, links = _concepts(spark, sf_dir)
    return graph.session_edges(_sessions(m, links)).drop("ord")


@_query
def edges_artifacts(spark, sf_dir):
    return graph.unique_edges(graph.artifact_edges(versions(messages(spark, sf_dir)), chars=None))


def _edges(spark, sf_dir):
    m, ranked, links = _concepts(spark, sf_dir)
    v = versions(m)
    return m, ranked, links, graph.unique_edges(graph.topic_edges(links), graph.artifact_mentions(links, v), graph.sequence_edges(m, chars=None), graph.session_edges(_sessions(m, links)), graph.artifact_edges(v, chars=None), graph.cooccurrence_edges(links), graph.label_edges(ranked))


@_query
def concept_degrees(spark, sf_dir):
    _, ranked, links = _concepts(spark, sf_dir)
    e = graph.unique_edges(graph.topic_edges(links), graph.cooccurrence_edges(links), graph.label_edges(ranked))
    rows = e.withColumn("src", F.when(F.col("src").startswith("concept_"), F.col("src")).otherwise(F.concat(F.lit("chunk_"), "src"))).withColumn("dst", F.when(F.col("dst").startswith("concept_"), F.col("dst")).otherwise(F.concat(F.lit("chunk_"), "dst")))
    return graph.degrees(rows, ranked)


@_query
def graph_build(spark, sf_dir):
    return _edges(spark, sf_dir)[3].groupBy("type").agg(F.count("*").alias("n"), T.round_to(F.max("weight"), 4).alias("max_weight"))


# ---------------------------------------------------------------- symbols, indexes, obsessions


@_query
def glyph_profile(spark, sf_dir):
    rows = messages(spark, sf_dir).select("chunk_id", symbols.glyph_profile(F.col("text"), F.col("kind"), F.col("artifact_type")).alias("g"))
    return rows.select("chunk_id", "g.glyph", "g.probability")


@_query
def symbol_clusters(spark, sf_dir):
    _, ranked, links = _concepts(spark, sf_dir)
    e = graph.unique_edges(graph.cooccurrence_edges(links), graph.label_edges(ranked))
    return symbols.symbol_library(symbols.clusters(spark, ranked, e), ranked).withColumn("concept_ids", F.array_join("concept_ids", ","))


@_query
def keyword_index(spark, sf_dir):
    return indexes.keyword_index(_concepts(spark, sf_dir)[1])


@_query
def concept_index(spark, sf_dir):
    return indexes.concept_index(_concepts(spark, sf_dir)[1])


@_query
def concept_sessions(spark, sf_dir):
    return indexes.concept_sessions(_concepts(spark, sf_dir)[2])


@_query
def concept_adjacency(spark, sf_dir):
    _, ranked, links = _concepts(spark, sf_dir)
    return indexes.concept_adjacency(ranked, graph.unique_edges(graph.cooccurrence_edges(links), graph.label_edges(ranked)))


@_query
def concept_meta(spark, sf_dir):
    _, ranked, links = _concepts(spark, sf_dir)
    return obsessions.concept_meta(ranked, links).select("concept_id", "label", "session_count", "score")


@_query
def obsession_threads(spark, sf_dir):
    m, ranked, links = _concepts(spark, sf_dir)
    chosen = obsessions.obsessions(obsessions.concept_meta(ranked, links))
    s = m.groupBy("session_id").agg(F.count("*").alias("turn_count"), F.count("*").alias("chunk_count"), F.max(F.col("role") == "user").alias("has_human"), F.max(F.col("role") == "assistant").alias("has_ai"), F.min_by("text", "seq_in_session").alias("first"))
    s = s.withColumn("title", T.safe_title(F.col("first"), F.col("session_id"))).drop("first")
    return obsessions.threads(chosen, s, links)


@_query
def session_raw_text(spark, sf_dir):
    return obsessions.session_raw_text(messages(spark, sf_dir).withColumn("speaker_role", F.col("role")), chars=None)


@_query
def corpus_totals(spark, sf_dir):
    """Totals over the messages, a source and a session for each conversation."""
    m, ranked, _ = _concepts(spark, sf_dir)
    sources = m.groupBy("session_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    return indexes.corpus_totals(sources, sources, m, ranked)


@_query
def retrieve_term(spark, sf_dir):
    """Chunks for the first word of the most important concept."""
    m, ranked, links = _concepts(spark, sf_dir)
    e = graph.unique_edges(graph.cooccurrence_edges(links), graph.label_edges(ranked))
    top = ranked.where("rank = 1").select(F.get(T.content_tokens(F.col("label")), F.lit(0)).alias("t"))
    return indexes.retrieve(top, ranked, e, links, m).select("chunk_id", T.round_to(F.col("score"), 6).alias("score"))


@_query
def corpus_kinds(spark, sf_dir):
    """Chunk kinds by speaker over the rendered transcripts: the whole path to chunks."""
    return Corpus(transcripts(spark, sf_dir)).chunks.groupBy("speaker_role", "kind").agg(F.count("*").alias("n"))
