"""Core obsessions: the strongest distinct concepts with the sessions that show them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import DISCOURAGED_LABELS
from ..functions.text import concept_key, content_tokens, jaccard, normalize_space, round_to

MAX_OBSESSIONS, MAX_THREADS, MAX_GRAPH_THREADS = 9, 4, 18
#: What obsessions and threads are marked with in turn.
MARKS = ("<>", "[]", "::", "//", "##", "{}", "++", "**", "==")
ACCENTS = ("#ff7a59", "#1a6b8a", "#f2b134", "#1f8f5f", "#c85c8e", "#5d5fef", "#b86128", "#2b4c7e", "#75814b")
THREAD_MARKS = ("o", "+", "x", "*", "=", "#", "~", ":")


def concept_meta(concepts: DataFrame, sessions_of: DataFrame) -> DataFrame:
    """Concepts with session counts and a score; labels that say nothing are left out after the maxima."""
    counts = sessions_of.groupBy("concept_id").agg(F.countDistinct("session_id").alias("session_count"))
    rows = concepts.join(counts, "concept_id", "left").withColumn("session_count", F.coalesce("session_count", F.lit(0)))
    peaks = rows.agg(F.greatest(F.max("recurrence_count"), F.lit(1)).alias("max_recurrence"), F.greatest(F.max("session_count"), F.lit(1)).alias("max_sessions"))
    n_words = F.size(content_tokens(F.col("label")))
    key = concept_key(F.col("label"))
    score = F.least(F.lit(1.0), F.col("importance") * 0.56 + F.col("recurrence_count") / F.col("max_recurrence") * 0.24 + F.col("session_count") / F.col("max_sessions") * 0.2 + F.when(n_words >= 2, 0.08).otherwise(0.0))
    useful = (F.length(key) >= 3) & ~key.isin(*DISCOURAGED_LABELS) & ~key.rlike(r"^[0-9]+\z") & n_words.between(1, 6)
    out = rows.crossJoin(F.broadcast(peaks)).where(useful)  # one row
    return out.select("concept_id", normalize_space(F.col("label")).alias("label"), key.alias("normalized_label"), "importance", "recurrence_count", "session_count", round_to(score, 4).alias("score"))


def obsessions(meta: DataFrame) -> DataFrame:
    """Up to nine concepts, best first, none like one chosen before.

    Whether a concept is chosen depends on those before it: a fold over the ranked concepts
    (at most 800) in one row.
    """
    item = F.struct((-F.col("score")).alias("k1"), (-F.col("session_count")).alias("k2"), "label", "concept_id", "normalized_label", "importance", "recurrence_count", "session_count", "score", F.array_distinct(content_tokens(F.col("label"))).alias("tokens"))
    ranked = meta.agg(F.array_sort(F.collect_list(item)).alias("ranked"))
    empty = F.expr("filter(ranked, x -> false)")
    like = lambda c, x: (c["normalized_label"] == x["normalized_label"]) | (jaccard(c["tokens"], x["tokens"], 0.0) >= 0.72)
    chosen = F.aggregate("ranked", empty, lambda acc, x: F.when((F.size(acc) >= MAX_OBSESSIONS) | F.exists(acc, lambda c: like(c, x)), acc).otherwise(F.concat(acc, F.array(x))))
    rows = ranked.select(F.posexplode(chosen).alias("i", "x"))
    mark = F.get(F.array(*map(F.lit, MARKS)), F.col("i") % len(MARKS))
    accent = F.get(F.array(*map(F.lit, ACCENTS)), F.col("i") % len(ACCENTS))
    return rows.select((F.col("i") + 1).alias("obsession_no"), "x.concept_id", "x.label", "x.normalized_label", "x.importance", "x.recurrence_count", "x.session_count", "x.score", mark.alias("glyph"), accent.alias("accent"))


def threads(chosen: DataFrame, sessions: DataFrame, sessions_of: DataFrame) -> DataFrame:
    """The four best sessions of every obsession.

    ``sessions`` needs session_id, title, turn_count, chunk_count, has_human and has_ai.
    """
    rows = sessions_of.select("concept_id", "session_id").distinct().join(F.broadcast(chosen), "concept_id").join(sessions, "session_id")  # at most nine rows
    score = F.when(concept_key(F.col("title")).contains(F.col("normalized_label")), 0.35).otherwise(0.0) + F.least(F.lit(1.0), F.col("turn_count") / 12) * 0.32 + F.least(F.lit(1.0), F.col("chunk_count") / 8) * 0.25 + F.when(F.col("has_human") & F.col("has_ai"), 0.08).otherwise(0.0)
    order = Window.partitionBy("concept_id").orderBy(F.desc("s"), F.desc("turn_count"), "title", "session_id")
    ranked = rows.withColumn("s", score).withColumn("thread_rank", F.row_number().over(order)).where(F.col("thread_rank") <= MAX_THREADS)
    number = F.row_number().over(Window.orderBy("obsession_no", "thread_rank"))  # at most 36 rows
    out = ranked.withColumn("n", number)
    mark = F.get(F.array(*map(F.lit, THREAD_MARKS)), (F.col("n") - 1 + F.col("thread_rank") - 1) % len(THREAD_MARKS))
    return out.select(F.format_string("thread_%d", "n").alias("thread_id"), "obsession_no", "concept_id", F.col("label").alias("concept_label"), "session_id", "title", "turn_count", "chunk_count", round_to(F.col("s"), 4).alias("score"), mark.alias("marker"), (F.col("n") <= MAX_GRAPH_THREADS).alias("in_graph"))


def session_raw_text(chunks: DataFrame, chars: int | None = 1200) -> DataFrame:
    """Each session's chunks as ``ROLE: text``, of texts the first ``chars`` characters or, for None, all."""
    text = F.col("text") if chars is None else F.substring("text", 1, chars)
    line = F.concat(F.upper(F.coalesce("speaker_role", F.lit("unknown"))), F.lit(": "), text)
    return chunks.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_in_session", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("text"))


def profile(chosen: DataFrame, input_name: str, n_sessions: int) -> DataFrame:
    """Title, subtitle and summary of the selection."""
    name = normalize_space(F.regexp_replace(F.regexp_replace(F.lit(input_name), r"\.[^.]+\z", ""), r"[_\-]+", " "))
    rows = chosen.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("obsession_no", "label"))).alias("o"))
    lead = F.array_join(F.transform(F.slice("o", 1, 3), lambda x: x["label"]), ", ")
    return rows.select(F.when(name != "", F.concat(name, F.lit(" core obsessions"))).otherwise("Core obsessions").alias("title"), F.concat(F.col("n").cast("string"), F.lit(f" obsessions distilled from {n_sessions} sessions")).alias("subtitle"), F.when(F.col("n") == 0, "No stable recurring concepts were found.").otherwise(F.concat(F.lit("Most persistent motifs: "), lead, F.lit("."))).alias("summary"))
