"""Chunking: a session's blocks become units, units are packed greedily into chunks.

Packing is a fold over a session's units, like the sessions' one: its state keeps the current
length and the last unit's speaker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CHUNK_SIZES, CUE, DECLARATION, HEADING, JSON_KEY, JSON_SHAPES, KIND_CUES, SECTION_SHAPES, TABLE_SHAPE
from ..functions.folds import folded
from ..functions.text import leading_words, normalize_space, sentences, word
from .speaker import _best, sequence_preview

WHOLE = ("code", "quote", "table", "json", "section")


def chunk_kind(text: Column, quoted: Column | None = None) -> Column:
    """error, decision, request, task, quote, fact or statement; the first rule that holds."""
    low = F.lower(text)
    is_quote = text.rlike("\"[^\"]+\"|'[^']+'")
    return (
        F.when(low.rlike(word(KIND_CUES["error"])), "error")
        .when(low.rlike(word(KIND_CUES["decision"])), "decision")
        .when(low.rlike(word(KIND_CUES["request"])), "request")
        .when(low.rlike(word(KIND_CUES["task"])), "task")
        .when(is_quote if quoted is None else (quoted | is_quote), "quote")
        .when(low.rlike(word(KIND_CUES["fact"])), "fact")
        .otherwise("statement")
    )


def artifact_type(text: Column, types: Column | None = None) -> Column:
    """code, table, json_object, document_section or null, by block types and by shape."""
    has = lambda t: F.array_contains(types, t) if types is not None else F.lit(False)
    table = text.contains("|") | text.rlike(TABLE_SHAPE)
    jsonish = F.trim(text).rlike(JSON_SHAPES[0]) | text.rlike(JSON_SHAPES[1])
    section = text.rlike(SECTION_SHAPES[0]) | F.trim(text).rlike(SECTION_SHAPES[1])
    return F.when(has("code"), "code").when(has("table") | table, "table").when(has("json") | jsonish, "json_object").when(has("section") | section, "document_section")


def artifact_label(text: Column, kind: Column) -> Column:
    """A declared name, the first keys, a heading, else leading words."""
    name = F.regexp_extract(text, DECLARATION, 1)
    keys = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(JSON_KEY), F.lit(1)), 1, 4), " ")
    heading = normalize_space(F.regexp_extract(text, HEADING, 1))
    words = F.when(kind == "table", leading_words(text, 10)).otherwise(leading_words(text, 12))
    default = F.when(words != "", words).otherwise(F.substring(normalize_space(text), 1, 80))
    return F.when(kind.isNull(), F.lit(None)).when((kind == "code") & (name != ""), name).when((kind == "json_object") & (keys != ""), keys).when((kind == "document_section") & (heading != ""), heading).otherwise(default)


def is_cue(text: Column) -> Column:
    """Words that open a new thought; ``next,`` only before a word character."""
    return F.lower(text).rlike(CUE)


def is_complete(text: Column) -> Column:
    return F.trim(text).rlike(r"[.!?)]\z")


def units(blocks: DataFrame, size: str = "medium") -> DataFrame:
    """Whole short or structural blocks and the sentences of long ones, numbered per session."""
    _, target, _ = CHUNK_SIZES[size]
    text = normalize_space(F.col("text"))
    whole = F.col("type").isin(*WHOLE) | (F.length(text) <= target * 1.5)
    one = F.array(F.struct(text.alias("text"), F.lit(0).alias("start"), (F.col("end_offset") - F.col("start_offset")).cast("int").alias("stop")))
    rows = blocks.where(text != "").withColumn("_u", F.when(whole, one).otherwise(sentences(F.when(~whole, F.col("text")))))
    rows = rows.select("source_id", "session_no", "block_no", "type", "speaker", "turn_index", "turn_role", "start_offset", F.posexplode("_u").alias("k", "u"))
    return rows.select("source_id", "session_no", "block_no", "k", F.col("type").alias("block_type"), "speaker", "turn_index", F.coalesce("turn_role", "speaker.role").alias("turn_role"), F.col("u.text").alias("text"), (F.col("start_offset") + F.col("u.start")).alias("start_offset"), (F.col("start_offset") + F.col("u.stop")).alias("end_offset"))


class Packing:
    """The fold over one session's units: the number of the chunk a unit goes to."""

    def __init__(self, size: str):
        self.low, self.target, self.high = CHUNK_SIZES[size]
        self.cue_at = int(self.low * 0.7 + 0.5)

    def start(self) -> None:
        self.run, self.chunk, self.last = 0, 0, (None, None, None)

    def step(self, n: int, cue: bool, done: bool, turn: int | None, role: str | None, label: str | None) -> int:
        differ = lambda a, b: a is not None and b is not None and a != b
        was_turn, was_role, was_label = self.last
        switch = differ(was_turn, turn) or (differ(was_role, role) and "unknown" not in (was_role, role)) or differ(was_label, label)
        if self.run == 0 or (self.run + n > self.high and self.run >= self.low) or switch or (cue and self.run >= self.cue_at):
            self.chunk, self.run = self.chunk + 1, 0
        self.run += n
        self.last = turn, role, label
        if self.run >= self.target and done:
            self.run = 0
        return self.chunk


def chunk_speaker(us: Column) -> Column:
    """The chunk's speaker of its units: one role, mixed, or unknown."""
    speakers = F.transform(us, lambda u: u["speaker"])
    best = _best(speakers)
    known = F.filter(speakers, lambda s: s["role"] != "unknown")
    roles, labels = F.array_distinct(F.transform(known, lambda s: s["role"])), F.array_distinct(F.filter(F.transform(known, lambda s: s["label"]), lambda x: x.isNotNull()))
    turns = F.array_distinct(F.filter(F.transform(us, lambda u: u["turn_index"]), lambda x: x.isNotNull()))
    turn_roles = F.array_distinct(F.filter(F.transform(us, lambda u: u["turn_role"]), lambda x: x.isNotNull()))
    n_turns = F.when(F.size(turns) > 0, F.size(turns)).otherwise(F.size(us))
    entries = F.array_distinct(F.transform(us, lambda u: F.struct(u["turn_index"].alias("turn_index"), F.coalesce(u["turn_role"], F.lit("unknown")).alias("role"), u["speaker"]["label"].alias("label"))))
    mixed, none = F.size(roles) > 1, F.size(roles) == 0
    return F.struct(
        F.when(none, "unknown").when(mixed, "mixed").otherwise(F.get(roles, F.lit(0))).alias("speaker_role"),
        F.when(none | mixed, F.lit(None)).when(F.size(labels) == 1, F.get(labels, F.lit(0))).otherwise(best["label"]).alias("speaker_label"),
        F.when(none | mixed, "unknown").otherwise(best["source"]).alias("speaker_inference_source"),
        F.when(none, 0.0).when(mixed, 0.35).otherwise(best["confidence"]).alias("speaker_confidence"),
        F.when(~mixed & (F.size(turns) == 1), F.get(turns, F.lit(0))).alias("turn_index"),
        F.when(mixed, F.lit(None)).when(F.size(turn_roles) == 1, F.get(turn_roles, F.lit(0))).otherwise(F.coalesce(F.get(roles, F.lit(0)), F.lit("unknown"))).alias("turn_role"),
        F.greatest(F.when(mixed, 2).otherwise(1), n_turns).alias("turn_count"),
        sequence_preview(entries).alias("speaker_sequence_preview"),
    )


def chunks(unit_rows: DataFrame, size: str = "medium") -> DataFrame:
    """Chunks of every session with kind, artifact and speaker; seq_in_session counts from 1."""
    group, order = ("source_id", "session_no"), ("block_no", "k")
    known = Window.partitionBy(*group).orderBy(*order)  # deals and sorts the units, as the fold needs them
    rows = unit_rows.select("*", F.length("text").alias("n"), is_cue(F.col("text")).alias("cue"), is_complete(F.col("text")).alias("done"), F.col("speaker.label").alias("label"), F.row_number().over(known).alias("place"))
    rows = folded(rows, group, order, ("n", "cue", "done", "turn_index", "turn_role", "label"), "seq_in_session", lambda: Packing(size))
    fields = ("place", "block_type", "speaker", "turn_index", "turn_role", "text", "start_offset", "end_offset")
    each = rows.groupBy(*group, "seq_in_session").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("u"))  # a chunk's units
    text = normalize_space(F.array_join(F.transform("u", lambda u: u["text"]), " "))
    types = F.array_distinct(F.transform("u", lambda u: u["block_type"]))
    rows = each.select(*group, "seq_in_session", F.get("u", F.lit(0))["start_offset"].alias("start_offset"), F.element_at("u", -1)["end_offset"].alias("end_offset"), text.alias("text"), types.alias("source_block_types"), chunk_speaker(F.col("u")).alias("s"))
    rows = rows.withColumn("kind", chunk_kind(F.col("text"), F.array_contains("source_block_types", "quote"))).withColumn("artifact_type", artifact_type(F.col("text"), F.col("source_block_types")))
    rows = rows.withColumn("artifact_label", artifact_label(F.col("text"), F.col("artifact_type")))
    session = F.concat_ws("/", "source_id", F.format_string("sess_%06d", "session_no"))
    return rows.select("*", "s.*").drop("s").withColumn("session_id", session).withColumn("chunk_id", F.concat_ws("/", session, F.format_string("chunk_%06d", "seq_in_session")))
