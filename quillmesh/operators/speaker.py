"""Speaker identity: labels and metadata in blocks, turns, and inferred alternation.

Filling unlabelled turns is closed-form: a turn's role and confidence follow from its
distance to the nearest labelled turn, so windows do what a scan would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CANONICAL_NAMES, ROLE_ALIASES, ROLE_ORDER
from ..functions.text import SPACE, normalize_space, round_to, trim_space

#: Metadata patterns with their confidence; the last needs one of three words in the text.
_NAME = r'"?([A-Za-z][A-Za-z0-9_\- ]{0,30})"?'
METADATA = (
    (rf'(?im)(?:^|[\r\n])\s*"?message\.author\.role"?\s*[:=]\s*{_NAME}', 0.95, None),
    (rf'(?im)(?:^|[\r\n])\s*"?author\.role"?\s*[:=]\s*{_NAME}', 0.95, None),
    (rf'(?im)(?:^|[\r\n])\s*"?speaker_role"?\s*[:=]\s*{_NAME}', 0.92, None),
    (r'(?im)"author"\s*:\s*\{[\s\S]{0,200}?"role"\s*:\s*"([A-Za-z][A-Za-z0-9_\- ]{0,30})"', 0.9, None),
    (r'(?im)(?:^|[\r\n])\s*"?role"?\s*:\s*"?(user|assistant|human|ai|model|system|tool|browser|search|function|shell|mcp|chatgpt|gpt|altair|ankaa)"?', 0.88, r"(?i)author|message|speaker"),
)
EXPLICIT = r"^([A-Za-z][A-Za-z0-9_ .\-()]{0,60})\s*:\s+\S"


def normalize_speaker(label: Column) -> Column:
    t = F.regexp_replace(F.lower(normalize_space(label)), r"[\"'`\[\]{}()]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[._\-]+", " "), r"\s+", " "))


def role_of(label: Column) -> Column:
    """The role a label names, by whole words and in the roles' order; null if none."""
    n = normalize_speaker(label)
    words = F.split(n, " ")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for role, aliases in ROLE_ALIASES.items():
        out = out.when(F.arrays_overlap(words, F.array(*map(F.lit, aliases))), role)
    return out.when(n.rlike(r"^gpt(?:[- ]?[0-9]+(?:\.[0-9]+)?)?\z"), "ai")


def _among(n: Column, role: Column, names: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(False)
    for r, known in names.items():
        out = out | ((role == r) & n.isin(*known))
    return out


def explicit_confidence(label: Column, role: Column) -> Column:
    n = normalize_speaker(label)
    return F.when((n == role) | _among(n, role, CANONICAL_NAMES), 0.98).when(_among(n, role, ROLE_ALIASES), 0.9).otherwise(0.88)


def _speaker(label: Column, role: Column, source: str, confidence: Column) -> Column:
    return F.struct(label.alias("label"), role.alias("role"), F.lit(source).alias("source"), confidence.cast("double").alias("confidence"))


def block_speaker(text: Column, kind: Column) -> Column:
    """struct(label, role, source, confidence): an opening label, else the first metadata pattern."""
    first = trim_space(F.regexp_extract(text, rf"^{SPACE}*([^\n]*)", 1))
    label = F.trim(F.regexp_extract(first, EXPLICIT, 1))
    role = role_of(label)
    out = F.when((kind != "code") & (label != "") & role.isNotNull(), _speaker(label, role, "explicit_label", explicit_confidence(label, role)))
    # The first pattern that matches decides, even if its label names no role.
    found = F.when(F.lit(False), F.struct(F.lit("").alias("name"), F.lit(0.0).alias("base")))
    for pattern, base, needs in METADATA:
        name = F.trim(F.regexp_extract(text, pattern, 1))
        hit = (name != "") & (text.rlike(needs) if needs else F.lit(True))
        found = found.when(hit, F.struct(name.alias("name"), F.lit(base).alias("base")))
    name, base = found["name"], found["base"]
    meta_role = role_of(name)
    n = normalize_speaker(name)
    confidence = F.when(_among(n, meta_role, CANONICAL_NAMES), base).when(_among(n, meta_role, ROLE_ALIASES), F.least(base, F.lit(0.9))).otherwise(base)
    # All patterns hold the word role; few texts do, and the others need no search.
    out = out.when(F.lower(text).contains("role") & meta_role.isNotNull(), _speaker(name, meta_role, "metadata_pattern", confidence))
    return out.otherwise(_speaker(F.lit(None).cast("string"), F.lit("unknown"), "unknown", F.lit(0.0)))


# ---------------------------------------------------------------- turns

_SOURCE_RANK = {"explicit_label": 4, "metadata_pattern": 3, "turn_alternation": 2, "session_default": 1}


def source_rank(source: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, rank in _SOURCE_RANK.items():
        out = out.when(source == name, rank)
    return out.otherwise(0)


def _best(rows: Column) -> Column:
    """The best of structs with role, label, source and confidence."""
    keyed = F.transform(F.filter(rows, lambda s: s["role"] != "unknown"), lambda s: F.struct((-s["confidence"]).alias("k1"), (-source_rank(s["source"])).alias("k2"), F.when(s["label"].isNull(), 1).otherwise(0).alias("k3"), s["role"].alias("role"), s["label"].alias("label"), s["source"].alias("source"), s["confidence"].alias("confidence")))
    return F.array_min(keyed)


def best_speaker(rows: Column) -> Column:
    """The turn's speaker of its blocks' speakers: the best one, unless other roles come near it."""
    best = _best(rows)
    near = F.filter(rows, lambda s: (s["role"] != "unknown") & (s["confidence"] >= F.greatest(F.lit(0.72), best["confidence"] - 0.08)))
    roles = F.size(F.array_distinct(F.transform(near, lambda s: s["role"])))
    unknown = _speaker(F.lit(None).cast("string"), F.lit("unknown"), "unknown", F.lit(0.0))
    chosen = F.struct(best["label"].alias("label"), best["role"].alias("role"), best["source"].alias("source"), best["confidence"].alias("confidence"))
    return F.when(best.isNull() | ((roles > 1) & (best["confidence"] < 0.94)), unknown).otherwise(chosen)


def with_turns(rows: DataFrame) -> DataFrame:
    """Blocks of sessions with turn_index (null for sections)."""
    order = Window.partitionBy("source_id", "session_no", "is_section").orderBy("block_no")
    prev = lambda c: F.lag(c).over(order)
    rows = rows.withColumn("is_section", F.col("type") == "section")
    role, label = F.col("speaker.role"), F.col("speaker.label")
    changed = ((prev("speaker.role") != "unknown") & (role != "unknown") & (prev("speaker.role") != role)) | (prev("speaker.label") != label)
    new = prev("block_no").isNull() | (F.col("leading_blank_lines") >= 1) | prev("has_timestamp") | F.col("has_timestamp") | F.coalesce(changed, F.lit(False))
    rows = rows.withColumn("_new", F.when(~F.col("is_section"), new.cast("int")))
    return rows.withColumn("turn_index", F.when(~F.col("is_section"), F.sum("_new").over(order))).drop("_new", "is_section")


def turns(rows: DataFrame) -> DataFrame:
    """One row per turn with the speaker its blocks give it, before inference."""
    grouped = rows.where("turn_index is not null").groupBy("source_id", "session_no", "turn_index").agg(
        F.collect_list("speaker").alias("speakers"), F.count("*").alias("block_count"), F.max("has_timestamp").alias("breaks"), F.max((~F.col("type").isin("code", "json", "quote", "section"))).alias("conversational")
    )
    return grouped.withColumn("speaker", best_speaker(F.col("speakers"))).drop("speakers")


def inferred_turns(rows: DataFrame) -> DataFrame:
    """Turns with the unknown ones filled by alternation.

    Turns fall into runs, split at system and tool turns, at turns without conversational
    blocks and before turns with a timestamp. In a run: no labelled turn seeds an
    alternation; gaps whose ends agree with an alternation are filled from both ends; the
    rest continues from the last labelled turn, or backwards from the first one.
    """
    session = Window.partitionBy("source_id", "session_no").orderBy("turn_index")
    role = F.col("speaker.role")
    rows = rows.withColumn("candidate", ~role.isin("system", "tool") & F.col("conversational"))
    cut = (~F.col("candidate") | F.col("breaks") | F.coalesce(~F.lag("candidate").over(session), F.lit(True))).cast("int")
    rows = rows.withColumn("run", F.sum(cut).over(session))
    run = Window.partitionBy("source_id", "session_no", "run").orderBy("turn_index")
    whole = Window.partitionBy("source_id", "session_no", "run")
    anchor = F.when(role.isin("human", "ai"), F.struct("turn_index", role.alias("role"), F.col("speaker.confidence").alias("confidence")))
    rows = rows.withColumn("pos", F.row_number().over(run)).withColumn("size", F.count("*").over(whole)).withColumn("anchors", F.count(anchor).over(whole))
    rows = rows.withColumn("left", F.last(anchor, ignorenulls=True).over(run)).withColumn("right", F.first(anchor, ignorenulls=True).over(run.rowsBetween(0, Window.unboundedFollowing)))
    prior = F.last(anchor, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    agrees = lambda a, b: ((b["turn_index"] - a["turn_index"]) % 2 == 0) == (a["role"] == b["role"])
    rows = rows.withColumn("_agrees", F.when(anchor.isNotNull(), agrees(prior, F.struct("turn_index", role.alias("role")))))
    rows = rows.withColumn("parity", F.coalesce(F.max("_agrees").over(whole), F.lit(False)))

    back, ahead = F.col("turn_index") - F.col("left.turn_index"), F.col("right.turn_index") - F.col("turn_index")
    flip = lambda r, n: F.when(n % 2 == 0, r).otherwise(F.when(r == "ai", "human").otherwise("ai"))
    chain = lambda c, n, base, floor: F.greatest(F.lit(floor), F.least(base, c - 0.08) - (n - 1) * 0.08)
    two = (F.col("anchors") >= 2) & F.col("parity")
    gap = two & F.col("left").isNotNull() & F.col("right").isNotNull() & agrees(F.col("left"), F.col("right"))
    say = lambda r, s, c: F.struct(F.lit(None).cast("string").alias("label"), r.alias("role"), F.lit(s).alias("source"), round_to(c, 2).alias("confidence"))
    onward = lambda base_two, base_one, r, n, c: F.when(two, say(flip(r, n), "turn_alternation", chain(c, n, F.lit(base_two), 0.45))).otherwise(say(flip(r, n), "session_default", chain(c, n, F.lit(base_one), 0.35)))
    filled = (
        F.when(gap, say(flip(F.col("left.role"), back), "turn_alternation", F.greatest(F.lit(0.52), F.lit(0.74) - (F.least(back, ahead) - 1) * 0.06)))
        .when(F.col("left").isNotNull(), onward(0.70, 0.55, F.col("left.role"), back, F.col("left.confidence")))
        .when(F.col("right").isNotNull(), onward(0.66, 0.50, F.col("right.role"), ahead, F.col("right.confidence")))
        .when(F.col("size") >= 2, say(flip(F.lit("human"), F.col("pos") - 1), "session_default", F.greatest(F.lit(0.35), F.lit(0.55) - (F.col("pos") - 1) * 0.08)))
        .otherwise(F.col("speaker"))
    )
    final = F.when(F.col("candidate") & (role == "unknown"), filled).otherwise(F.col("speaker"))
    return rows.select("source_id", "session_no", "turn_index", "block_count", "breaks", final.alias("speaker"))


def annotated_blocks(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """Blocks with turn_index, turn_role and, where they have none, the turn's speaker."""
    t = settled.select("source_id", "session_no", "turn_index", F.col("speaker").alias("turn"))
    joined = rows.join(t, ["source_id", "session_no", "turn_index"], "left")
    s, known = F.col("speaker"), F.col("turn.source").isin("explicit_label", "metadata_pattern")
    takes = (s["role"] == "unknown") & F.coalesce(F.col("turn.role") != "unknown", F.lit(False))
    label = F.coalesce(s["label"], F.when(known, F.col("turn.label")))
    merged = F.struct(label.alias("label"), F.when(takes, F.col("turn.role")).otherwise(s["role"]).alias("role"), F.when(takes, F.col("turn.source")).otherwise(s["source"]).alias("source"), F.when(takes, F.col("turn.confidence")).otherwise(s["confidence"]).alias("confidence"))
    return joined.withColumn("speaker", merged).withColumn("turn_role", F.col("turn.role")).drop("turn")


# ---------------------------------------------------------------- rollups


def sequence_preview(entries: Column) -> Column:
    """The first eight turns as ``role(label)``, neighbours that repeat left out."""
    names = F.transform(F.slice(entries, 1, 8), lambda e: F.concat(e["role"], F.when(e["label"].isNotNull(), F.concat(F.lit("("), e["label"], F.lit(")"))).otherwise("")))
    return F.array_join(F.filter(names, lambda x, i: (i == 0) | (x != F.get(names, i - 1))), " -> ")


def speaker_profile(human: Column, ai: Column, system: Column, tool: Column) -> Column:
    other = (system > 0) | (tool > 0)
    return F.when((human > 0) & (ai > 0), "mixed").when((human > 0) & ~other, "human_only").when((ai > 0) & ~other, "ai_only").when((human > 0) | (ai > 0) | other, "mixed").otherwise("unknown")


def session_speakers(settled: DataFrame) -> DataFrame:
    """Turns, blocks and labels by session and role."""
    s = settled.withColumn("role", F.col("speaker.role"))
    return s.groupBy("source_id", "session_no", "role").agg(F.count("*").alias("turn_count"), F.sum("block_count").alias("block_count"), F.sort_array(F.collect_set("speaker.label")).alias("labels"))


def dominant_labels(settled: DataFrame) -> DataFrame:
    """The most frequent label of each role in a session, ties by the label."""
    s = settled.select("source_id", "session_no", F.col("speaker.role").alias("role"), F.col("speaker.label").alias("label")).where("label is not null")
    counts = s.groupBy("source_id", "session_no", "role", "label").count()
    return counts.groupBy("source_id", "session_no", "role").agg(F.min(F.struct((-F.col("count")).alias("k"), "label"))["label"].alias("dominant_label"))


def session_rollup(settled: DataFrame) -> DataFrame:
    """One row per session: turn counts by role, ratio, profile, labels and preview."""
    role = F.col("speaker.role")
    count = lambda r: F.count_if(role == r).alias(f"{r}_turn_count")
    rows = settled.groupBy("source_id", "session_no").agg(F.count("*").alias("turn_count"), *[count(r) for r in ROLE_ORDER], F.array_sort(F.collect_list(F.struct("turn_index", role.alias("role"), F.col("speaker.label").alias("label")))).alias("entries"))
    labels = dominant_labels(settled)
    one = lambda r: labels.where(F.col("role") == r).select("source_id", "session_no", F.col("dominant_label").alias(f"dominant_{r}_label"))
    rows = rows.withColumn("speaker_sequence_preview", sequence_preview(F.col("entries"))).drop("entries")
    rows = rows.withColumn("ai_turn_ratio", round_to(F.col("ai_turn_count") / F.col("turn_count"), 2)).withColumn("speaker_profile", speaker_profile(*[F.col(f"{r}_turn_count") for r in ("human", "ai", "system", "tool")]))
    return rows.join(one("human"), ["source_id", "session_no"], "left").join(one("ai"), ["source_id", "session_no"], "left")
