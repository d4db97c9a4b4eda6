"""Sessionization: a source's blocks are split by a score and by the running length.

The score's static part is windows over neighbouring blocks. The running length starts anew
at each split, so the split itself is a fold over the source's blocks in order. It keeps one
number and passes rows on as they come, so a source of any length takes no room.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import SESSION_TARGET
from ..functions.folds import folded
from ..functions.text import jaccard, safe_title


def boundary_score(order) -> Column:
    """The score before a block, in hundredths, without its length terms."""
    prev = lambda c: F.lag(c).over(order)
    pts = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    role, label = F.col("speaker.role"), F.col("speaker.label")
    speaker = ((prev("speaker.role") != "unknown") & (role != "unknown") & (prev("speaker.role") != role)) | (prev("speaker.label") != label)
    similarity = jaccard(prev("token_set"), F.col("token_set"))
    theme = F.when(similarity < 0.06, 35).when(similarity < 0.14, 20).when(similarity < 0.2, 10).otherwise(0)
    return pts(F.col("leading_blank_lines") >= 2, 20) + pts(prev("has_timestamp") | F.col("has_timestamp"), 16) + pts(speaker, 34) + pts(prev("type") != F.col("type"), 14) + theme


class Cuts:
    """The fold over one source's blocks at a time: whether a new session begins at a block."""

    def __init__(self, target: int):
        self.target, self.run, self.session = target, 0, 0

    def start(self) -> None:
        self.run, self.session = 0, 0

    def step(self, length: int, score: int) -> int:
        """The block's session number, from 1."""
        score += 24 * (self.run > self.target * 1.05) + 36 * (self.run > self.target * 1.3)
        if self.session == 0 or self.run >= self.target * 1.6 or (score >= 62 and self.run >= self.target * 0.42):
            self.session, self.run = self.session + 1, 0
        self.run += length
        return self.session


def with_sessions(blocks: DataFrame, size: str = "medium") -> DataFrame:
    """Blocks with score and session_no, from 1 in each source."""
    order = Window.partitionBy("source_id").orderBy("block_no")
    rows = blocks.withColumn("score", boundary_score(order)).withColumn("n", F.length("text")).drop("token_set")
    return folded(rows, ("source_id",), ("block_no",), ("n", "score"), "session_no", lambda: Cuts(SESSION_TARGET[size])).drop("n")


def session_texts(blocks: DataFrame) -> DataFrame:
    """One row per session: title, offsets, length."""
    first = blocks.groupBy("source_id", "session_no").agg(F.min_by("text", "block_no").alias("first"), F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"), F.count("*").alias("block_count"))
    title = safe_title(F.col("first"), F.concat(F.lit("Session "), F.col("session_no").cast("string")))
    return first.select("source_id", "session_no", title.alias("title"), "start_offset", "end_offset", "block_count")
