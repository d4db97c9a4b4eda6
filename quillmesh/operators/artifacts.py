"""Artifact promotion: chunks with an artifact type become versions of labelled artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import artifact_key, leading_words


def artifact_versions(chunks: DataFrame) -> DataFrame:
    """(artifact_key, artifact_type, label, version_index, chunk_id, ...) in order of source and offset.

    The chunks need chunk_id, session_id, text, kind, artifact_type, artifact_label and the
    order columns ord and start_offset. A label without usable characters is its own key.
    """
    label = F.coalesce(F.when(F.col("artifact_label") != "", F.col("artifact_label")), F.when(leading_words(F.col("text"), 10) != "", leading_words(F.col("text"), 10)), F.col("kind"))
    key = F.when(artifact_key(label) != "", artifact_key(label)).otherwise(F.sha2(label, 256))
    rows = chunks.where("artifact_type is not null").withColumn("label", label).withColumn("artifact_key", F.concat_ws(":", "artifact_type", key))
    order = Window.partitionBy("artifact_key").orderBy("ord", "start_offset", "chunk_id")
    first = F.first("label").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("artifact_key", "artifact_type", first.alias("label"), F.row_number().over(order).alias("version_index"), "chunk_id", "session_id", "ord", "start_offset", F.lag("chunk_id").over(order).alias("previous_chunk_id"), F.lag("text").over(order).alias("previous_text"), "text")
