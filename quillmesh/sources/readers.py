"""Reading files as sources: one row per file, normalized by its format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversations import json_texts
from .normalize import html_to_text, input_format, is_supported, normalize_lines

#: Part sizes in bytes by format.
PART_BYTES = {"text": 32 << 20, "html": 20 << 20, "json": 12 << 20}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, path, format, raw) of the supported files under a path."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return files.where(is_supported(F.col("path"))).select(F.concat(F.lit("file:"), F.sha2("path", 256).substr(1, 12)).alias("source_id"), "path", input_format(F.col("path")).alias("format"), F.col("value").alias("raw"))


def normalized(files: DataFrame) -> DataFrame:
    """Sources (source_id, format, text) of the files; JSON becomes transcripts, or else its content lines."""
    plain = files.where("format <> 'json'").select("source_id", "format", F.when(F.col("format") == "html", html_to_text(F.col("raw"))).otherwise(normalize_lines(F.col("raw"))).alias("text"))
    chats = json_texts(files.where("format = 'json'"), "source_id", "raw")
    return plain.unionByName(chats.select("source_id", F.lit("json").alias("format"), "text"))


def part_plan(files: DataFrame, size: str = "bytes") -> DataFrame:
    """Byte ranges (source_id, part, start, stop) of files; an empty file has one empty part."""
    part = F.when(F.col("format") == "html", PART_BYTES["html"]).when(F.col("format") == "json", PART_BYTES["json"]).otherwise(PART_BYTES["text"])
    count = F.greatest(F.lit(1), F.ceil(F.col(size) / part)).cast("int")
    rows = files.select("source_id", F.col(size).cast("long").alias("n"), part.alias("part_bytes"), F.explode(F.sequence(F.lit(0), count - 1)).alias("part"))
    return rows.select("source_id", (F.col("part") + 1).alias("part"), (F.col("part") * F.col("part_bytes")).cast("long").alias("start"), F.least("n", (F.col("part") + 1) * F.col("part_bytes")).cast("long").alias("stop"))
