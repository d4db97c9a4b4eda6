"""Structural parse: a source's lines become typed blocks.

Everything is windows over one source, so the whole parse needs one shuffle by source, which
the stages after it reuse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import AFTER, BEFORE, SPACE, token_set, trim_space
from .speaker import block_speaker

TIMESTAMP = rf"(?i){BEFORE}(?:[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?\s?(?:AM|PM)?|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}){AFTER}"


def is_table_line(t: Column) -> Column:
    return (F.regexp_count(t, F.lit(r"\|")) >= 2) | (F.regexp_count(t, F.lit(r"\t")) >= 2) | t.rlike(r"^[^,]{1,80}(?:,[^,]{1,80}){2,}\z")


def is_json_line(t: Column) -> Column:
    return t.rlike(r"^[\[{]") | t.rlike(r'^"[^"\n]{1,120}"\s*:') | t.rlike(r"^(?:true|false|null|-?[0-9]+(?:\.[0-9]+)?)\s*[,}\]]?\z")


def is_heading(t: Column) -> Column:
    return (F.length(t) <= 120) & (t.rlike(r"^#{1,6}\s+") | t.rlike(rf"(?i)^(?:chapter|section|part|appendix){AFTER}") | t.rlike(r"^[A-Z0-9][A-Z0-9\s:._\-/]{4,90}\z"))


def line_type(t: Column) -> Column:
    """The type of a trimmed, non-blank line outside of code."""
    return F.when(is_table_line(t), "table").when(is_json_line(t), "json").when(is_heading(t), "section").when(t.startswith(">"), "quote").otherwise("paragraph")


def typed_lines(sources: DataFrame) -> DataFrame:
    """(source_id, line_no, line, start, type, in_fence) of every line; blank lines have no type."""
    rows = sources.where(F.coalesce(F.length("text"), F.lit(0)) > 0).select("source_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    order = Window.partitionBy("source_id").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("trimmed", trim_space(F.col("line"))).withColumn("fence", F.col("trimmed").startswith("```"))
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))).withColumn("inside", F.coalesce(F.sum(F.col("fence").cast("int")).over(before), F.lit(0)) % 2 == 1)
    kind = F.when(F.col("fence") | F.col("inside"), "code").when(F.col("trimmed") != "", line_type(F.col("trimmed")))
    return rows.withColumn("type", kind)


def blocks(sources: DataFrame) -> DataFrame:
    """Typed blocks with offsets, speaker, timestamp flag and token set, numbered per source."""
    order = Window.partitionBy("source_id").orderBy("line_no")
    rows = typed_lines(sources)
    prev = lambda c: F.lag(c).over(order)
    opens = F.col("fence") & ~F.col("inside")
    after_close = F.coalesce(prev("fence") & prev("inside"), F.lit(False))
    begins = F.col("type").isNotNull() & (prev("type").isNull() | (prev("type") != F.col("type")) | opens | after_close)
    rows = rows.withColumn("begins", begins).withColumn("last_text", F.last(F.when(F.col("type").isNotNull(), F.col("line_no")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("block_no", F.sum(F.col("begins").cast("int")).over(order)).where("type is not null")
    rows = rows.withColumn("blank", F.col("line_no") - F.coalesce(F.col("last_text"), F.lit(-1)) - 1)
    first = lambda c: F.min_by(c, "line_no")
    grouped = rows.groupBy("source_id", "block_no").agg(first("type").alias("type"), first("blank").alias("leading_blank_lines"), first("start").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("raw"))
    text = trim_space(F.col("raw"))
    lead = F.length("raw") - F.length(F.regexp_replace("raw", f"^{SPACE}+", ""))
    out = grouped.select("source_id", "block_no", "type", "leading_blank_lines", (F.col("at") + lead).alias("start_offset"), text.alias("text"))
    return out.select("*", (F.col("start_offset") + F.length("text")).alias("end_offset"), F.col("text").rlike(TIMESTAMP).alias("has_timestamp"), block_speaker(F.col("text"), F.col("type")).alias("speaker"), token_set(F.col("text")).alias("token_set"))
