"""Dense numbers in a total order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize

#: A row's place in its task has so many bits of ``monotonically_increasing_id``.
_PLACE_BITS = 33


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... by the given columns; rows that tie in all of them come in any order.

    Rows are dealt by ranges of the order, sorted, and written once with their range and their
    place in it, so every later read sees the same ranges however often a plan is run and
    whatever adaptive execution makes of its exchanges. Only one count for each range is
    summed up in one place. Rows with equal values in all order columns share a range.
    """
    place = "_quillmesh_place"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    ranged = materialize(ranged, "numbered")
    part = F.shiftright(place, _PLACE_BITS)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.col(place).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    joined = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")  # one row for each range
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col("_before") + inside + 1).alias(name))
