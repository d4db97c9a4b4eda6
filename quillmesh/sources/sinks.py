"""Sinks: Parquet tables, JSON-line shards of fixed size, and a deterministic archive."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import numbered


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")


def sharded(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``shard``, counted from 1, of ``size`` rows in the given order; the rows never meet in one task."""
    return numbered(df, "_number", order).withColumn("shard", (F.floor((F.col("_number") - 1) / size) + 1).cast("int")).drop("_number")


def write_jsonl(df: DataFrame, folder: str, rows_per_file: int = 2000) -> None:
    df.write.option("maxRecordsPerFile", rows_per_file).option("ignoreNullFields", "false").json(folder)


def write_archive(folder: str, target: str) -> None:
    """A ZIP of a local folder's files with fixed times, so equal content gives equal bytes."""
    root = Path(folder)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for p in sorted(x for x in root.rglob("*") if x.is_file()):
            info = zipfile.ZipInfo(str(p.relative_to(root)), date_time=(1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, p.read_bytes())
