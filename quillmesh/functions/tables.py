"""Durable intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees, as the session names it in ``spark.checkpoint.dir``.

    A session in one JVM that names none gets a temporary folder; a cluster that names none
    is an error, as a machine's own folder would not be seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillmesh-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Table:
    """A DataFrame written as Parquet into the shared folder, which cuts its lineage."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/quillmesh/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    return Table(df, name).df


class Scratch:
    """Intermediate tables that are deleted together when nothing reads them any more."""

    def __init__(self):
        self.tables: list[Table] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(Table(df, name))
        return self.tables[-1].df

    def drop(self) -> None:
        while self.tables:
            self.tables.pop().drop()
