"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
documents. Stages work on everything their predecessor kept.

Defined results: null and empty texts fail the quality rules and go; rows without an id and rows
that share one are documents of their own if their texts differ, and copies of a text are one
group whatever their ids; of a group the smallest id stays, rows without an id last, ties by a
hash of all columns; repeated rows are copies; very long texts are whole in every stage; an
empty table gives empty stages; columns beside those of documents are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import dart_minhash, mixing, packing, pii_bootstrap, rule_ledger
from quillmesh.llm.common import materialize, without
from quillmesh.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rule ledger's policy for deleting: lines must repeat three times or more to count against a text."""
    return rule_ledger.ledger(docs).where(rule_ledger.passes(rule_ledger.DELETING_POLICY)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicate texts: the one with the smallest id.

    Rows are told apart by a number of their own, so rows without an id and different texts
    under one id stay. Rows without an id come after those with one; rows that share an id are
    ordered by a hash of all columns. Null and blank texts are groups of their own.
    """
    tie = F.xxhash64(*COLUMNS)
    # Written once, as the numbers must be the same in every read.
    rows = materialize(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()).withColumn("_tie", tie), "rows")
    classes = dart_minhash.near_duplicates(rows, key="_row").where("class_size > 1").select(F.col("doc_id").alias("_row"), "class_id")
    members = materialize(classes.join(rows.select("_row", "_tie", "doc_id"), "_row"), "class-members")
    best = members.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_tie", "_row"))["_row"].alias("_row"))
    dropped = members.join(best.select("_row"), "_row", "left_anti").select("_row")
    return without(rows, "_row", dropped, "dropped").select(*COLUMNS)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked, n_chars as of the new text."""
    masked = pii_bootstrap.redacted(docs.select(*COLUMNS), pii_bootstrap.learn(docs))
    return masked.selectExpr("doc_id", "text", "lang", "source", "cast(coalesce(length(text), n_chars) as bigint) as n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mask_pii", mask_pii),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Signatures, Newton steps and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
