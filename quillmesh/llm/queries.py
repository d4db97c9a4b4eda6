"""The operators' queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, dart_minhash, html_diff, mixing, packing, pii_bootstrap, projection_dedup, quality_crf, rule_ledger, toxicity_subword


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ok).alias("text"))
    records = chat_format.records_of_turns(rows.union(extra))
    return chat_format.read_back(chat_format.format_records(records))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_crf.score(docs, quality_crf.learn(docs, _table(spark, sf_dir, "labels")))


def op3_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii_bootstrap.find(docs, pii_bootstrap.learn(docs))


def op4_toxicity_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity_subword.score(docs, toxicity_subword.learn(docs, _table(spark, sf_dir, "labels")))


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rule_ledger.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ~rule_ledger.passes(rule_ledger.BASE_POLICY)
    return entries.select("doc_id", *[F.col("measures")[m].alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base.alias("base_failed"), rule_ledger.passes(rule_ledger.CURRENT_POLICY).alias("kept"))


def op7_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op9_html_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract(_table(spark, sf_dir, "pages"))


def op10_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_quality_crf, op3_pii_bootstrap, op4_toxicity_subword, op5_dart_minhash, op6_rule_ledger, op7_cost_packing, op8_entropy_mixing, op9_html_diff, op10_projection_dedup)}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL = {
    "op6_rule_ledger": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, list_slice(w, i, i + 2) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c >= 2),
c AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM r CROSS JOIN (SELECT unnest(range(0, 3)) AS k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_bangs
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > word_chars OR n_dup_lines * 10 > n_lines * 3
            OR word_chars > n_words * 15 OR n_bangs * 2 > n_words) AS kept
FROM v""",
}
