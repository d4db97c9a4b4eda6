"""Textpack: chunk texts as records of dictionary phrases, templates, literals and deltas.

Counting the lexicon and the templates, de-duplicating chunks and finding delta bases are
DataFrame steps. Splitting a text by the lexicon is one regular expression (longest phrase
first); common prefixes and suffixes of a record and the 32 before it are an Arrow function
over ordered records, and so is undoing the deltas; ``validate`` proves that every text comes back.
"""

from __future__ import annotations

import os.path
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbering import numbered
from ..functions.tables import materialize
from ..functions.text import tokens

#: Fixed values of the codec.
MAX_PHRASES, MAX_TEMPLATES, WINDOW, SAMPLE = 256, 64, 32, 8000
#: Deltas stay inside runs of so many records, which a task codes and decodes in one pass.
EPOCH = 4096
MIN_PHRASE, MIN_COUNT, AFFIX, MIN_TEMPLATE_TEXT = 12, 3, 24, 72


def evenly_spaced(rows: DataFrame, k: int, *order: str) -> DataFrame:
    """Rows number floor(i * n / k), i below k; all rows if there are at most k."""
    n = rows.agg(F.count("*").alias("_n"))
    placed = numbered(rows, "_at", *order).crossJoin(F.broadcast(n))  # one row
    i = F.ceil((F.col("_at") - 1) * F.lit(k) / F.col("_n"))
    return placed.where((F.col("_n") <= k) | (F.floor(i * F.col("_n") / F.lit(k)) == F.col("_at") - 1)).drop("_at", "_n")


def phrase_counts(chunks: DataFrame) -> DataFrame:
    """Chunk counts of token runs of 3 to 6 tokens and 12 characters or more."""
    t = tokens(F.col("text"))
    runs = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    rows = chunks.select(t.alias("w")).select(F.explode(F.array_distinct(F.filter(F.concat(*[runs(F.col("w"), n) for n in (3, 4, 5, 6)]), lambda p: F.length(p) >= MIN_PHRASE))).alias("phrase"))
    return rows.groupBy("phrase").agg(F.count("*").alias("recurrence_count")).where(F.col("recurrence_count") >= MIN_COUNT)


def lexicon(chunks: DataFrame) -> DataFrame:
    """The 256 best phrases: by count, then longer first, then by text."""
    top = phrase_counts(chunks).orderBy(F.desc("recurrence_count"), F.desc(F.length("phrase")), "phrase").limit(MAX_PHRASES)
    order = Window.orderBy(F.desc("recurrence_count"), F.desc(F.length("phrase")), "phrase")  # at most 256 rows
    return top.select(F.format_string("phrase_%06d", F.row_number().over(order)).alias("phrase_id"), "phrase", "recurrence_count")


def templates(chunks: DataFrame) -> DataFrame:
    """The 64 most frequent pairs of first and last 24 characters, met three times or more."""
    rows = chunks.where(F.length("text") >= MIN_TEMPLATE_TEXT).select(F.substring("text", 1, AFFIX).alias("prefix"), F.expr(f"right(text, {AFFIX})").alias("suffix"))
    top = rows.groupBy("prefix", "suffix").agg(F.count("*").alias("recurrence_count")).where(F.col("recurrence_count") >= MIN_COUNT).orderBy(F.desc("recurrence_count"), "prefix", "suffix").limit(MAX_TEMPLATES)
    order = Window.orderBy(F.desc("recurrence_count"), "prefix", "suffix")  # at most 64 rows
    return top.select(F.row_number().over(order).alias("template_id"), "prefix", "suffix", "recurrence_count")


SIGNATURE = ("speaker_role", "speaker_label", "speaker_inference_source", "speaker_confidence", "turn_index", "turn_role", "turn_count", "speaker_sequence_preview")


def signature(columns: list[str]) -> Column:
    """What must be equal, besides the text, for two chunks to share a record."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if c in columns else F.lit("") for c in SIGNATURE])


def records(chunks: DataFrame, *order: str) -> DataFrame:
    """(record_key, text, first chunk, chunk_ids): one record per distinct text and signature."""
    rows = chunks.withColumn("signature", signature(chunks.columns)).withColumn("_o", F.struct(*[c for c in order if c != "chunk_id"], "chunk_id"))
    return rows.groupBy("text", "signature").agg(F.min("_o").alias("first"), F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))


def common_prefix(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def common_suffix(a: str, b: str, prefix: int) -> int:
    most = min(len(a), len(b)) - prefix
    return min(most, len(os.path.commonprefix((a[::-1], b[::-1]))))


def best_base(text: str, recent: deque, direct_cost: int) -> tuple[int, int, int, str] | None:
    """(record, start, delete_count, insert) of the cheapest base, the oldest on ties."""
    best = None
    for number, base in recent:
        p = common_prefix(base, text)
        s = common_suffix(base, text, p)
        if (p + s) / max(len(base), len(text), 1) < 0.55:
            continue
        cost = len(text) - p - s + 18
        if cost < direct_cost * 0.8 and (best is None or cost < best[0]):
            best = (cost, number, p, len(base) - p - s, text[p : len(text) - s])
    return best and best[1:]


def segments(text: Column, phrases: list[str]) -> Column:
    """The text cut into phrases and what lies between them, as structs (phrase, literal).

    One alternation, longest phrase first, finds the leftmost longest phrase at each place.
    """
    if not phrases:
        return F.when(text == "", F.array().cast("array<struct<phrase:string,literal:string>>")).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("phrase"), text.alias("literal"))))
    pattern = "|".join("\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E" for p in sorted(phrases, key=lambda p: (-len(p), p)))
    found, rest = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern)
    pairs = F.zip_with(rest, found, lambda r, p: F.array(F.struct(F.lit(None).cast("string").alias("phrase"), F.coalesce(r, F.lit("")).alias("literal")), F.struct(p.alias("phrase"), F.lit("").alias("literal"))))
    return F.filter(F.flatten(pairs), lambda s: s["phrase"].isNotNull() | (s["literal"] != ""))


def encode(chunks: DataFrame, *order: str, delta: bool = True, sample: int | None = SAMPLE) -> dict[str, DataFrame]:
    """The bundle of a chunk table: lexicon, templates, literals, records and refs.

    The lexicon is counted over ``sample`` evenly spaced chunks, or over all for None. It and
    the templates (at most 256 and 64 rows) are collected; records are
    numbered in the chunks' order, and a delta may point at any of the 32 records before it in
    its epoch. The records are written once, as literals and references are read from them.
    """
    counted = chunks if sample is None else evenly_spaced(chunks, sample, *order, "chunk_id")
    words, shapes = materialize(lexicon(counted), "textpack-lexicon"), materialize(templates(chunks), "textpack-templates")
    phrases = [r["phrase"] for r in words.collect()]
    base = numbered(records(chunks, *order), "record", "first", "text", "signature")
    shaped = base.join(F.broadcast(shapes.select("template_id", "prefix", "suffix")), (F.length("text") > 2 * AFFIX) & (F.substring("text", 1, AFFIX) == F.col("prefix")) & (F.expr(f"right(text, {AFFIX})") == F.col("suffix")), "left")  # at most 64 rows
    body = F.when(F.col("template_id").isNotNull(), F.expr(f"substring(text, {AFFIX} + 1, length(text) - 2 * {AFFIX})")).otherwise(F.col("text"))
    direct = shaped.select("record", "text", "chunk_ids", "template_id", segments(body, phrases).alias("segments"))
    cost = F.aggregate("segments", F.lit(8), lambda a, s: a + F.when(s["phrase"].isNotNull(), 6).otherwise(F.length(s["literal"]))) + F.when(F.col("template_id").isNotNull(), 4).otherwise(0)
    direct = direct.withColumn("cost", cost)
    if delta:
        direct = _with_deltas(direct)
    else:
        direct = direct.withColumn("base_record", F.lit(None).cast("long")).withColumn("start", F.lit(None).cast("long")).withColumn("delete_count", F.lit(None).cast("long")).withColumn("insert", F.lit(None).cast("string"))
    is_delta = F.col("base_record").isNotNull()
    coded = direct.select(
        "record", "chunk_ids", F.when(~is_delta, F.col("template_id")).alias("template_id"), F.when(~is_delta, F.col("segments")).alias("segments"), "base_record", "start", "delete_count", "insert", F.sha2("text", 256).alias("text_hash")
    )
    coded = materialize(coded, "textpack-records")
    texts = coded.select(F.explode(F.concat(F.coalesce(F.transform("segments", lambda s: s["literal"]), F.array().cast("array<string>")), F.array(F.coalesce("insert", F.lit(""))))).alias("literal")).where("literal <> ''").distinct()
    stored = numbered(texts, "literal_no", "literal")
    refs = coded.select("record", F.explode("chunk_ids").alias("chunk_id"))
    return {"lexicon": words, "templates": shapes, "literals": stored, "records": coded, "refs": refs}


def _by_epoch(rows: DataFrame) -> DataFrame:
    """Records in order, those of an epoch in one task."""
    return rows.withColumn("_epoch", F.floor((F.col("record") - 1) / EPOCH)).repartition("_epoch").sortWithinPartitions("_epoch", "record").drop("_epoch")


def _with_deltas(rows: DataFrame) -> DataFrame:
    extra = [("base_record", pa.int64()), ("start", pa.int64()), ("delete_count", pa.int64()), ("insert", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: deque = deque(maxlen=WINDOW)
        epoch = None
        for batch in batches:
            names = batch.schema.names
            found = []
            for number, text, cost in zip(*(batch.column(names.index(n)).to_pylist() for n in ("record", "text", "cost")), strict=True):
                if (number - 1) // EPOCH != epoch:
                    recent.clear()
                    epoch = (number - 1) // EPOCH
                found.append(best_base(text, recent, cost) or (None,) * 4)
                recent.append((number, text))
            for i, (name, kind) in enumerate(extra):
                batch = batch.append_column(name, pa.array([f[i] for f in found], kind))
            yield batch

    schema = rows.schema
    for name, kind in extra:
        schema = schema.add(name, T.StringType() if kind == pa.string() else T.LongType())
    return _by_epoch(rows).mapInArrow(run, schema)


def decode(bundle: dict[str, DataFrame]) -> DataFrame:
    """(record, text) of every record: templates and segments, then deltas in one pass over each epoch."""
    shapes = F.broadcast(bundle["templates"].select("template_id", "prefix", "suffix"))  # at most 64 rows
    body = F.array_join(F.transform("segments", lambda s: F.coalesce(s["phrase"], s["literal"])), "")
    rows = bundle["records"].join(shapes, "template_id", "left")
    direct = F.when(F.col("base_record").isNull(), F.concat(F.coalesce("prefix", F.lit("")), body, F.coalesce("suffix", F.lit(""))))
    rows = rows.select("record", direct.alias("text"), "base_record", "start", "delete_count", "insert")
    schema = pa.schema([("record", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[int, str] = {}
        for batch in batches:
            numbers, texts = [], []
            for number, text, base, start, gone, insert in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if base is not None:
                    old = recent[base]
                    text = old[:start] + (insert or "") + old[start + gone :]
                recent[number] = text
                if len(recent) > WINDOW:
                    del recent[next(iter(recent))]
                numbers.append(number)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], schema=schema)

    return _by_epoch(rows).mapInArrow(run, "record long, text string")


def validate(bundle: dict[str, DataFrame], chunks: DataFrame) -> DataFrame:
    """Chunks whose decoded text or hash differs; a sound bundle has none."""
    texts = decode(bundle).join(bundle["records"].select("record", "text_hash"), "record")
    back = bundle["refs"].join(texts, "record").select("chunk_id", F.col("text").alias("decoded"), "text_hash")
    both = chunks.select("chunk_id", "text").join(back, "chunk_id", "left")
    return both.where(~F.col("text").eqNullSafe(F.col("decoded")) | ~F.col("text_hash").eqNullSafe(F.sha2("text", 256)))
