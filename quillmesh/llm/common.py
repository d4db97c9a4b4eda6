"""Shared helpers: Arrow batches and vectorised word hashing; durable tables are the library's own.

Words are maximal runs of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import Scratch, Table, materialize, shared_dir  # noqa: F401

WORD_GAP = r"[\x20\x09-\x0D]+"
WORD_GAP_CHARS = " \t\n\x0b\x0c\r"

_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 9, 10, 11, 12, 13]] = True


# ---------------------------------------------------------------- Spark expressions


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def words_of(column: Column) -> Column:
    """The words of a text as an array; empty for null and for blank texts."""
    trimmed = F.btrim(text_of(column), F.lit(WORD_GAP_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def n_words_of(column: Column) -> Column:
    trimmed = F.btrim(text_of(column), F.lit(WORD_GAP_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_GAP))).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# ---------------------------------------------------------------- joins with hot keys


def hot_join(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], total: int, how: str = "inner", parts: int = 256) -> DataFrame:
    """A join of ``many`` rows with a table that has a row for each key, hot keys dealt into parts.

    A key with more than 1 / ``parts`` of the ``total`` rows is hot. There are fewer than
    ``parts`` of them, and their hashes are all that reaches the driver. A hot key's rows are
    dealt by the columns ``by``, and its row of the other table is sent to each of its parts.
    """
    key = F.xxhash64(*keys)
    counted = many.groupBy(key.alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > max(total / parts, 32))
    hot = {r["_key"]: min(parts, math.ceil(r["_n"] * parts / max(total, 1))) for r in counted.collect()}  # fewer than ``parts`` rows
    if not hot:
        return many.join(one, keys, how)
    dealt = F.when(key.isin(list(hot)), F.element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), key)).otherwise(1)
    left = many.withColumn("_part", F.pmod(F.xxhash64(*by), dealt).cast("int"))
    right = one.withColumn("_part", F.explode(F.sequence(F.lit(0), dealt - 1)))
    return left.join(right, [*keys, "_part"], how).drop("_part")


# ---------------------------------------------------------------- rows told by one bit

BITMAP = 1 << 15  # bits in a row of a table of bits, as bitmap_construct_agg makes them
MOST_BITMAPS = 1 << 11  # rows of such a table that are broadcast at most, 8 MB


def bitmaps(positions: DataFrame) -> DataFrame:
    """(bucket, bits): the bits at the ``position`` of each row, a row for each bucket that has any."""
    at = F.col("position")
    return positions.select(F.shiftright(at, 15).alias("bucket"), at.bitwiseAND(BITMAP - 1).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def with_bit(rows: DataFrame, position: Column, bits: DataFrame) -> DataFrame:
    """The rows with ``_bit``, whether the bit at their position is set. The rows don't move if the table of bits is broadcast."""
    found = rows.withColumn("_at", position).withColumn("bucket", F.shiftright("_at", 15)).join(bits, "bucket", "left")
    byte = F.substring("bits", F.shiftright(F.col("_at").bitwiseAND(BITMAP - 1), 3).cast("int") + 1, F.lit(1))
    power = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.col("_at").bitwiseAND(7).cast("int") + 1)
    bit = F.coalesce(F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(power) > 0, F.lit(False))
    return found.withColumn("_bit", bit).drop("_at", "bucket", "bits")


def sieved(rows: DataFrame, key: str, ids: DataFrame, stored: Scratch) -> DataFrame:
    """The rows whose key is in the column ``id`` of ``ids``, with a few others, and none of them moved.

    Ids set hashed bits in a table of 8 MB at most, 128 bits for an id as far as that goes
    (half a million ids); with more ids more of the others stay. A join by the key must follow.
    """
    size = BITMAP
    wanted = 128 * ids.count()
    while size < min(wanted, BITMAP * MOST_BITMAPS):
        size *= 2
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(size).cast("long"))
    bits = stored(bitmaps(ids.select(place("id").alias("position"))), "bits")
    return with_bit(rows, place(key), F.broadcast(bits)).where("_bit").drop("_bit")


def without(rows: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """The rows whose ``key``, a monotonically increasing id, is not in the column ``key`` of ``ids``.

    A bit for each id in the partition's range: exact, and broadcast up to 8 MB (67 million rows
    in whole buckets); larger tables of bits meet the rows in a shuffle. Keys are not null.
    """
    bits = materialize(bitmaps(ids.select(F.col(key).alias("position"))), name)
    return with_bit(rows, F.col(key), F.broadcast(bits) if bits.count() <= MOST_BITMAPS else bits).where("not _bit").drop("_bit")


# ---------------------------------------------------------------- Arrow batches


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``limit`` bytes together.

    One longer text makes a slice of its own, so what a task holds is bounded by the limit
    or by its longest text.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = text_bytes(batch.column(batch.schema.get_field_index(text)))
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(array: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts_in(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column of a batch as strings, null as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


# ---------------------------------------------------------------- vectorised words and hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, a line feed after each, and the offset at which each begins."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(encoded) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in encoded], out=starts[1:])
    return np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8) if encoded else np.empty(0, np.uint8), starts


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words begin and end."""
    inside = np.concatenate(([False], ~_GAP[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


_FACTOR = 0x9E3779B97F4A7C15 | 1
_UNFACTOR = pow(_FACTOR, -1, 1 << 64)
_BYTE = mix(np.arange(256, dtype=np.uint64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        with np.errstate(over="ignore"):
            for table, factor in ((up, _FACTOR), (down, _UNFACTOR)):
                table[0], filled, step = 1, 1, factor
                while filled < size:
                    table[filled : 2 * filled] = table[:filled] * np.uint64(step)
                    filled, step = 2 * filled, step * step % (1 << 64)
        _POWERS.clear()
        _POWERS[size] = up, down
    return _POWERS[size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 22) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from prefix sums of one polynomial.

    The spans' starts ascend; longer data are hashed block by block, which gives the same
    values with tables of bounded size.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    if len(data) > block:
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + block // 2)))
            base, stop = starts[i], ends[i:j].max()
            out[i:j] = span_hashes(data[base:stop], starts[i:j] - base, ends[i:j] - base, max(block, int(stop - base)))
            i = j
        return out
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * down[starts]
        return mix(raw ^ mix((ends - starts).astype(np.uint64)))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, given the words' hashes in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix(out ^ (words[k : k + n] * np.uint64(2 * k + 0x9E3779B97F4A7C15)))
    return out
