"""Text functions as columns; lengths and offsets are in code points.

White space means every Unicode space, as in the data model's original definition; word
boundaries are ASCII and written out, because ``\\b`` is Unicode-aware in the JVM.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import STOP_WORDS

SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: ASCII word boundaries.
BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
TOKEN = r"[a-z0-9][a-z0-9_\-']*"


def word(alternatives: str) -> str:
    """A pattern for whole ASCII words."""
    return f"{BEFORE}(?:{alternatives}){AFTER}"


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def normalize_space(text: Column) -> Column:
    """Runs of white space become one space; null becomes the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))


def concept_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(normalize_space(text)), r"[^a-z0-9\s]", ""))


def artifact_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(normalize_space(text)), r"[^a-z0-9\s:_\-]", ""))


def tokens(text: Column) -> Column:
    """Lower-case tokens of two characters or more, in order."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1)), lambda t: F.length(t) > 1)


def content_tokens(text: Column) -> Column:
    """Tokens that are no stop words, in order and with repeats."""
    return F.filter(tokens(text), lambda t: ~t.isin(STOP_WORDS))


def token_set(text: Column) -> Column:
    return F.array_distinct(content_tokens(text))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Similarity of two sets; ``both_empty`` where neither has a member."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def leading_words(text: Column, count: int = 12) -> Column:
    return F.array_join(F.slice(content_tokens(text), 1, count), " ")


def round_to(value: Column, digits: int) -> Column:
    """Half up on the binary value, alike in every engine."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def make_id(prefix: str, number: Column) -> Column:
    return F.format_string(f"{prefix}_%06d", number)


def safe_title(text: Column, fallback: Column) -> Column:
    """The first non-blank line, at most 90 characters."""
    line = F.get(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), normalize_space), lambda x: x != ""), F.lit(0))
    return F.when(line.isNull(), fallback).when(F.length(line) > 90, F.concat(F.substring(line, 1, 87), F.lit("..."))).otherwise(line)


def preview(text: Column, length: int = 260) -> Column:
    t = normalize_space(text)
    return F.when(F.length(t) <= length, t).otherwise(F.concat(F.substring(t, 1, length - 3), F.lit("...")))


_SENTENCE = re.compile(r"[^.!?\n]++([.!?]+|\Z)?")
_SPACES = re.compile("[ \t\n\x0b\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
_SENTENCE_FIELDS = pa.struct([("text", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])


def sentences_of(text: str) -> list[tuple[str, int, int]]:
    """(text, start, stop) of the sentences in one pass; a run that ends at a line feed is none."""
    out = []
    for m in _SENTENCE.finditer(text):
        if m[1] is not None:
            lead = _SPACES.match(m[0])
            clean = _SPACES.sub(" ", m[0]).strip(" ")
            if clean:
                start = m.start() + (lead.end() if lead else 0)
                out.append((clean, start, start + len(clean)))
    if not out and (whole := _SPACES.sub(" ", text).strip(" ")):
        return [(whole, 0, len(whole))]
    return out


def sentences(text: Column) -> Column:
    """Structs (text, start, stop) of the sentences, offsets within the text.

    A sentence is a run without ``.!?`` and line feeds that ends at such marks or at the
    text's end; a text without any is one sentence. Running offsets have no linear column
    form, so texts go through Arrow, each read once.
    """

    def run(texts: pa.Array) -> pa.Array:
        found = [sentences_of(t or "") for t in texts.to_pylist()]
        flat = [x for one in found for x in one]
        ends = np.concatenate(([0], np.cumsum([len(one) for one in found])))
        columns = [pa.array([x[i] for x in flat], _SENTENCE_FIELDS.field(i).type) for i in range(3)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_SENTENCE_FIELDS)))

    return F.arrow_udf(run, "array<struct<text:string,start:int,stop:int>>")(text)


def deterministic_timestamp(modified_ms: Column) -> Column:
    """ISO text of a file's time in milliseconds, or of the epoch."""
    ms = F.when(modified_ms > 0, modified_ms).otherwise(F.lit(0))
    return F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def estimated_duration_ms(n_bytes: Column, sessions: Column, chunks: Column) -> Column:
    return F.floor(F.lit(350) + n_bytes / 17000 + sessions * 90 + chunks * 24 + 0.5).cast("long")
