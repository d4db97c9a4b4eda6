"""Input normalization: plain text, HTML and chat records become one text per source.

A source row is (source_id, format, text). All of this is column expressions, so it runs
inside the scan's stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BLOCK_TAGS, CHAT_ROLES, SKIPPED_TAGS
from ..functions.text import normalize_space

#: What may follow a tag's name.
_REST = r"(?:[^a-z0-9:>-][^>]*)?"
#: Decoded entities; any other named one becomes a space.
_ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("ndash", "-"), ("mdash", "-"), ("hellip", "..."))
_AMP = "\x01"


def input_format(path: Column, mime: Column | None = None) -> Column:
    """text, html or json, by extension and then by media type."""
    name, kind = F.lower(path), F.lower(F.coalesce(mime, F.lit(""))) if mime is not None else F.lit("")
    return F.when(name.endswith(".json") | kind.contains("json"), "json").when(name.rlike(r"\.html?\z") | kind.contains("html"), "html").otherwise("text")


def is_supported(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(?:txt|md|log|html|htm|json)\z")


def normalize_lines(text: Column) -> Column:
    """Line feeds only, single spaces, no spaces at line ends, at most one blank line, trimmed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+\z", "")


def decode_entities(text: Column, numeric: bool = True) -> Column:
    """Entities in one pass: an ampersand that comes out of one begins no other."""
    t = F.regexp_replace(text, "&amp;", _AMP)
    for name, value in _ENTITIES:
        t = F.regexp_replace(t, f"&{name};", value)
    if numeric:
        t = F.when(t.contains("&#"), _numeric_entities(t)).otherwise(t)
    t = F.regexp_replace(t, r"&[A-Za-z]+;", " ")
    return F.regexp_replace(t, _AMP, "&")


def _numeric_entities(text: Column) -> Column:
    """Each ``&#n;`` or ``&#xh;`` as its character; the parts between them stay as they are."""
    pattern = r"(&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    rest = F.split(text, pattern)

    def char(e: Column) -> Column:
        code = F.when(F.lower(e).startswith("&#x"), F.conv(F.regexp_extract(e, r"([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(e, r"([0-9]+);", 1)).cast("int")
        # The character's UTF-16 form, big endian, decoded; surrogates and larger numbers give a space.
        low = F.lpad(F.hex(code), 4, "0")
        high = F.concat(F.lpad(F.hex(F.shiftright(code - 0x10000, 10) + 0xD800), 4, "0"), F.lpad(F.hex((code - 0x10000).bitwiseAND(0x3FF) + 0xDC00), 4, "0"))
        bad = (code > 0x10FFFF) | code.between(0xD800, 0xDFFF) | (code == 0)
        return F.when(bad, F.lit(" ")).otherwise(F.decode(F.unhex(F.when(code < 0x10000, low).otherwise(high)), "UTF-16BE"))

    return F.array_join(F.zip_with(rest, found, lambda r, e: F.concat(F.coalesce(r, F.lit("")), F.when(e.isNull(), F.lit("")).otherwise(char(e)))), "")


def html_to_text(html: Column) -> Column:
    """Tags out, blocks on lines of their own, entities decoded, lines normalized."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?(?:-->|\z)", " ")
    for tag in SKIPPED_TAGS:
        t = F.regexp_replace(t, rf"(?is)<\s*{tag}{_REST}>.*?(?:</\s*{tag}{_REST}>|\z)", "")
    t = F.regexp_replace(t, r"(?i)<\s*(?:!doctype|\?xml)[^>]*>", "")
    t = F.regexp_replace(t, rf"(?i)<\s*/?\s*(?:{'|'.join(BLOCK_TAGS)}){_REST}>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"<[^>]*\z", " ")
    return normalize_lines(decode_entities(t))


# ---------------------------------------------------------------- chat records


def chat_role(role: Column) -> Column:
    """user, assistant, system, tool, unknown, or the role itself, normalized."""
    r = F.lower(normalize_space(role))
    out = F.when(r == "", "unknown")
    for name, aliases in CHAT_ROLES.items():
        out = out.when(r.rlike(rf"(?:^| )(?:{'|'.join(aliases)})(?: |$)"), name)
        if name == "assistant":
            out = out.when(r.rlike(r"^gpt(?:[- ]?[0-9]+(?:\.[0-9]+)?)?$"), name)
    return out.otherwise(r)


def speaker_label(role: Column, name: Column | None = None) -> Column:
    """The label that opens a message in a transcript."""
    n = normalize_space(name) if name is not None else F.lit("")
    named = lambda label: F.when((n != "") & (F.lower(n) != label.lower()), F.concat(F.lit(f"{label} ("), n, F.lit(")"))).otherwise(label)
    return F.when(role == "user", named("User")).when(role == "assistant", named("Assistant")).when(role == "system", "System").when(role == "tool", named("Tool")).otherwise(F.when(n != "", n).otherwise("Speaker"))


def message_lines(label: Column, text: Column) -> Column:
    """A message's non-blank lines, the first one after its label; empty for a blank message."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != "")
    return F.when(F.size(lines) == 0, F.lit("")).otherwise(F.concat(label, F.lit(": "), F.array_join(lines, "\n")))


def render_transcripts(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", name: str | None = None, title: str | None = None) -> DataFrame:
    """One text per conversation: a title line, then its messages with a blank line before each.

    A conversation without any text has the empty text. One shuffle, by conversation.
    """
    label = speaker_label(chat_role(F.col(role)), F.col(name) if name else None)
    rows = turns.select(F.col(key).alias("key"), F.col(order).alias("order"), message_lines(label, F.col(text)).alias("body"), (F.col(title) if title else F.lit(None).cast("string")).alias("title"))
    grouped = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("body") != "", F.struct("order", "body")))).alias("messages"), F.min("title").alias("title"))
    bodies = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("\n\n"), m["body"])), "")
    head = F.concat(F.lit("# Conversation: "), F.coalesce(F.when(normalize_space(F.col("title")) != "", normalize_space(F.col("title"))), F.concat(F.lit("Conversation "), F.col("key").cast("string"))))
    return grouped.select(F.format_string("conv:%06d", F.col("key")).alias("source_id"), F.lit("json").alias("format"), F.when(F.size("messages") == 0, "").otherwise(F.concat(head, bodies)).alias("text"))


def text_sources(rows: DataFrame, key: str, text: str, prefix: str) -> DataFrame:
    return rows.select(F.format_string(f"{prefix}:%06d", F.col(key)).alias("source_id"), F.lit("text").alias("format"), normalize_lines(F.col(text)).alias("text"))


def html_sources(rows: DataFrame, key: str = "page_id", html: str = "html", prefix: str = "page") -> DataFrame:
    return rows.select(F.format_string(f"{prefix}:%06d", F.col(key)).alias("source_id"), F.lit("html").alias("format"), html_to_text(F.col(html)).alias("text"))
