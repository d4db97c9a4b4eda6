"""Chat exports: JSON of several shapes becomes messages, and messages become transcripts.

A parsed document has no column form, so one Arrow function walks it and emits a row for each
message (of a message list, or of a mapping of linked nodes). Documents without messages, and
text that is no whole document, leave their ``path: value`` lines instead. Roles, labels,
white space, order and rendering are column expressions and windows over those rows.

Defined results: null or blank text gives the empty text; times that are neither numbers nor
dates sort last; ties keep the order of appearance; a node met twice ends a chain of parents;
repeated rows are sources of their own only if their ids differ.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_space
from .json_flatten import _scalar, compact_path, flatten, flatten_fragment, message_path, title_path
from .normalize import chat_role, message_lines, normalize_lines, speaker_label

#: Where a message's text may be, in order; the first and the last but one are lists.
CONTENT_FIELDS = ("parts", "text", "result", "content", "output_text", "summary", "message", "items", "code")
LISTS_ONLY = frozenset(("parts", "items"))
#: Names of a conversation's title, in order, and the depth to which content is read.
TITLES = ("title", "conversation_title", "name", "topic")
MAX_CONTENT_DEPTH = 6
#: Fixed value: the share of nodes with a time from which a mapping is ordered by time.
TIMED_SHARE = 0.4


def to_time(value: object) -> float | None:
    """A number, a number's text, or a date's text in milliseconds; else none."""
    if isinstance(value, bool) or value is None or value == "":
        return None
    try:
        number = float(value)  # type: ignore[arg-type]
        return number if abs(number) < float("inf") else None
    except (TypeError, ValueError):
        pass
    try:
        moment = datetime.fromisoformat(str(value).strip())
    except ValueError:
        return None
    return (moment if moment.tzinfo else moment.replace(tzinfo=UTC)).timestamp() * 1000


def distinct_fragments(fragments: list[str]) -> list[str]:
    """Fragments that differ in more than white space, blank ones left out."""
    kept: dict[str, str] = {}
    for f in fragments:
        if key := " ".join(f.split()):
            kept.setdefault(key, f)
    return list(kept.values())


def content_text(value: object, depth: int = 0) -> str:
    """The text in a message's content, whatever its nesting."""
    if value is None or depth > MAX_CONTENT_DEPTH:
        return ""
    if isinstance(value, list):
        inner = value
    elif isinstance(value, dict):
        inner = [value[f] for f in CONTENT_FIELDS if f in value and (f not in LISTS_ONLY or isinstance(value[f], list))]
    else:
        return value if isinstance(value, str) else _scalar(value)
    return "\n".join(distinct_fragments([content_text(x, depth + 1) for x in inner]))


def _inside(value: object, *names: str) -> object:
    for n in names:
        value = value.get(n) if isinstance(value, dict) else None
    return value


def _first(*values: object) -> str:
    return next((v if isinstance(v, str) else _scalar(v) for v in values if v), "")


def message_of(entry: object, node: object = None) -> tuple[str, str, float | None, str] | None:
    """(role, name, time, text) of a list's entry or of a node's message; none without a text."""
    payload = entry["message"] if isinstance(_inside(entry, "message"), dict) else entry
    if not isinstance(payload, dict):
        return None
    body = next((payload[f] if f != "parts" else {"parts": payload[f]} for f in ("content", "text", "parts") if f in payload), payload)
    text = content_text(body)
    if not text.strip():
        return None
    role = _first(_inside(payload, "author", "role"), payload.get("role"), payload.get("speaker_role"), _inside(node, "author", "role"), _inside(node, "role"))
    name = _first(_inside(payload, "author", "name"), payload.get("name"), _inside(node, "author", "name"))
    own = payload.get("create_time")
    return role, name, to_time(_inside(node, "create_time") if own is None else own), text


def node_order(mapping: dict, current: object) -> list[str]:
    """The nodes of a mapping: the current node's chain of parents, else by time, else depth first."""
    chain: dict[str, None] = {}
    at = current if isinstance(current, str) else None
    while at and isinstance(mapping.get(at), dict) and at not in chain:
        chain[at] = None
        at = mapping[at].get("parent")
    spoken = [k for k in reversed(chain) if mapping[k].get("message")]
    if len(spoken) >= 2:
        return spoken
    times = {}
    for k, node in mapping.items():
        own = _inside(node, "message", "create_time")
        times[k] = to_time(_inside(node, "create_time") if own is None else own)
    if sum(t is not None for t in times.values()) >= max(2, int(len(mapping) * TIMED_SHARE)):
        return sorted(mapping, key=lambda k: (times[k] is None, times[k] or 0.0))
    roots = sorted(k for k, node in mapping.items() if _inside(node, "parent") not in mapping)
    order: dict[str, None] = {}
    stack = [*reversed([*roots, *sorted(mapping)])]
    while stack:
        k = stack.pop()
        if isinstance(k, str) and k in mapping and k not in order:
            order[k] = None
            children = _inside(mapping[k], "children")
            stack += reversed(children) if isinstance(children, list) else []
    return list(order)


def _is_conversation(value: object) -> bool:
    return isinstance(_inside(value, "mapping"), (dict, list)) or isinstance(_inside(value, "messages"), list)


def _is_message(value: object) -> bool:
    if not isinstance(value, dict):
        return False
    if _inside(value, "author", "role") or value.get("role") or value.get("speaker_role"):
        return True
    inner = value.get("message")
    return _is_message(inner) if isinstance(inner, dict) else "content" in value or "text" in value


def conversations_of(value: object) -> list[dict]:
    """The conversations that a parsed document holds."""
    if isinstance(value, list):
        whole = [x for x in value if _is_conversation(x)]
        return whole or ([{"title": "Conversation 1", "messages": value}] if any(map(_is_message, value)) else [])
    if isinstance(_inside(value, "conversations"), list):
        return [x for x in value["conversations"] if _is_conversation(x)]
    return [value] if _is_conversation(value) else []


def messages_of(conversation: dict) -> list[tuple[str, str, float | None, str]]:
    """A conversation's messages in order."""
    if isinstance(conversation.get("messages"), list):
        found = filter(None, map(message_of, conversation["messages"]))
        return sorted(found, key=lambda m: (m[2] is None, m[2] or 0.0))
    mapping = conversation["mapping"]
    if isinstance(mapping, list):
        mapping = {str(i): x for i, x in enumerate(mapping)}
    nodes = [mapping[k] for k in node_order(mapping, conversation.get("current_node"))]
    return [m for n in nodes if _inside(n, "message") and (m := message_of(n["message"], n))]


# ---------------------------------------------------------------- tables

_FIELDS = (("conversation", pa.int64()), ("title", pa.string()), ("pos", pa.int64()), ("role", pa.string()), ("name", pa.string()), ("text", pa.string()), ("path", pa.string()), ("value", pa.string()))


def parsed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, conversation, title, pos, role, name, text, path, value): messages, or else lines, of every JSON text.

    A message has a text, a line has a path; lines have no conversation.
    """
    kind = rows.schema[key].dataType.simpleString()

    def of(t: str) -> Iterator[tuple]:
        try:
            value = json.loads(t)
        except ValueError:
            lines = flatten_fragment(t)
        else:
            any_message = False
            for c, conversation in enumerate(conversations_of(value), 1):
                title = " ".join(_first(*(conversation.get(n) for n in TITLES)).split())
                for pos, (role, name, _, body) in enumerate(messages_of(conversation)):
                    any_message = True
                    yield c, title or f"Conversation {c}", pos, role, name, body, None, None
            if any_message:
                return
            lines = flatten(value)
        for pos, line in enumerate(lines):
            path, _, shown = line.partition(": ")
            yield None, None, pos, None, None, None, path, shown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(of(t)) if t and t.strip() else []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), batch.schema.field(0).type), *(pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(_FIELDS))], names=[key, *(n for n, _ in _FIELDS)])

    ddl = ", ".join(f"{n} {'long' if kind == pa.int64() else 'string'}" for n, kind in _FIELDS)
    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, {ddl}")


def _rendered(messages: DataFrame, key: str, gap: str) -> DataFrame:
    """(key, text): the transcripts of each key's conversations, from (key, conversation, title, pos, role, name, text)."""
    role = chat_role(F.col("role"))
    body = message_lines(speaker_label(role, F.col("name")), F.col("text"))
    said = messages.select(key, "conversation", "title", "pos", body.alias("body")).where("body <> ''")
    one = said.groupBy(key, "conversation").agg(F.min("title").alias("title"), F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("m"))
    text = F.concat(F.lit("# Conversation: "), F.col("title"), F.array_join(F.transform("m", lambda m: F.concat(F.lit("\n\n"), m["body"])), ""))
    grouped = one.select(key, "conversation", text.alias("t")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("conversation", "t"))).alias("c"))
    return grouped.select(key, F.array_join(F.transform("c", lambda c: c["t"]), gap).alias("text"))


def path_messages(lines: DataFrame, key: str) -> DataFrame:
    """Messages told by flattened paths alone: of conversations with two of them or more and a known role."""
    at = F.col("line_no")
    titles = lines.select(key, at, "value", title_path(F.col("path")).alias("conversation")).where("conversation is not null")
    titles = titles.groupBy(key, "conversation").agg(F.min(F.when(~F.col("value").isin("", '""'), F.struct(at, "value")))["value"].alias("title"), F.min(at).alias("seen"))
    found = lines.select(key, at, "value", message_path(F.col("path")).alias("m")).where("m is not null")
    last = lambda name: F.max(F.when(F.col("m.field") == name, F.struct(at, "value")))["value"]
    parts = F.array_sort(F.collect_list(F.when((F.col("m.field") == "content") & ~F.col("value").isin("", '""', "null"), F.struct(at, "value"))))
    text = F.array_join(F.array_distinct(F.transform(parts, lambda p: normalize_space(p["value"]))), "\n")
    rows = found.groupBy(key, F.col("m.conversation").alias("conversation"), F.col("m.message").alias("message")).agg(F.min(at).alias("first"), last("role").alias("role"), last("name").alias("name"), last("create_time").alias("time"), text.alias("text"))
    whole = Window.partitionBy(key, "conversation")
    spoken = rows.withColumn("seen", F.min("first").over(whole)).where("text <> ''")
    known = chat_role(F.col("role")).isin("user", "assistant")
    spoken = spoken.withColumn("n", F.count("*").over(whole)).withColumn("known", F.max(known).over(whole)).where("n >= 2 and known")
    order = whole.orderBy(F.col("time").try_cast("double").asc_nulls_last(), "first")
    ranked = spoken.join(titles.withColumnRenamed("seen", "titled"), [key, "conversation"], "left").withColumn("pos", F.row_number().over(order))
    number = F.dense_rank().over(Window.partitionBy(key).orderBy(F.least("seen", "titled"), "conversation"))
    ranked = ranked.withColumn("number", number)
    return ranked.select(key, F.col("number").alias("conversation"), F.coalesce(F.when(normalize_space(F.col("title")) != "", normalize_space(F.col("title"))), F.concat(F.lit("Conversation "), F.col("number").cast("string"))).alias("title"), "pos", "role", "name", "text")


def json_texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) of every JSON text: its transcripts, else its content lines, else the text itself if it is no JSON."""
    every = parsed(rows, key, text)
    spoken = _rendered(every.where("text is not null"), key, "\n\n")
    lines = every.where("path is not null").withColumnRenamed("pos", "line_no")
    by_path = _rendered(path_messages(lines, key), key, "\n\n")
    compact = lines.select(key, "line_no", compact_path(F.col("path")).alias("p"), "value").where("p <> ''")
    kept = compact.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", F.concat_ws(": ", "p", "value").alias("line")))).alias("l"))
    kept = kept.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    tables = [t.withColumnRenamed("text", f"_t{i}") for i, t in enumerate((spoken, by_path, kept))]
    out = rows.select(key, F.col(text).alias("_raw"))
    for t in tables:
        out = out.join(t, key, "left")
    raw = F.when(F.try_parse_json("_raw").isNull(), F.col("_raw"))
    return out.select(key, normalize_lines(F.coalesce("_t0", "_t1", "_t2", raw, F.lit(""))).alias("text"))
