"""JSON as ``path: value`` lines: whole documents, broken fragments, retrieval filters.

Parsing text of unknown shape has no column form, so two Arrow functions do it; the filters
over the lines are columns again.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The limits of a flattened text.
MAX_LINES, MAX_DEPTH, MAX_VALUE, MAX_KEY = 250_000, 40, 800, 120

_PLAIN_KEY = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*\Z")
_SCALAR = re.compile(r"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)("?)', re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _clean(value: str, limit: int = MAX_VALUE) -> str:
    value = " ".join(value.split())
    return value if len(value) <= limit else value[:limit] + "..."


def _step(path: str, key: str) -> str:
    key = _clean(key, MAX_KEY) or "(empty_key)"
    if key == "(empty_key)" or _PLAIN_KEY.match(key):
        return f"{path}.{key}" if path else key
    return f"{path}[{json.dumps(key, ensure_ascii=False)}]"


def _scalar(value: object) -> str:
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else _clean(value) if isinstance(value, str) else json.dumps(value)


def flatten(value: object) -> list[str]:
    """Depth-first lines of a parsed value, keys sorted."""
    out: list[str] = []
    stack: list[tuple[str, object, int]] = [("", value, 0)]
    while stack and len(out) < MAX_LINES:
        path, v, depth = stack.pop()
        if isinstance(v, (dict, list)) and v and depth < MAX_DEPTH:
            inner = [(_step(path, k), v[k]) for k in sorted(v)] if isinstance(v, dict) else [(f"{path or '$'}[{i}]", x) for i, x in enumerate(v)]
            stack += [(p, x, depth + 1) for p, x in reversed(inner)]
        else:
            shown = "{}" if isinstance(v, dict) else "[]" if isinstance(v, list) else _scalar(v)
            out.append(f"{path or '$'}: {shown}")
    return out


def _unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        return _ESCAPES.get(m[2], m[2])

    return re.sub(r"\\u([0-9a-fA-F]{4})|\\(.)", one, body, flags=re.S)


def flatten_fragment(text: str) -> list[str]:
    """The same lines from text that is no whole document: a slice of one, or a broken one.

    A stack of open containers follows the brackets that are there; keys outside of any
    container open an implied object.
    """
    out: list[str] = []
    stack: list[list] = []  # [kind, path, next index, pending key]
    top: list = ["{", "", 0, None]
    at, n = 0, len(text)

    def place() -> str:
        frame = stack[-1] if stack else top
        if frame[0] == "[":
            path = f"{frame[1] or '$'}[{frame[2]}]"
            frame[2] += 1
            return path
        key, frame[3] = frame[3], None
        return _step(frame[1], key) if key is not None else ""

    while at < n and len(out) < MAX_LINES:
        c = text[at]
        if c in "{[":
            path = place() if stack or top[3] is not None else ""
            stack.append([c, path, 0, None])
            at += 1
        elif c in "}]":
            if stack:
                stack.pop()
            at += 1
        elif c == '"':
            m = _STRING.match(text, at)
            body, at = _unescape(m[1]), m.end()
            while at < n and text[at].isspace():
                at += 1
            frame = stack[-1] if stack else top
            if frame[0] == "{" and frame[3] is None and at < n and text[at] == ":":
                frame[3] = body
                at += 1
            elif frame[0] == "[" or frame[3] is not None:
                out.append(f"{place()}: {_clean(body)}")
        elif m := _SCALAR.match(text, at):
            at = m.end()
            frame = stack[-1] if stack else top
            if frame[0] == "[" or frame[3] is not None:
                out.append(f"{place()}: {m[0]}")
        else:
            at += 1
    return out


def lines_of(text: str | None) -> list[str]:
    """Lines of a whole document, else of the fragments found, else none."""
    try:
        value = json.loads(text or "")
    except ValueError:
        return flatten_fragment(text or "")
    return flatten(value)


def flatten_json(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, path, value) of every JSON text, in order."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, paths, values = [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, line in enumerate(lines_of(t)):
                    path, _, value = line.partition(": ")
                    ids.append(k), numbers.append(i), paths.append(path), values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(numbers, pa.int64()), pa.array(paths, pa.string()), pa.array(values, pa.string())], names=[key, "line_no", "path", "value"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, line_no long, path string, value string")


#: Paths that carry content, and paths that never do.
KEEP_PATH = (
    r"(?i)(?:^|\.)(?:title|conversation_title|author\.role|author\.name|speaker_role|role|content\.parts\[[0-9]+\]|content\.text|content\.result|content|"
    r"text|summary|body|prompt|response|description|instructions)(?:$|\.)"
)
NOISE_PATH = (
    r"(?i)(?:^|\.)(?:id|parent|children(?:\[[0-9]+\])?|create_time|update_time|status|weight|recipient|model_slug|default_model_slug|safe_urls|citations|"
    r"metadata(?:\.|$)|finish_details|audio_transcription|jit_[^.]+|canvas|invoked_plugin|dalle|is_visually_hidden|message_type|request_id|conversation_id)(?:$|\.)"
)


def is_content_path(path: Column) -> Column:
    return path.rlike(KEEP_PATH) & ~path.rlike(NOISE_PATH)


def message_path(path: Column) -> Column:
    """(conversation, message, field) of a path inside a mapping or a message list, else nulls."""
    mapping = r"^(.*?)\.?mapping(?:\.([^.\[\]]+)|\[\"([^\"]+)\"\])\.message\.(.+)$"
    listed = r"^(.*?)\.?messages\[([0-9]+)\]\.(.+)$"
    part = lambda p, i: F.regexp_extract(path, p, i)
    in_map, in_list = path.rlike(mapping), path.rlike(listed)
    raw = F.when(in_map, part(mapping, 4)).when(in_list, part(listed, 3))
    field = (
        F.when(raw.isin("author.role", "role", "speaker_role"), "role")
        .when(raw.isin("author.name", "name"), "name")
        .when(raw == "create_time", "create_time")
        .when(raw.isin("content", "content.text", "content.result", "text") | raw.rlike(r"^content\.parts\[[0-9]+\]$"), "content")
    )
    whole = F.when(in_map, part(mapping, 1)).when(in_list, part(listed, 1))
    message = F.when(in_map, F.concat(part(mapping, 2), part(mapping, 3))).when(in_list, F.concat(F.lit("messages["), part(listed, 2), F.lit("]")))
    return F.when(field.isNotNull(), F.struct(F.when(whole == "", "$").otherwise(whole).alias("conversation"), message.alias("message"), field.alias("field")))


def title_path(path: Column) -> Column:
    """The conversation whose title is at a path, else null; ``$`` stands for the whole text."""
    of = lambda end: F.regexp_extract(path, rf"^(.*?){end}$", 1)
    inner = path.rlike(r"\.message\.|\.messages\[|\.author\.")
    titled = r"\.(?:title|conversation_title)"
    named = path.rlike(r"\.name$") & of(r"\.name").rlike(r"(?:^|\.)conversations\[[0-9]+\]$|^\$\[[0-9]+\]$|^[A-Za-z0-9_\-]+$")
    out = F.when(inner, F.lit(None).cast("string")).when(path.isin("title", "conversation_title"), "$").when(path.rlike(titled + "$"), of(titled)).when(named, of(r"\.name"))
    return F.when(out == "", "$").otherwise(out)


def compact_path(path: Column) -> Column:
    """What a content line keeps of its path; empty for a line that is left out."""
    p = F.regexp_replace(path, r"^\$\.?", "")
    spared = p.rlike(r"(?i)author\.role|author\.name|content\.parts|content\.text|content\.result|title|conversation_title$")
    field = message_path(p)["field"]
    role = F.when(field == "content", "message.content").when(field == "create_time", "message.create_time").otherwise(F.concat(F.lit("message.author."), field))
    last = F.array_join(F.slice(F.reverse(F.slice(F.reverse(F.filter(F.split(p, r"\."), lambda x: x != "")), 1, 3)), 1, 3), ".")
    return F.when((p == "") | ~p.rlike(KEEP_PATH) | (p.rlike(NOISE_PATH) & ~spared), "").when(field.isNotNull(), role).when(title_path(p).isNotNull(), "title").otherwise(last)


def chat_messages(lines: DataFrame, key: str) -> DataFrame:
    """Messages (conversation, message, role, name, create_time, text, pos) from flattened chat exports.

    A missing or non-numeric time sorts last; ties keep the order of first appearance.
    """
    found = lines.select(key, "line_no", "value", message_path(F.col("path")).alias("m")).where("m is not null")
    one = lambda name: F.min(F.when(F.col("m.field") == name, F.struct("line_no", "value")))["value"]
    content = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("m.field") == "content", F.struct("line_no", "value")))), lambda x: x["value"])), "\n")
    rows = found.groupBy(key, F.col("m.conversation").alias("conversation"), F.col("m.message").alias("message")).agg(F.min("line_no").alias("first_line"), one("role").alias("role"), one("name").alias("name"), F.expr("try_cast(min(case when m.field = 'create_time' then value end) as double)").alias("create_time"), content.alias("text"))
    from pyspark.sql import Window

    order = Window.partitionBy(key, "conversation").orderBy(F.col("create_time").asc_nulls_last(), "first_line")
    return rows.withColumn("pos", F.row_number().over(order))


def current_chain(nodes: DataFrame, current: DataFrame, rounds: int = 1000) -> DataFrame:
    """The messages of each mapping from its root to its current node.

    ``nodes`` has (conversation, node, parent), ``current`` (conversation, node). Parents are
    followed level by level; a node met twice ends its chain.
    """
    spark = nodes.sparkSession
    names = [f"quillmesh_{kind}_{uuid.uuid4().hex}" for kind in ("nodes", "current")]
    nodes.createOrReplaceTempView(names[0])
    current.createOrReplaceTempView(names[1])
    return spark.sql(
        f"""WITH RECURSIVE chain(conversation, node, parent, depth, seen) MAX RECURSION LEVEL {rounds} AS (
              SELECT n.conversation, n.node, n.parent, 0, array(n.node)
              FROM {names[0]} n JOIN {names[1]} c ON n.conversation = c.conversation AND n.node = c.node
              UNION ALL
              SELECT n.conversation, n.node, n.parent, c.depth + 1, array_append(c.seen, n.node)
              FROM chain c JOIN {names[0]} n ON n.conversation = c.conversation AND n.node = c.parent
              WHERE NOT array_contains(c.seen, n.node))
            SELECT conversation, node, max(depth) OVER (PARTITION BY conversation) - depth AS pos FROM chain"""
    )
