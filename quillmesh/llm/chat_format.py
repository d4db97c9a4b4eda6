"""Chat formatting by schema fingerprints.

A record is a JSON object in any of several layouts (message lists, prompt and completion,
instruction, input and output, ...). Its nested field paths, arrays written as ``[]``, are
hashed for each layout over that layout's own paths; a hash that is registered selects the
declarative mapping that says where the turns are. Mappings list required and optional paths,
and every combination is fingerprinted beforehand. Fields that a mapping does not know are no
part of its hash, so they never change the choice; of several mappings that fit the first one
in ``MAPPINGS`` is taken.

Canonical turns are rendered with marks around each turn. Control strings of common templates
inside a role or a text are broken by an escape character after their first character, which
is undone exactly on reading; the loss mask is a list of spans (code points) over the
formatted text, one for each assistant text.

Defined results: a null record has no turns and the empty text; one of an unknown layout has
neither, and is handed back whole in the ``unknown`` column; null roles and texts are empty;
list elements that are no objects are turns without a role; non-text values are kept as JSON;
turns with equal numbers are ordered by role and text; rows without a conv_id are one
conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

# ---------------------------------------------------------------- layouts

#: Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``fields`` lists (role, names): a turn's text is the named top-level fields that are not
    empty, joined by a blank line. ``turns`` names an array with ``role`` and ``text`` fields,
    whose turns come after those of ``fields``. ``aliases`` says whether roles are translated
    to the canonical names.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    aliases: bool = True


_SYSTEM = ("system", ("system",))
#: In order of precedence: turn lists, then layouts of more required fields.
MAPPINGS = (
    Mapping("messages", ("messages[]",), ("messages[].role", "messages[].content", "system"), turns="messages", role="role", text="content", fields=(_SYSTEM,), aliases=False),
    Mapping("conversations", ("conversations[]",), ("conversations[].from", "conversations[].value", "system"), turns="conversations", role="from", text="value", fields=(_SYSTEM,)),
    Mapping("dialog", ("dialog[]",), ("dialog[].speaker", "dialog[].text", "system"), turns="dialog", role="speaker", text="text", fields=(_SYSTEM,)),
    Mapping("prompt_response", ("prompt", "response"), ("system",), fields=(_SYSTEM, ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", ("instruction",), ("input", "output", "system"), fields=(_SYSTEM, ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question_answer", ("question",), ("answer", "context"), fields=(("user", ("context", "question")), ("assistant", ("answer",)))),
    Mapping("prompt_completion", ("prompt",), ("completion", "system"), fields=(_SYSTEM, ("user", ("prompt",)), ("assistant", ("completion",)))),
)


def paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a value; the elements of an array share one path."""
    if isinstance(value, dict):
        return {at} - {""} | {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {f"{at}[]"} | {p for v in value for p in paths(v, f"{at}[]")}
    return {at} - {""}


def fingerprint(found: set[str], mapping: Mapping) -> str:
    """The hash of the paths that a mapping knows."""
    own = found.intersection((*mapping.required, *mapping.optional))
    return hashlib.sha256("\n".join([mapping.name, *sorted(own)]).encode()).hexdigest()[:16]


def registry() -> dict[str, Mapping]:
    """Fingerprints of every combination of a mapping's optional paths."""
    return {fingerprint({*m.required, *some}, m): m for m in MAPPINGS for n in range(len(m.optional) + 1) for some in combinations(m.optional, n)}


REGISTRY = registry()


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def canonical(record: object) -> tuple[str, list[tuple[str, str]]]:
    """(layout, turns) of a parsed record."""
    if not isinstance(record, dict):
        return "unknown", []
    found = paths(record)
    mapping = next(filter(None, (REGISTRY.get(fingerprint(found, m)) for m in MAPPINGS)), None)
    if mapping is None:
        return "unknown", []
    turns = [(role, "\n\n".join(t for t in (_text(record.get(n)) for n in names) if t)) for role, names in mapping.fields if any(n in record for n in names)]
    for x in record[mapping.turns] if mapping.turns else ():
        turns.append((_text(x.get(mapping.role)), _text(x.get(mapping.text))) if isinstance(x, dict) else ("", _text(x)))
    return mapping.name, [(ROLES.get(r, r) if mapping.aliases else r, t) for r, t in turns]


# ---------------------------------------------------------------- template

OPEN, CLOSE, BREAK = "<|im_start|>", "<|im_end|>", "\n"
#: Control strings of common templates.
CONTROLS = (OPEN, CLOSE, "<|im_sep|>", "<|endoftext|>", "<|startoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
ESCAPE = "␛"
_CONTROL = re.compile("(?=(?:" + "|".join(re.escape(c) for c in CONTROLS) + "))(.)", re.S)
_ESCAPED = re.compile(ESCAPE + "([01n])")


def escape(text: str) -> str:
    """The text without control strings: a mark follows each one's first character."""
    return _CONTROL.sub(lambda m: m[1] + ESCAPE + "1", text.replace(ESCAPE, ESCAPE + "0"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"0": ESCAPE, "1": "", "n": "\n"}[m[1]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the loss mask's spans in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role).replace("\n", ESCAPE + "n") + BREAK, escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE, BREAK]
        at += len(head) + len(body) + len(CLOSE) + len(BREAK)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for part in formatted.split(OPEN)[1:]:
        role, _, rest = part.partition(BREAK)
        out.append((unescape(role), unescape(rest[: rest.rindex(CLOSE)])))
    return out


# ---------------------------------------------------------------- operator


def format_records(records: DataFrame, record: str = "record", key: str = "conv_id") -> DataFrame:
    """conv_id, layout, formatted text and loss mask of JSON records, and the records of no known layout."""
    fields = pa.schema([("conv_id", pa.int64()), ("layout", pa.string()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64())), ("unknown", pa.string())])

    def parsed(text: str | None) -> object:
        try:
            return json.loads(text) if text else None
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "record"):
            rows = []
            for text in batch.column(1).to_pylist():
                layout, turns = canonical(parsed(text))
                formatted, spans = render(turns)
                rows.append((layout, formatted, [s for s, _ in spans], [e for _, e in spans], text if layout == "unknown" else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], fields.field(i + 1).type) for i in range(5))], schema=fields)

    source = records.select(F.col(f"`{key}`").cast("long").alias("conv_id"), F.col(f"`{record}`").alias("record"))
    return source.mapInArrow(run, "conv_id long, layout string, formatted string, loss_starts array<long>, loss_ends array<long>, unknown string")


def records_of_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One ``messages`` record for each conversation of a table with a row for each turn."""
    one = F.struct(F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("content"))
    messages = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return rows.groupBy(F.col(f"`{key}`").alias("conv_id")).agg(F.to_json(F.struct(messages.alias("messages")), {"ignoreNullFields": "false"}).alias("record"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its mask say: turns, their digest, and the loss text's digest."""
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    fields = pa.schema([("conv_id", pa.int64()), *((n, pa.string() if "sha" in n else pa.int64()) for n in names), ("layout", pa.string())])

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, ends in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s:e]) for s, e in zip(starts, ends, strict=True))
                rows.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], fields.field(i + 1).type) for i in range(5)), batch.column(1)], schema=fields)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, layout string")
