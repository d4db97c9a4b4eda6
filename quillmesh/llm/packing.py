"""Cost-balanced packing of token sequences.

A document's cost is estimated as ``linear * n + quadratic * n * n`` (attention stays inside
a document). Every task tokenizes its own rows and packs them in groups of about
``group_tokens`` tokens, so no row is shuffled and a task holds one group: documents of
``budget`` tokens or more first fill whole sequences; what remains of them is assigned, in
descending order, to the sequence of lowest cost that has room for it. A remainder for which
no sequence has room is cut at the sequence of lowest cost with any room. The group's
sequences hold ``budget`` tokens each, and the last few hold powers of two that sum up to the
group's rest, so no sequence needs padding.

Token ids come from a tokenizers file; a document ends with ``end_id``. White space always
separates tokens in that vocabulary, so words are encoded once and cached (bounded), and the
ids of a text are the ids of its words.

Defined results: a null or empty text is the single id ``end_id``; repeated rows and ties are
packed as documents of their own, earlier rows first; an empty table gives no pieces; other
columns are not read. A sequence id is the task's partition number and a counter, so it
depends on how the input is split into tasks but not on when or where a task runs.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts_in

BUDGET = 4096
#: White space to Python's split but not to the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    A word is looked up in a bounded cache. What the cache lacks is lower-cased; a run of
    Latin letters is merged by a byte-pair engine that holds the file's merges over these
    letters, anything else goes through the tokenizer itself.
    """

    def __init__(self, path: str, cache: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        self.known = _Known(self.word)
        self.tails: dict[str, bytes] = {"": b""}
        self.merge = _letter_merger(path)

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        m = _LETTERS.fullmatch(word.lower()) if self.merge else None
        if not m:
            return self.ids(word)
        tail = self.tails.get(m[2])
        if tail is None:
            if len(self.tails) > 10_000:
                self.tails = {"": b""}
            tail = self.tails[m[2]] = self.ids(m[2])
        raw = m[1].encode()
        ids = self.merge(raw[:-1] + _LAST[raw[-1]])
        return pack_ids(f"<{len(ids)}I", *ids) + tail

    def encode(self, texts: list[str]) -> list[bytes]:
        out, known = [], self.known
        for t in texts:
            out.append(self.ids(t) if _ODD.search(t) else b"".join(map(known.__getitem__, t.split())))
            if len(known) > self.cache:
                known.clear()
        return out


class _Known(dict):
    """A word's ids, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.make(word)
        return ids


#: Lower-case letters of at most two bytes, and what may follow them inside a word (no apostrophe).
_LETTERS = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: The byte that stands for a letter's last byte at the end of a word: upper case and control codes are free.
_LAST = {b: bytes([b - 32]) for b in range(0x61, 0x7B)} | {b: bytes([b - 0x9F]) for b in range(0x9F, 0xC0)}


def _letter_merger(path: str):
    """Ids of a run of letters by the file's merges; None where the file is of another kind."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    if model.get("end_of_word_suffix") != "</w>" or model.get("ignore_merges") or model.get("dropout"):
        return None
    import tiktoken

    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    inner = {*range(0x61, 0x7B), *range(0x9F, 0xC0), 0xC3}
    ranks = {}
    for token, i in model["vocab"].items():
        last = token.endswith("</w>") and len(token) > 4
        raw = [chars.get(c, 0) for c in (token[:-4] if last else token)]
        if inner.issuperset(raw) and not (last and raw[-1] == 0xC3):
            ranks[bytes(raw[:-1]) + (_LAST[raw[-1]] if last else bytes(raw[-1:]))] = i
    spare = 1 << 20
    for b in range(256):  # never met; the engine asks for all bytes
        ranks.setdefault(bytes([b]), spare + b)
    engine = tiktoken.Encoding("letters", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return engine._core_bpe.encode_single_piece


def assign(lengths: list[int], budget: int = BUDGET, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these lengths."""
    out, sequence = [], 0
    rest = []
    for d, n in enumerate(lengths):
        for k in range(n // budget):
            out.append((d, k * budget, budget, sequence, 0))
            sequence += 1
        if n % budget:
            rest.append((n % budget, d, n - n % budget))
    total = sum(n for n, _, _ in rest)
    room = [budget] * (total // budget) + [1 << b for b in range(budget.bit_length() - 1, -1, -1) if (total % budget) >> b & 1]
    if not room:
        return out
    free, size = np.array(room, dtype=np.int64), np.array(room, dtype=np.int64)
    cost = np.zeros(len(room))
    rest.sort(key=lambda x: (-x[0], x[1]))
    for n, d, start in rest:
        while n:
            fits = free >= n
            if not fits.any():
                fits = free > 0
            s = int(np.where(fits, cost, np.inf).argmin())
            take = min(n, int(free[s]))
            out.append((d, start, take, sequence + s, int(size[s] - free[s])))
            free[s] -= take
            cost[s] += linear * take + quadratic * take * take
            start, n = start + take, n - take
    return out


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", budget: int = BUDGET, end_id: int = 2, group_tokens: int = 4 << 20, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of a document; with ``keep_ids`` also its token ids as bytes."""
    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    fields = [pa.field(n, pa.binary() if n == "ids" else pa.int64()) for n in re.findall(r"(\w+) (?:long|binary)", schema)]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        first = TaskContext.get().partitionId() << 36

        def packed(held: list[tuple[int | None, bytes]]) -> tuple[pa.RecordBatch, int]:
            found = assign([len(b) // 4 for _, b in held], budget)
            found.sort(key=lambda p: (p[3], p[4]))
            ids = [held[d][1][4 * start : 4 * (start + n)] for d, start, n, _, _ in found]
            columns = [[held[p[0]][0] for p in found], [p[1] for p in found], [p[2] for p in found], [zlib.crc32(b) for b in ids], [len(held[p[0]][1]) // 4 for p in found], [first + p[3] for p in found], [p[4] for p in found]]
            columns += [ids] * keep_ids
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields)), found[-1][3] + 1

        held, tokens = [], 0
        for batch in pieces(batches, "text"):
            for k, b in zip(batch.column(0).to_pylist(), encoder.encode(texts_in(batch, "text")), strict=True):
                held.append((k, b + end))
                tokens += len(b) // 4 + 1
                if tokens >= group_tokens:
                    out, used = packed(held)
                    yield out
                    first, held, tokens = first + used, [], 0
        if held:
            yield packed(held)[0]

    return source.mapInArrow(run, schema)
