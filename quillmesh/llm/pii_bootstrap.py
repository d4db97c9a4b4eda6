"""Personal data by base patterns and bootstrapped contextual extraction.

Base kinds (email, ip, card, phone) and key-like secrets are found by fixed patterns; what
they find are the seed entities. The words around every seed and around every word with a
digit (two before it, or one on each side) are its lexical patterns. Spark builds the graph of
patterns and instances with their counts and scores both sides in turn until the accepted
patterns stay the same: a pattern by the share of its occurrences that reliable instances of
one kind account for, an instance by its patterns (noisy or). What is accepted so far is then
looked up in all texts with every other word that fills it, whatever its form, and scored
again. Patterns that end with high confidence mark words that no base pattern knows, names and
handles too. The base spans always stay.

The texts are read three times (twice if no pattern is accepted); what is shuffled are counts
of (pattern, instance). A pattern is accepted by its confidence and its distinct instances
alone, however large the rest of the corpus is. Up to ``MAX_SENT`` accepted patterns are sent
to the executors, and then no text is shuffled. More of them stay a table: it is joined by
shuffle with the contexts of every text's words, and the texts with what was found for them,
both by keys of their own. All steps on one text are linear in its length.

Defined results: a null or empty text has no spans; repeated rows are scanned like any other
and count as often as they occur; ties keep every kind's span, by start and then by kind; a
word that two accepted patterns mark takes the kind of the one with two words before it; an
empty table has no patterns and no spans; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Collection, Iterable, Iterator
from functools import cached_property
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, pieces, texts_in

BASE_KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
KINDS = (*BASE_KINDS, SECRET)
#: Kinds by accepted pattern: a dictionary, or a table (pattern, kind).
Patterns = dict[str, str] | DataFrame

# The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{32,}(?![A-Za-z0-9+/_-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGITS = re.compile(r"[0-9]+")
#: So many accepted patterns at most are sent to the executors; more are joined by shuffle.
MAX_SENT = 20_000
_EDGE = "\"'`.,;:!?()[]{}<>#*$%&|="


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, from one at sign to the next."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _byte(digits: str) -> bool:
    """Whether a number of any length, leading zeros included, is at most 255."""
    low = digits.lstrip("0")
    return len(low) < 3 or (len(low) == 3 and low <= "255")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the four base kinds, by start and then by kind."""
    found = [(s, 0, e) for s, e in emails(text)]
    if _DIGITS.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return [(s, BASE_KINDS[k], e) for s, k, e in sorted(found)]


def secrets(text: str) -> list[tuple[int, str, int]]:
    """Long unbroken tokens that mix letters and digits; only texts with a long word are searched."""
    if max(map(len, text.split()), default=0) < 32:
        return []
    return [(m.start(), SECRET, m.end()) for m in _SECRET.finditer(text)]


def _seeds(text: str, base: list[tuple[int, str, int]] | None = None) -> list[tuple[int, str, int]]:
    found = base_spans(text) if base is None else base
    if len(text) >= 32:
        found = sorted([*found, *secrets(text)], key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
    return found


_WORD = re.compile(r"\S+")


class Words:
    """A text's words by white space, and the lexical patterns of their places."""

    def __init__(self, text: str):
        self.text = text
        self.lows = text.lower().split()
        if self.lows and max(map(len, self.lows)) > 64:  # very long words are told apart by a digest
            self.lows = [w if len(w) <= 64 else "#" + hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for w in self.lows]

    @cached_property
    def spans(self) -> list[tuple[int, int]]:
        return [m.span() for m in _WORD.finditer(self.text)]

    @cached_property
    def starts(self) -> list[int]:
        return [s for s, _ in self.spans]

    def patterns(self, i: int, j: int) -> list[str]:
        """The contexts of the words i to j: two words before them, and one on each side."""
        out, lows = [], self.lows
        if i >= 2:
            out.append(f"{lows[i - 2]} {lows[i - 1]} _")
        if i >= 1 and j + 1 < len(lows):
            out.append(f"{lows[i - 1]} _ {lows[j + 1]}")
        return out

    def around(self, start: int, end: int) -> list[str]:
        return self.patterns(bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1)

    def trimmed(self, i: int) -> tuple[int, int]:
        """The word's span without punctuation at its ends; empty for punctuation alone."""
        s, e = self.spans[i]
        while s < e and self.text[s] in _EDGE:
            s += 1
        while e > s and self.text[e - 1] in _EDGE:
            e -= 1
        return s, e


def _free(places: Iterable[tuple[int, int, int]], spans: list[tuple[int, str, int]]) -> Iterator[tuple[int, int, int]]:
    """The ascending, disjoint places (start, end, word) that no span overlaps; both lists are walked once."""
    at, reach, n = 0, -1, len(spans)
    for s, e, i in places:
        while at < n and spans[at][0] < e:
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= s:
            yield s, e, i


def _digit_words(words: Words) -> Iterator[tuple[int, int, int]]:
    last = -1
    for m in _DIGITS.finditer(words.text):
        i = bisect_right(words.starts, m.start()) - 1
        if i != last:
            last = i
            yield *words.trimmed(i), i


def occurrences(text: str) -> Iterator[tuple[int, int, str | None, list[str]]]:
    """Seed entities with their kind, then other words with a digit without one, each with its patterns."""
    spans = _seeds(text)
    if not spans and not _DIGITS.search(text):
        return
    words = Words(text)
    for s, kind, e in spans:
        yield s, e, kind, words.around(s, e)
    for s, e, i in _free(_digit_words(words), spans):
        yield s, e, None, words.patterns(i, i)


def _instance(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


_EDGE_SCHEMA = pa.schema([("pattern", pa.string()), ("instance", pa.string()), ("kind", pa.string()), ("n", pa.int64())])
_EDGE_DDL = "pattern string, instance string, kind string, n long"


def _counted(docs: DataFrame, text: str, found: Callable[[str], Iterator[tuple[str, str, str | None]]]) -> DataFrame:
    """Sums of (pattern, instance, kind) over all texts, pre-summed inside each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            counts: dict[tuple, int] = defaultdict(int)
            for t in texts_in(batch, "text"):
                for key in found(t):
                    counts[key] += 1
            if counts:
                yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in counts], pa.string()) for i in range(3)), pa.array(list(counts.values()), pa.int64())], schema=_EDGE_SCHEMA)

    edges = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, _EDGE_DDL)
    return edges.groupBy("pattern", "instance", "kind").agg(F.sum("n").alias("n"))


def graph(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of (pattern, instance, kind) of seeds and of words with digits; kind is null for what is not a seed."""

    def found(t: str) -> Iterator[tuple[str, str, str | None]]:
        for s, e, kind, patterns in occurrences(t):
            one = _instance(t[s:e])
            for p in patterns:
                yield p, one, kind

    return _counted(docs, text, found)


def heads(patterns: Iterable[str]) -> frozenset[str]:
    """The words that stand right before the blank."""
    return frozenset(p.split(" ")[1 if p.endswith(" _") else 0] for p in patterns)


def _matches(words: Words, patterns: Collection[str], last_words: frozenset[str]) -> Iterator[tuple[int, list[str]]]:
    """Words with the patterns of a set that hold for them."""
    for before in [k for k, w in enumerate(words.lows[:-1]) if w in last_words]:
        if hit := [p for p in words.patterns(before + 1, before + 1) if p in patterns]:
            yield before + 1, hit


def fillers(docs: DataFrame, patterns: Patterns, text: str = "text") -> DataFrame:
    """Counts of (pattern, instance) of all the other words, those without a digit, in these patterns.

    They make a pattern's confidence the share of everything that fills it, and they are
    instances themselves: names, handles and words of any kind that a confident pattern marks.
    """
    few = patterns if isinstance(patterns, dict) else None
    last_words = heads(few) if few is not None else frozenset()

    def found(t: str) -> Iterator[tuple[str, str, str | None]]:
        words = Words(t)
        hits = _matches(words, few, last_words) if few is not None else ((i, words.patterns(i, i)) for i in range(len(words.lows)))
        for i, patterns in hits:
            s, e = words.trimmed(i)
            if s < e and "@" not in t[s:e] and not _DIGITS.search(t, s, e):
                one = _instance(t[s:e])
                for p in patterns:
                    yield p, one, None

    edges = _counted(docs, text, found)
    return edges if few is not None else edges.join(patterns.select("pattern").hint("merge"), "pattern", "left_semi")


def accepted_patterns(edges: DataFrame, rounds: int = 20, confidence: float = 0.8, min_instances: int = 3, max_sent: int = MAX_SENT) -> Patterns:
    """Patterns of high confidence with their kind: a dictionary, or a table if there are more than ``max_sent``.

    A pattern's confidence for a kind is the part of its occurrences that instances of that
    kind explain, weighted by their scores, over all its occurrences and one more; an
    instance's score is the noisy or of its patterns. Both sides are scored in turn until the
    accepted patterns stay the same.
    """
    seeds = edges.where("kind is not null")
    if not seeds.limit(1).count():
        return {}
    made = [Table(edges.groupBy("pattern", "instance").agg(F.sum("n").alias("n")), "pii-edges")]
    by_instance = made[0].df
    whole = by_instance.groupBy("pattern").agg(F.sum("n").alias("all"))
    certain = seeds.select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    score, last = certain, None
    for _ in range(rounds):
        hits = by_instance.join(score, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("hits"), F.count("*").alias("instances"))
        confident = (
            hits.where((F.col("hits") >= min_instances) & (F.col("instances") >= min_instances))
            .join(whole, "pattern")
            .withColumn("conf", F.col("hits") / (F.col("all") + 1.0))
            .where(F.col("conf") >= confidence)
        )
        kept = Table(confident.select("pattern", "kind", "conf"), "pii-patterns")
        made.append(kept)
        n = kept.df.count()
        if not n or (last and n == last[0] and not kept.df.join(last[1], ["pattern", "kind"], "left_anti").limit(1).count()):
            break
        last = n, kept.df
        derived = by_instance.join(kept.df, "pattern").groupBy("instance", "kind").agg((1.0 - F.exp(F.sum(F.log1p(-F.least("conf", F.lit(0.999)))))).alias("score"))
        scored = Table(certain.union(derived).groupBy("instance", "kind").agg(F.max("score").alias("score")), "pii-scores")
        made.append(scored)
        score = scored.df
    best = kept.df.groupBy("pattern").agg(F.max(F.struct("conf", "kind"))["kind"].alias("kind"))
    few = best.limit(max_sent + 1).collect()  # bounded by max_sent
    out: Patterns = {r["pattern"]: r["kind"] for r in few} if len(few) <= max_sent else Table(best, "pii-accepted").df
    for table in made:
        table.drop()
    return out


def _known(docs: DataFrame, patterns: Patterns, text: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], Iterable[tuple[dict[str, str], frozenset[str]]]]]:
    """The rows, and what gives each row of a batch its patterns and their last words.

    A table of patterns adds a last column: those of the row's own candidates. Equal texts
    share a digest and so need no row number; null texts have neither.
    """
    if isinstance(patterns, dict):
        last_words = heads(patterns)
        return docs, lambda batch: repeat((patterns, last_words), batch.num_rows)
    schema = pa.schema([("digest", pa.string()), ("pattern", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found: set[tuple[str, str]] = set()
            for digest, t in zip(batch.column(0).to_pylist(), texts_in(batch, "text"), strict=True):
                words = Words(t)
                found.update((digest, p) for i in range(len(words.lows)) for p in words.patterns(i, i))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(2)], schema=schema)

    digest = F.sha2(F.col(f"`{text}`"), 256)
    asked = docs.where(f"`{text}` is not null").select(digest.alias("digest"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "digest string, pattern string").distinct()
    own = asked.join(patterns.hint("merge"), "pattern").groupBy(F.col("digest").alias("_pii_digest")).agg(F.collect_list(F.struct("pattern", "kind")).alias("_pii_patterns"))
    rows = docs.withColumn("_pii_digest", digest).join(own.hint("merge"), "_pii_digest", "left").select(*[F.col(f"`{c}`") for c in docs.columns], "_pii_patterns")
    own_patterns = lambda own: {x["pattern"]: x["kind"] for x in own or ()}
    return rows, lambda batch: ((p, heads(p)) for p in map(own_patterns, batch.column(batch.num_columns - 1).to_pylist()))


def all_spans(text: str, patterns: dict[str, str], last_words: frozenset[str], base: list[tuple[int, str, int]] | None = None) -> list[tuple[int, str, int]]:
    """Base spans, secrets and what the accepted patterns add, by start and then by kind."""
    spans = _seeds(text, base)
    if patterns:
        words = Words(text)
        kinds, places = {}, []
        for i, hit in _matches(words, patterns, last_words):
            s, e = words.trimmed(i)
            if s < e:
                places.append((s, e, i))
                kinds[i] = patterns[hit[0]]
        if added := [(s, kinds[i], e) for s, e, i in _free(places, spans)]:
            spans = sorted([*spans, *added], key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
    return spans


def learn(docs: DataFrame, text: str = "text", **settings) -> Patterns:
    """Accepted patterns of a table's texts.

    Patterns that are confident among seeds and words with digits are looked up once more in
    all texts, with every other word that fills them, and scored again.
    """
    edges = Table(graph(docs, text), "pii-graph")
    first = accepted_patterns(edges.df, **settings)
    if isinstance(first, dict) and not first:
        edges.drop()
        return first
    others = Table(fillers(docs, first, text), "pii-fillers")
    names = [r for r in (list(first) if isinstance(first, dict) else ())]
    whole = edges.df.union(others.df)
    likely = whole.where(F.col("pattern").isin(names)) if names else whole.join(first.select("pattern").hint("merge"), "pattern", "left_semi")
    out = accepted_patterns(likely, **settings)
    edges.drop()
    others.drop()
    return out


def span_list(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, kind, e in spans)


def find(docs: DataFrame, patterns: Patterns, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans of every row."""
    source, known = _known(docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), patterns, "text")
    names = [*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_secret"]
    fields = pa.schema([("doc_id", pa.int64()), *((n, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = []
            for t, own in zip(texts_in(batch, "text"), known(batch), strict=True):
                base = base_spans(t)
                every = all_spans(t, *own, base)
                rows.append((*(sum(k == kind for _, k, _ in base) for kind in BASE_KINDS), hashlib.sha256(span_list(base).encode()).hexdigest(), span_list(every), sum(k == SECRET for _, k, _ in every)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], fields.field(i + 1).type) for i in range(len(names)))], schema=fields)

    ddl = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in fields)
    return source.mapInArrow(run, ddl)


def mask(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with a mark in place of every span; overlapping spans share the first one's mark."""
    out, at = [], 0
    for s, kind, e in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, patterns: Patterns, text: str = "text") -> DataFrame:
    """The rows with every span of the text masked; all columns stay, null texts too."""
    at, width = docs.columns.index(text), len(docs.columns)
    source, known = _known(docs, patterns, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            new = [t if t is None else mask(t, all_spans(t, *own)) for t, own in zip(batch.column(at).to_pylist(), known(batch), strict=True)]
            yield batch.select(range(width)).set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return source.mapInArrow(run, docs.schema)
