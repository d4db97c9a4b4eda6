"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. Its features are shares of character classes, of
repeated words and of the like, cut at fixed thresholds, for the line itself and for the
lines before and after it; a chain couples neighbouring labels. A document's score is the
mean of the lines' forward-backward marginals of being good, weighted by their lengths.

The model is trained in numpy on at most ``max_docs`` labelled documents of at most
``max_bytes`` together that are not held out (those with the smallest hashes of their ids).
The lines' labels are unknown: what is maximised is the likelihood of the documents' labels
under the length-weighted marginals, which teaches the weights and the coupling (they start
from lines that take their document's label). The line features are computed by the executors
and only these small rows reach the driver. All texts are then scored where they are read.

Defined results: null, empty and blank texts have no lines and get the share of good lines in
training; labels that are null or without a text teach nothing; without any label every score
is 0.5; repeated rows are scored like any other; a null id is never held out and never learnt
from; of texts that share an id the smallest one teaches; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, joined, materialize, pieces, span_hashes, texts_in, word_bounds

RATIOS = ("upper", "digit", "pipe", "bang", "symbol", "stop", "wide", "word_length", "repeat_next", "repeat_line", "distinct", "length", "known_line")
#: Each ratio is cut at these values.
CUTS = {
    "upper": (0.02, 0.06, 0.15, 0.3, 0.6),
    "digit": (0.002, 0.02, 0.1, 0.3),
    "pipe": (0.001, 0.01, 0.04, 0.1),
    "bang": (0.001, 0.01, 0.03, 0.08),
    "symbol": (0.001, 0.01, 0.05, 0.15),
    "stop": (0.002, 0.01, 0.02, 0.04, 0.08),
    "wide": (0.001, 0.05, 0.15, 0.3),
    "word_length": (2.5, 3.5, 4.5, 5.5, 7.0, 9.0),
    "repeat_next": (0.001, 0.02, 0.1, 0.4),
    "repeat_line": (0.5,),
    "distinct": (0.2, 0.4, 0.6, 0.8, 0.95),
    "length": (20.0, 60.0, 150.0, 400.0, 1200.0),
    "known_line": (0.5,),
}


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[list(chars)] = 1
    return t


_CLASSES = {
    "upper": _table(bytes(range(0x41, 0x5B))),
    "digit": _table(b"0123456789"),
    "pipe": _table(b"|"),
    "bang": _table(b"!"),
    "symbol": _table(b"#*$%&<>~^=+@\\{}[]"),
    "stop": _table(b".,;:?"),
    "wide": _table(bytes(range(0x80, 0x100))),
}


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ratios of every non-blank line, the lines' word bytes, the first line of each text)."""
    data, at = joined(texts)
    if not len(data):
        return np.empty((0, len(RATIOS)), np.float32), np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    ws, we = word_bounds(data)
    first, last = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    keep = last > first
    starts, ends, first, last = starts[keep], ends[keep], first[keep], last[keep]
    lines_at = np.searchsorted(starts, at)
    n = len(starts)
    if not n:
        return np.empty((0, len(RATIOS)), np.float32), np.empty(0, np.int64), lines_at
    words = (last - first).astype(np.float32)
    sums = np.concatenate(([0], np.cumsum(we - ws)))
    chars = (sums[last] - sums[first]).astype(np.float32)
    out = np.empty((n, len(RATIOS)), np.float32)
    cuts = np.empty(2 * n, np.int64)
    cuts[::2], cuts[1::2] = starts, ends
    cuts = np.minimum(cuts, len(data) - 1)
    for name, table in _CLASSES.items():
        out[:, RATIOS.index(name)] = np.add.reduceat(table[data], cuts, dtype=np.int32)[::2] / chars
    hashes = span_hashes(data, ws, we)
    line_of = np.repeat(np.arange(n), last - first) if n else np.empty(0, int)
    again = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])))
    out[:, RATIOS.index("repeat_next")] = np.bincount(line_of[again], minlength=n) / words
    order = np.lexsort((hashes, line_of))
    fresh = np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])))
    out[:, RATIOS.index("distinct")] = np.bincount(line_of[order][fresh], minlength=n) / words
    out[:, RATIOS.index("word_length")] = chars / words
    out[:, RATIOS.index("length")] = chars
    text_hash = span_hashes(data, starts, ends)
    doc_of = np.searchsorted(at, starts, side="right") - 1
    order = np.lexsort((np.arange(n), text_hash, doc_of))
    same = np.concatenate(([False], (text_hash[order][1:] == text_hash[order][:-1]) & (doc_of[order][1:] == doc_of[order][:-1])))
    seen = np.zeros(n, np.float32)
    seen[order[same]] = 1
    out[:, RATIOS.index("repeat_line")] = seen
    out[:, RATIOS.index("known_line")] = (words < 3).astype(np.float32)
    return out, chars.astype(np.int64), lines_at


def indicators(ratios: np.ndarray, lines_at: np.ndarray) -> np.ndarray:
    """Threshold indicators of every line, its predecessor and its successor, and ends of the text."""
    own = np.concatenate([ratios[:, [i]] > np.array(CUTS[name], np.float32) for i, name in enumerate(RATIOS)], axis=1).astype(np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    sizes = np.diff(lines_at)
    heads, tails = lines_at[:-1][sizes > 0], lines_at[1:][sizes > 0] - 1
    before[heads], after[tails] = 0, 0
    edge = np.zeros((len(own), 3), np.float32)
    edge[:, 0] = 1
    edge[heads, 1], edge[tails, 2] = 1, 1
    return np.concatenate([own, before, after, edge], axis=1)


class Chain:
    """A chain of binary labels: log-odds per line and one coupling of neighbouring labels."""

    def __init__(self, weights: np.ndarray, coupling: float, prior: float):
        self.weights, self.coupling, self.prior = weights, coupling, prior

    @staticmethod
    def marginals(odds: np.ndarray, coupling: float, lines_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line, and P(both labels equal) of every line and its predecessor.

        Messages are log-odds; all chains advance together, longest first.
        """
        sizes = np.diff(lines_at)
        order = np.argsort(-sizes, kind="stable")
        heads, sizes = lines_at[:-1][order], sizes[order]
        forward, backward = np.zeros_like(odds), np.zeros_like(odds)

        def pass_on(x: np.ndarray) -> np.ndarray:
            return np.logaddexp(x + coupling, -coupling) - np.logaddexp(x - coupling, coupling)

        longest = int(sizes[0]) if len(sizes) else 0
        live = np.searchsorted(-sizes, -np.arange(longest), side="left")
        for t in range(1, longest):
            at = heads[: live[t]] + t
            forward[at] = pass_on(forward[at - 1] + odds[at - 1])
        for t in range(1, longest):
            at = heads[: live[t]] + sizes[: live[t]] - 1 - t
            backward[at] = pass_on(backward[at + 1] + odds[at + 1])
        good = 1 / (1 + np.exp(-np.clip(forward + odds + backward, -500, 500)))
        a, b = (forward + odds)[:-1], (odds + backward)[1:]
        same = np.logaddexp(coupling + a + b, coupling)
        other = np.logaddexp(a - coupling, b - coupling)
        equal = np.concatenate(([0.0], 1 / (1 + np.exp(np.clip(other - same, -500, 500)))))
        equal[lines_at[:-1][np.diff(lines_at) > 0]] = 0
        return good, equal

    def scores(self, ratios: np.ndarray, chars: np.ndarray, lines_at: np.ndarray) -> np.ndarray:
        out = np.full(len(lines_at) - 1, self.prior)
        if len(ratios):
            good, _ = self.marginals(indicators(ratios, lines_at) @ self.weights, self.coupling, lines_at)
            full = np.diff(lines_at) > 0
            sums = lambda x: np.add.reduceat(x, lines_at[:-1][full])
            out[full] = sums(good * chars) / sums(chars.astype(np.float64))
        return np.clip(out, 0.0, 1.0)


def train(ratios: np.ndarray, chars: np.ndarray, lines_at: np.ndarray, labels: np.ndarray, start: int = 60, steps: int = 80, rate: float = 0.05, ridge: float = 2e-3, widest: float = 3.0) -> Chain:
    """Maximum likelihood of the documents' labels by Adam.

    The first ``start`` steps fit single lines to their document's label, without a coupling.
    Then the lines' labels are hidden: a document's score is its length-weighted mean marginal
    c * m. The Hessian of the log partition function turns the pull on c into gradients, and
    its product with c is a difference of two forward-backward passes along c.
    """
    if not len(ratios):
        return Chain(np.zeros(3 + 3 * sum(map(len, CUTS.values()))), 0.0, 0.5)
    x = indicators(ratios, lines_at)
    sizes = np.diff(lines_at)
    full = sizes > 0
    heads, own = lines_at[:-1][full], labels[full].astype(np.float64)
    doc = np.repeat(np.arange(len(own)), sizes[full])
    part = chars / np.add.reduceat(chars.astype(np.float64), heads)[doc]
    even = np.repeat(1 / sizes[full], sizes[full]) / len(own)
    pair = np.ones(len(x))
    pair[heads] = 0
    shrink = ridge / 2 * np.append(np.ones(x.shape[1] - 3), np.zeros(3))
    w, c = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, start + steps + 1):
        odds = x @ w
        if t <= start:
            pull, pull_c = (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - own[doc]) * even, 0.0
        else:
            good, _ = Chain.marginals(odds, c, lines_at)
            score = np.clip(np.add.reduceat(good * part, heads), 1e-6, 1 - 1e-6)
            along = part * ((score - own) / (score * (1 - score) * len(own)))[doc]
            small = 1e-3 / max(np.abs(along).max(), 1e-12)
            (up, equal_up), (down, equal_down) = Chain.marginals(odds + small * along, c, lines_at), Chain.marginals(odds - small * along, c, lines_at)
            pull, pull_c = (up - down) / (2 * small), np.sum((equal_up - equal_down) * pair) / small + ridge * c
        g = np.append(x.T @ pull + shrink * w, pull_c)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, c = w - step[:-1], float(np.clip(c - step[-1], -widest, widest))
    return Chain(w, c, float(own.mean()))


# ---------------------------------------------------------------- operator


def sample(docs: DataFrame, labels: DataFrame, label: str, max_docs: int, max_bytes: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text and label of at most ``max_docs`` labelled documents that are not held out, of at most ``max_bytes`` together."""
    known = labels.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where("label is not null and doc_id is not null")
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_docs)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # chosen: at most max_docs rows
    rows = materialize(rows, "training-sample")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "label")  # at most max_docs rows, without their texts
    fits = rows.select("doc_id", "label", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(order).alias("upto")).where(F.col("upto") <= max_bytes)
    return rows.join(F.broadcast(fits.select("doc_id", "label")), ["doc_id", "label"]).select("doc_id", "text", "label")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = 2000, max_bytes: int = 16 << 20, text: str = "text", key: str = "doc_id") -> Chain:
    fields = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("lines", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            ratios, _, at = line_features(texts_in(batch, "text"))
            rows = [ratios[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(at)), pa.array(rows, pa.binary())], schema=fields)

    rows = sorted(sample(docs, labels, label, max_docs, max_bytes, text, key).mapInArrow(run, "doc_id long, label int, lines long, data binary").collect())
    if not rows:
        return train(np.empty((0, len(RATIOS))), np.empty(0), np.zeros(1, int), np.empty(0))
    ratios = np.frombuffer(b"".join(bytes(r["data"]) for r in rows), np.float32).reshape(-1, len(RATIOS))
    at = np.concatenate(([0], np.cumsum([r["lines"] for r in rows])))
    return train(ratios, ratios[:, RATIOS.index("length")], at, np.array([r["label"] != 0 for r in rows], float))


def score(docs: DataFrame, model: Chain, text: str = "text", key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    fields = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(*line_features(texts_in(batch, "text"))))], schema=fields)

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
