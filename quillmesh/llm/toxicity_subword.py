"""Toxicity by averaged subword embeddings under a linear softmax.

A word is the bag of its character n-grams (and itself), hashed into a table of embeddings; a
passage of ``window`` words is the average of its words, and a softmax over two classes is
linear in it. Table and softmax are trained jointly in numpy. A document is as toxic as its
worst passages: passages overlap by half, and the document's log-odds are a soft maximum over
them, so a few abusive words count the same in a short and in a long text. As a misspelt word
shares most of its n-grams with the word it comes from, it shares most of its score too.

After training a word's contribution is one number (its embedding times the softmax's
weights), so scoring is a lookup per word and a sliding mean. The model is trained on at most
``max_docs`` labelled documents of at most ``max_bytes`` together that are not held out (those
with the smallest hashes of their ids); the table has a fixed size. Averages over whole texts
were tried and find fewer toxic documents (the README has the figures).

Defined results: null, empty and blank texts get the score of an average of no words (the
bias); labels that are null or without a text teach nothing; without both classes every score
is the share of toxic labels; repeated rows are scored like any other; a null id is never held
out and never learnt from; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, joined, mix, pieces, shingle_hashes, span_hashes, texts_in, word_bounds
from .quality_crf import sample

#: Words of a passage.
WINDOW = 12
GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
_EDGES = b"\"'`.,;:!?()[]{}<>#*$%&|=-_"
_TRIM = np.zeros(256, bool)
_TRIM[list(_EDGES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends without punctuation, first word of each text)."""
    data, at = joined([t.lower() for t in texts])
    starts, ends = word_bounds(data)
    lines = np.searchsorted(starts, at)
    starts, ends = starts.copy(), ends.copy()
    for _ in range(4):
        cut = (ends > starts) & _TRIM[data[np.maximum(ends - 1, 0)]] if len(data) else np.zeros(0, bool)
        ends -= cut
        cut = (ends > starts) & _TRIM[data[np.minimum(starts, len(data) - 1)]] if len(data) else np.zeros(0, bool)
        starts += cut
    if len(starts):  # a word said over and over counts once
        hashes = span_hashes(data, starts, ends)
        fresh = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        fresh[lines[:-1][np.diff(lines) > 0]] = True
        lines = np.concatenate(([0], np.cumsum(fresh)))[lines]
        starts, ends = starts[fresh], ends[fresh]
    return data, starts, ends, lines


def grams_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the words' n-grams with word boundaries, and the first of each word."""
    n = len(starts)
    sizes = ends - starts + 2
    at = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.full(at[-1], ord("<"), np.uint8)
    place = np.arange(at[-1]) - np.repeat(at[:-1], sizes)
    inside = (place > 0) & (place < np.repeat(sizes, sizes) - 1)
    flat[inside] = data[np.repeat(starts, sizes)[inside] + place[inside] - 1]
    flat[at[1:] - 1] = ord(">")
    left = np.repeat(sizes, sizes) - place
    rows, owner = [], []
    word = np.repeat(np.arange(n), sizes)
    for g in GRAMS:
        begin = np.flatnonzero(left >= g)
        rows.append(span_hashes(flat, begin, begin + g) % np.uint64(BUCKETS))
        owner.append(word[begin])
    rows.append(mix(span_hashes(flat, at[:-1], at[1:])) % np.uint64(BUCKETS))
    owner.append(np.arange(n))
    rows, owner = np.concatenate(rows).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


def passages(lines: np.ndarray, window: int = WINDOW, step: int = WINDOW // 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, text) of the texts' passages, half of a window apart."""
    sizes = np.diff(lines)
    count = np.where(sizes > 0, np.maximum(1, -(-(sizes - window) // step) + 1), 0)
    doc = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = lines[:-1][doc] + np.minimum(k * step, np.maximum(sizes[doc] - window, 0))
    return first, np.minimum(first + window, lines[1:][doc]), doc


def pooled(odds: np.ndarray, doc: np.ndarray, n: int, sharp: float, empty: float) -> np.ndarray:
    """The soft maximum of each text's passages."""
    out = np.full(n, empty)
    if len(odds):
        heads = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        top = np.maximum.reduceat(odds, heads)
        size = np.diff(np.append(heads, len(doc)))
        share = np.exp(np.maximum(sharp * (odds - np.repeat(top, size)), -60.0))
        out[doc[heads]] = np.add.reduceat(share * odds, heads) / np.add.reduceat(share, heads)
    return out


class Model:
    def __init__(self, weight: np.ndarray, bias: float, sharp: float):
        """``weight``: the contribution of each table row, the embedding table times the softmax's weights."""
        self.weight, self.bias, self.sharp = weight.astype(np.float32), float(bias), sharp

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The contribution of every word; equal words are computed once for a batch."""
        _, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        rows, at = grams_of(data, starts[first], ends[first])
        sums = np.add.reduceat(self.weight[rows].astype(np.float64), at[:-1]) if len(rows) else np.empty(0)
        return (sums / np.diff(at))[back]

    def scores(self, texts: list[str]) -> np.ndarray:
        data, starts, ends, lines = words_of(texts)
        odds = np.empty(0)
        doc = np.empty(0, int)
        if len(starts):
            sums = np.concatenate(([0.0], np.cumsum(self.words(data, starts, ends))))
            first, end, doc = passages(lines)
            odds = (sums[end] - sums[first]) / (end - first) + self.bias
        z = pooled(odds, doc, len(texts), self.sharp, self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(texts: list[str], labels: np.ndarray, dim: int = 8, epochs: int = 10, least_batches: int = 200, rate: float = 0.6, sharp: float = 2.0, seed: int = 11) -> Model:
    """Adagrad on the documents' log loss; the first epochs look at softer maxima, few documents get more epochs."""
    data, starts, ends, lines = words_of(texts)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    if not len(starts) or share < 2e-3 or share > 1 - 2e-3:
        return Model(np.zeros(BUCKETS), np.log(share / (1 - share)), sharp)
    _, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    rows, at = grams_of(data, starts[first], ends[first])
    size = np.diff(at)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    out = np.zeros(dim)
    out[:] = rng.uniform(-0.5, 0.5, dim)
    bias, g_table, g_out, g_bias = np.log(share / (1 - share)), np.full(BUCKETS, 1e-6), np.full(dim, 1e-6), 1e-6
    p_first, p_end, p_doc = passages(lines, step=WINDOW)
    p_at = np.searchsorted(p_doc, np.arange(len(texts) + 1))
    order = np.arange(len(texts))
    balance = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.8
    epochs = max(epochs, min(40, -(-least_batches * 64 // len(order))))
    for epoch in range(epochs):
        tau = sharp * min(1.0, epoch / (0.4 * epochs))
        rng.shuffle(order)
        for s in range(0, len(order), 64):
            ids = np.sort(order[s : s + 64])
            ids = ids[p_at[ids + 1] > p_at[ids]]
            if not len(ids):
                continue
            p = np.concatenate([np.arange(p_at[i], p_at[i + 1]) for i in ids])
            doc = np.repeat(np.arange(len(ids)), p_at[ids + 1] - p_at[ids])
            span = p_end[p] - p_first[p]
            w = back[np.concatenate([np.arange(a, b) for a, b in zip(p_first[p], p_end[p], strict=True)])]
            words, w_back = np.unique(w, return_inverse=True)
            g = np.concatenate([rows[at[i] : at[i + 1]] for i in words])
            g_heads = np.concatenate(([0], np.cumsum(size[words])[:-1]))
            vectors = np.add.reduceat(table[g], g_heads, axis=0) / size[words][:, None]
            p_heads = np.concatenate(([0], np.cumsum(span)[:-1]))
            mean = np.add.reduceat(vectors[w_back], p_heads, axis=0) / span[:, None]
            odds = mean @ out + bias
            heads = np.searchsorted(doc, np.arange(len(ids)))
            top = np.maximum.reduceat(odds, heads)
            soft = np.exp(np.maximum(tau * (odds - top[doc]), -60.0))
            soft /= np.add.reduceat(soft, heads)[doc]
            z = np.add.reduceat(soft * odds, heads)
            pull = (1 / (1 + np.exp(-z)) - labels[ids]) * balance[ids] / len(ids)
            d = pull[doc] * soft * (1 + tau * (odds - z[doc]))
            grad_out = d @ mean
            pull_word = np.bincount(w_back, np.repeat(d / span, span), len(words)) / size[words]
            uniq, u_back = np.unique(g, return_inverse=True)
            grad = np.bincount(u_back, np.repeat(pull_word, size[words]), len(uniq))[:, None] * out[None, :]
            g_table[uniq] += (grad * grad).mean(axis=1)
            table[uniq] -= rate * grad / np.sqrt(g_table[uniq])[:, None]
            g_out += grad_out * grad_out
            out -= 0.1 * grad_out / np.sqrt(g_out)
            g_bias += d.sum() ** 2
            bias -= 0.05 * d.sum() / np.sqrt(g_bias)
    return centred(Model(table @ out, bias, sharp), texts, labels)


def centred(model: Model, texts: list[str], labels: np.ndarray) -> Model:
    """The bias moved so that even odds lie midway between the classes' training scores."""
    scores = np.concatenate([model.scores(texts[i : i + 200]) for i in range(0, len(texts), 200)])
    odds = np.log(np.clip(scores, 1e-12, 1 - 1e-12)) - np.log(np.clip(1 - scores, 1e-12, 1 - 1e-12))
    low, high = np.quantile(odds[labels > 0], 0.02), np.quantile(odds[labels == 0], 0.995)
    return Model(model.weight, model.bias - float(np.clip((low + high) / 2, -2.0, 2.0)), model.sharp)


# ---------------------------------------------------------------- operator


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_docs: int = 4000, max_bytes: int = 16 << 20, text: str = "text", key: str = "doc_id") -> Model:
    rows = sorted(sample(docs, labels, label, max_docs, max_bytes, text, key).collect(), key=lambda r: (r["doc_id"], r["label"], r["text"] or ""))  # at most max_docs texts of max_bytes
    return train([r["text"] or "" for r in rows], np.array([float(r["label"] != 0) for r in rows]))


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    fields = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(texts_in(batch, "text")))], schema=fields)

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
