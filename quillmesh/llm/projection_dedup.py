"""Near duplicates among embeddings by collision-counting projections.

Vectors are projected on ``m`` random directions. On each direction the projections are
sorted, and a window of half-width ``window`` is centred on every query's projection; two
vectors collide on a direction if one lies in the other's window. For unit vectors of cosine
c the projections' difference is normal with variance 2 - 2c, which gives the collision
probability of a pair of cosine ``threshold`` and from it the calibrated count: the largest
that such a pair reaches with probability ``recall``. Pairs that reach it are verified by
their cosine in double precision.

Vectors are compared only inside a label. Equal vectors are one row with a count. A label's
rows are dealt into blocks of about ``block`` rows; a task sorts the projections of two blocks,
counts collisions of their rows, and returns sums of links per row and a spanning forest
instead of the pairs, so a group of near copies of any size adds at most one row for each of
its vectors to a task.

A window holds a fixed share of a label's rows (0.22 of them for vectors in all directions at
the default width), so counting is quadratic in the label's size by nature, and a table of all
collisions would be larger still; that is why counts never leave a task. The blocks bound what
a task holds, and a row is sent once for each block of its label. Counting costs more than
multiplying all vectors of 64 components would: it is the method asked for, not the fastest.

Defined results: a null label, a null or zero vector, one with null or non-finite components
and one of length zero link with nothing; vectors of different length do not link; equal
vectors link; repeated ids are rows of their own that share the smallest id's component; a
null id links like any other but is no component's name; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_join, materialize
from .components import components

COSINE = 0.93


def collision(cosine: float, window: float) -> float:
    return math.erf(window / math.sqrt(2 * max(2 - 2 * cosine, 1e-300)))


def calibrated_count(m: int, window: float, threshold: float, recall: float) -> int:
    """The largest count that a pair at the threshold reaches with this probability."""
    p = collision(threshold, window)
    tail, count = 0.0, m
    for k in range(m, -1, -1):
        tail += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        count = k
        if tail >= recall:
            break
    return count


def directions(m: int, dim: int) -> np.ndarray:
    return np.random.default_rng(dim * 1000 + 17).standard_normal((m, dim))


def colliding(a: np.ndarray, b: np.ndarray, window: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that share at least ``least`` windows; both are projections."""
    found_a, found_b = [], []
    orders = [np.argsort(b[:, j], kind="stable") for j in range(b.shape[1])]
    ordered = [b[o, j] for j, o in enumerate(orders)]
    for start in range(0, len(a), 256):
        part = a[start : start + 256]
        counts = np.zeros(len(part) * len(b), np.uint16)
        for j, (order, values) in enumerate(zip(orders, ordered, strict=True)):
            low = np.searchsorted(values, part[:, j] - window, "left")
            size = np.searchsorted(values, part[:, j] + window, "right") - low
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) + np.repeat(low - (ends - size), size)
            counts[np.repeat(np.arange(len(part)) * len(b), size) + order[place]] += 1  # no pair twice on a direction
        hit = np.flatnonzero(counts >= least)
        found_a.append(hit // len(b) + start)
        found_b.append(hit % len(b))
    return np.concatenate(found_a), np.concatenate(found_b)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable row of each row, by pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def linked(x: np.ndarray, weight: np.ndarray, y: np.ndarray | None, other: np.ndarray | None, threshold: float, m: int, window: float, recall: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links between the rows of x and y (or inside x): (links of x, links of y, pairs' ends)."""
    same = y is None
    y, other = (x, weight) if same else (y, other)
    ux = x / np.linalg.norm(x, axis=1, keepdims=True)
    uy = ux if same else y / np.linalg.norm(y, axis=1, keepdims=True)
    d = directions(m, x.shape[1])
    a, b = colliding(ux @ d.T, uy @ d.T, window, calibrated_count(m, window, threshold, recall))
    if same:
        a, b = a[a < b], b[a < b]
    keep = np.empty(len(a), dtype=bool)
    for s in range(0, len(a), 100_000):
        i, j = a[s : s + 100_000], b[s : s + 100_000]
        keep[s : s + 100_000] = np.einsum("ij,ij->i", ux[i], uy[j]) >= threshold
    a, b = a[keep], b[keep]
    nx, ny = np.bincount(a, other[b], len(x)), np.bincount(b, weight[a], len(y))
    return (nx + ny, ny, a, b) if same else (nx, ny, a, b)


def near_duplicates(vectors: DataFrame, embedding: str = "embedding", label: str = "label", key: str = "vec_id", threshold: float = COSINE, m: int = 20, window: float = 0.4, recall: float = 0.995, block: int = 2048) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id, kept for every vector."""
    e = F.col("e")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("e"))
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    able = F.coalesce(F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite, F.lit(False))
    stored = Scratch()
    rows = stored(rows.select("vec_id", "label", F.when(able, e).alias("e")), "vectors")
    good = rows.where("e is not null")
    groups = good.groupBy("label", "e").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies")).withColumn("dim", F.size("e"))
    groups = stored(groups.withColumn("rep", F.monotonically_increasing_id()), "vector-groups")

    counts = groups.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    dealt = groups.join(counts, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    sent = dealt.select("label", "dim", "rep", "copies", "e", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    sent = sent.select("label", "dim", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "rep", "copies", "e", "own")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        e, reps, copies = np.stack(frame["e"].to_numpy()).astype(np.float64), frame["rep"].to_numpy(), frame["copies"].to_numpy(np.float64)
        peak = np.abs(e).max(axis=1, keepdims=True)
        e = e / peak  # squares stay finite
        first = (frame["own"] == i).to_numpy()
        if i == j:
            n, _, a, b = linked(e, copies, None, None, threshold, m, window, recall)
            root = _forest(len(e), a, b)
            return pd.DataFrame({"rep": reps, "links": n.astype(np.int64), "root": reps[root]})
        p, q = np.flatnonzero(first), np.flatnonzero(~first)
        if not len(p) or not len(q):
            return pd.DataFrame({"rep": reps[:0], "links": np.empty(0, np.int64), "root": reps[:0]})
        nx, ny, a, b = linked(e[p], copies[p], e[q], copies[q], threshold, m, window, recall)
        n = np.zeros(len(e), np.int64)
        n[p], n[q] = nx, ny
        root = _forest(len(e), p[a], q[b])
        return pd.DataFrame({"rep": reps, "links": n, "root": reps[root]})

    found = stored(sent.groupBy("label", "dim", "i", "j").applyInPandas(run, "rep long, links long, root long").where("links > 0"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch=stored)
    known = groups.join(links, "rep", "left").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    known = known.select("label", "e", "rep", "low", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    known = stored(known, "vector-roots")
    names = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = hot_join(known, names, ["root"], ["rep"], known.count()).select("label", "e", "n_links", "component_id")
    linked_rows = hot_join(good, known, ["label", "e"], ["vec_id"], good.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("e is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = materialize(linked_rows.union(alone), "vector-components")
    stored.drop()
    return every.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
