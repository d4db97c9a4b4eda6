"""Near duplicates by DartMinHash signatures of five-word shingles.

A text is the weighted set of its shingles, a shingle's weight its number of occurrences, and
texts are near duplicates when their weighted Jaccard similarity is ``threshold`` or more
(for texts that repeat no shingle this is the plain Jaccard similarity).

Signatures: every unit of a shingle's weight is a strip on which hashed darts fall as a
Poisson process of rate one, the same darts in every text. A text of total weight W looks at
the darts of its own strips whose rank is below t / W, about t darts whatever its length; a
dart's hash deals it to one of ``k`` coordinates, and the earliest dart of each coordinate
is the signature (texts with an empty coordinate look twice as far). Two texts agree at a
coordinate with the probability of their similarity.

Links: texts with equal shingles are one class at once. Signatures are cut into bands; texts
that agree on a band are compared, exactly and on whole texts, with the band's first text.
Where a band's other texts then still fall into several components, a task takes them (or two
blocks of a large band) and tries their pairs across components exactly, most equal signatures
first; only pairs that join components leave the task, so chains of edits of any length close
up without a list of their pairs. Components of the links are the classes.
Keys with a great share of the rows (a digest, a band, a text, a component, a class) are dealt
over several tasks in every join. Intermediate tables are deleted after use.
The bands find a pair of similarity 0.8 with probability 1 - (1 - 0.8**rows)**bands.

Defined results: null, empty and blank texts have no shingles and are classes of their own;
texts of one to four words are a single shingle; repeated ids are one document with the
smallest text; rows without an id are left out; an empty table gives no rows; the input's
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_join, joined, materialize, mix, pieces, shingle_hashes, sieved, span_hashes, texts_in, word_bounds
from .components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(texts: list[str], size: int = WORDS) -> list[np.ndarray]:
    """The shingles of each text as hashes, in order and with repeats."""
    data, at = joined(texts)
    starts, ends = word_bounds(data)
    words = span_hashes(data, starts, ends)
    cut = np.searchsorted(starts, at)
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own = words[a:b]
        out.append(shingle_hashes(own, min(size, b - a)) if b > a else np.empty(0, np.uint64))
    return out


def strips(bag: np.ndarray) -> np.ndarray:
    """One key for each unit of weight: the shingle's hash and its occurrence's number."""
    ordered = np.sort(bag)
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    place = np.arange(len(ordered))
    number = place - np.maximum.accumulate(np.where(first, place, 0))
    with np.errstate(over="ignore"):
        return np.where(number == 0, ordered, mix(ordered + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def signatures(bags: list[np.ndarray], k: int = BANDS * ROWS) -> np.ndarray:
    """A row of ``k`` dart hashes for each weighted set; an empty set's row is all ones."""
    out = np.full((len(bags), k), _NONE)
    todo = np.array([i for i, b in enumerate(bags) if len(b)], dtype=np.int64)
    if not len(todo):
        return out
    keys = [strips(bags[i]) for i in todo]
    sizes = np.array([len(x) for x in keys])
    key = np.concatenate(keys)
    owner = np.repeat(np.arange(len(todo)), sizes)
    wanted = k * np.log(k) + 2 * k
    best = np.full(len(todo) * k, np.inf)
    dart = np.full(len(todo) * k, _NONE)
    limit = wanted / sizes
    live = np.ones(len(todo), dtype=bool)
    while live.any():
        at = np.flatnonzero(live[owner])
        rank, turn = np.zeros(len(at)), 0
        while len(at):
            turn += 1
            with np.errstate(over="ignore"):
                h = mix(key[at] + np.uint64(turn) * np.uint64(0xA0761D6478BD642F))
            rank = rank - np.log1p(-(h >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            near = rank < limit[owner[at]]
            at, rank, h = at[near], rank[near], h[near]
            place = owner[at] * k + (mix(h) % np.uint64(k)).astype(np.int64)
            order = np.lexsort((rank, place))
            place, r, d = place[order], rank[order], h[order]
            head = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.empty(0, bool)
            place, r, d = place[head], r[head], d[head]
            better = r < best[place]
            best[place[better]], dart[place[better]] = r[better], d[better]
        live &= np.isinf(best.reshape(-1, k)).any(axis=1)
        limit = np.where(live, limit * 2, limit)
    out[todo] = dart.reshape(-1, k)
    return out


def band_hashes(rows: np.ndarray, bands: int = BANDS, per: int = ROWS) -> np.ndarray:
    out = np.zeros((len(rows), bands), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(per):
            out = mix(out ^ (rows[:, j : bands * per : per] + np.uint64(j)))
        return mix(out + np.arange(bands, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted strip arrays."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _signed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, the digest of the text's shingles, its weight and its band hashes."""
    fields = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("digest2", pa.int64()), ("weight", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            bags = [np.sort(b) for b in shingles(texts_in(batch, "text"))]
            bands = band_hashes(signatures(bags)).view(np.int64)
            with np.errstate(over="ignore"):
                digest = np.array([mix(np.sum(mix(b), dtype=np.uint64).reshape(1))[0] ^ np.uint64(len(b)) for b in bags], np.uint64).view(np.int64)
                digest2 = np.array([np.sum(mix(b ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) for b in bags], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bags) + 1) * bands.shape[1], pa.int32()), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest), pa.array(digest2), pa.array([len(b) for b in bags], pa.int64()), lists], schema=fields)

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, digest long, digest2 long, weight long, bands array<long>")


def _compared(pairs: DataFrame, texts: DataFrame, per_task: int = 512) -> DataFrame:
    """The pairs (a, b) with their exact similarity j, from the whole texts (id, t).

    A text a is sent once, ahead of the texts it is compared with; a text with many partners
    is sent once to each of the parts that these are dealt into.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(per_task)).cast("int").alias("parts"))
    heads = parts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    total = pairs.count()
    dealt = hot_join(pairs, parts, ["a"], ["b"], total).select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    # Heads and partners get their texts in one join, so the texts are dealt by id once.
    rows = hot_join(heads.union(dealt), texts.select("id", "t"), ["id"], ["a", "part"], 2 * total).select("a", "part", "b", "t")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("j", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, np.uint64)
        for batch in pieces(batches, "t", 2 << 20):
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = []
            for x, y, bag in zip(a, b, shingles(texts_in(batch, "t")), strict=True):
                own = np.sort(strips(bag)) if len(bag) else bag
                if y is None:
                    held = own
                else:
                    out.append((x, y, similarity(held, own)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(fields)], schema=fields)

    return rows.mapInArrow(run, "a long, b long, j double")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, block: int = 512) -> DataFrame:
    """doc_id, class_id (the smallest id of its class), class_size, kept (one document of each class)."""
    stored = Scratch()
    signed = stored(_signed(docs, text, key), "signed")
    digest = ["digest", "digest2", "weight"]
    full = signed.where("weight > 0")
    reps = stored(full.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "representatives")
    member = hot_join(full.select("doc_id", *digest), reps.select(*digest, "rep"), digest, ["doc_id"], full.count()).select("doc_id", "rep").distinct()

    banded = reps.select("rep", F.explode("bands").alias("band"))
    first = banded.groupBy("band").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    shared = stored(hot_join(banded, first, ["band"], ["rep"], BANDS * reps.count()).select("band", "a", F.col("rep").alias("b")), "shared-bands")
    wanted = stored(shared.select(F.col("b").alias("id")).distinct(), "wanted")
    # All joins with these texts are by id, so a few others among them change nothing.
    texts = sieved(docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t")).where("id is not null"), "id", wanted, stored)
    if signed.groupBy("doc_id").count().where("count > 1").limit(1).count():  # else texts need no dealing by id
        texts = texts.groupBy("id").agg(F.min("t").alias("t"))
    texts = stored(texts, "near-texts")

    pairs = stored(shared.where("a <> b").select("a", "b").distinct(), "pairs")
    judged = stored(_compared(pairs, texts), "judged")
    links = judged.where(F.col("j") >= threshold).select("a", "b")
    roots = components(links, scratch=stored)
    # Every pair with a band's first text is judged, so only the others are opened.
    open_ = stored(_open(shared.where("a <> b"), roots), "open-bands")
    found = stored(_linked_inside(open_, texts, threshold, block, stored).distinct(), "inside-bands")
    if found.limit(1).count():
        roots = components(links.union(found), scratch=stored)
    classes = (
        member.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"))
        .union(signed.where("weight = 0").select("doc_id", F.col("doc_id").alias("class_id")).distinct())
        .groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    )
    classes = materialize(classes, "classes")
    stored.drop()
    sizes = classes.groupBy("class_id").agg(F.count("*").alias("class_size"))
    return hot_join(classes, sizes, ["class_id"], ["doc_id"], classes.count()).select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def _open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, b, root, n) of the bands whose texts in ``shared`` fall into several components."""
    rooted = shared.join(roots.select(F.col("node").alias("b"), "root"), "b", "left").select("band", "b", F.coalesce("root", "b").alias("root"))
    several = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("band", "n")
    return hot_join(rooted, several, ["band"], ["b"], shared.count())


def _least_agreement(k: int, threshold: float, lost: float = 1e-6) -> int:
    """The count of equal coordinates that a pair at the threshold misses with this probability."""
    total = 0.0
    for c in range(k + 1):
        total += math.comb(k, c) * threshold**c * (1 - threshold) ** (k - c)
        if total > lost:
            return c
    return k


def candidates(roots: np.ndarray, side: np.ndarray, sig: np.ndarray, bands: np.ndarray, band: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one band's texts, as places x and y, that may join two components, and their count of equal coordinates.

    Pairs where a link is next to impossible are left out. A pair that shares several bands is
    given in the first of them only. ``side`` tells two blocks apart: pairs lie across them, or
    inside if there is one.
    """
    least = _least_agreement(sig.shape[1], threshold)
    column = np.argmax(bands == band, axis=1)
    two = side.min() != side.max()
    xs, ys, cs = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for x in np.flatnonzero(side == side.min()):
        y = np.flatnonzero(side != side[x]) if two else np.arange(x + 1, len(roots))
        y = y[roots[y] != roots[x]]
        if len(y):
            c = (sig[y] == sig[x]).sum(axis=1)
            ok = c >= least
            y, c = y[ok], c[ok]
            if len(y):
                ok = np.argmax(bands[y] == bands[x], axis=1) >= column[x]
                xs.append(np.full(ok.sum(), x)), ys.append(y[ok]), cs.append(c[ok])
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(cs)


def forest(ids: np.ndarray, roots: np.ndarray, side: np.ndarray, sig: np.ndarray, bands: np.ndarray, band: int, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links between the components of one band's texts, as few as join what can be joined.

    The candidates are tried from the most equal coordinates down; a pair inside one component
    is passed over.
    """
    a, b, c = candidates(roots, side, sig, bands, band, threshold)
    _, group = np.unique(roots, return_inverse=True)
    parent = list(range(group.max() + 1))

    def find(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    out = []
    for i in np.argsort(-c, kind="stable"):
        x, y = int(a[i]), int(b[i])
        gx, gy = find(group[x]), find(group[y])
        if gx != gy and similarity(sets[x], sets[y]) >= threshold:
            parent[gx] = gy
            out.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
    return out


def _linked_inside(open_: DataFrame, texts: DataFrame, threshold: float, block: int, stored: Scratch) -> DataFrame:
    """Pairs (a, b) that join components inside the open bands.

    A band of more than ``block`` texts is dealt into blocks, and every two blocks meet in a
    task of their own. Signatures meet first; only texts of candidate pairs are then sent whole,
    to the blocks of those pairs. Only joining pairs leave a task, fewer than it has texts.
    """
    described = pa.schema([("b", pa.int64()), ("sig", pa.binary()), ("own", pa.binary()), ("strips", pa.binary())])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t", 2 << 20):
            bags = [np.sort(b) for b in shingles(texts_in(batch, "t"))]
            sig = signatures(bags)
            own = band_hashes(sig)
            whole = [np.sort(strips(b)).tobytes() if len(b) else b"" for b in bags]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(x >> np.uint64(32)).astype(np.uint32).tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(whole, pa.binary())], schema=described)

    wanted = stored(open_.select(F.col("b").alias("id")).distinct(), "wanted")
    about = stored(sieved(texts.select("id", "t"), "id", wanted, stored).select("id", "t").mapInArrow(describe, "b long, sig binary, own binary, strips binary"), "described")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    dealt = open_.withColumn("mine", F.pmod(F.xxhash64("b", "band"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("k"), "mine", "b", "root")

    def met(places: DataFrame, *columns: str) -> DataFrame:
        rows = places.join(about.select("b", *columns), "b").select("band", "i", "k", "mine", "b", "root", *columns)
        return rows.repartition("band", "i", "k").sortWithinPartitions("band", "i", "k", "b")

    def arrays(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        mine, ids, roots, sig, own = list(zip(*held, strict=True))[:5]
        return np.array(ids), np.array(roots), np.array(mine), np.stack([np.frombuffer(x, np.uint32) for x in sig]), np.stack([np.frombuffer(x, np.int64) for x in own])

    found = pa.schema([("band", pa.int64()), ("i", pa.int32()), ("k", pa.int32()), ("mine", pa.int32()), ("b", pa.int64()), ("root", pa.int64())])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _meetings(batches):
            _, roots, side, sig, bands = arrays(held)
            x, y, _ = candidates(roots, side, sig, bands, key[0], threshold)
            if len(x):
                live = [(*key, *held[p][:3]) for p in np.union1d(x, y)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*live, strict=True), found, strict=True)], schema=found)

    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _meetings(batches):
            ids, roots, side, sig, bands = arrays(held)
            links = forest(ids, roots, side, sig, bands, key[0], [np.frombuffer(h[5], np.uint64) for h in held], threshold)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], schema=pairs)

    live = stored(met(dealt, "sig", "own").mapInArrow(paired, "band long, i int, k int, mine int, b long, root long"), "live")
    return met(live, "sig", "own", "strips").mapInArrow(linked, "a long, b long")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(band, i, k) and the rest of its rows, where texts of several components meet.

    A task of two blocks needs both; a task of one block has only its own rows.
    """

    def due(key: tuple | None, held: list[tuple]) -> bool:
        return len({h[2] for h in held}) > 1 and (key[1] == key[2] or len({h[0] for h in held}) > 1)

    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != key:
                if due(key, held):
                    yield key, held
                key, held = row[:3], []
            held.append(row[3:])
    if due(key, held):
        yield key, held
