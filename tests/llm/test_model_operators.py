"""Classifiers, near duplicates, embeddings, mixing and the pipeline on small tables."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import dart_minhash as D
from quillmesh.llm import mixing as M
from quillmesh.llm import projection_dedup as E
from quillmesh.llm import quality_crf as Q
from quillmesh.llm import toxicity_subword as X
from quillmesh.llm.common import Scratch, hot_join
from quillmesh.llm.components import components


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


# ---------------------------------------------------------------- classifiers


def labelled(spark, make, n=300, seed=7):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        y = rng.randrange(2)
        rows.append((i, make(rng, y)))
        labels.append((i, y, y))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (None, "plain words")]
    labels += [(n, 1, 0), (n + 5, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels[:n]


def accuracy(got, labels):
    test = [(i, y) for i, y, _ in labels if held(i)]
    return np.mean([got[i]["predicted"] == y for i, y in test])


def sentence(rng):
    return " ".join(rng.choice(["river", "stone", "garden", "window", "letter", "walking", "morning", "quiet"]) + rng.choice(["", "s", "ly"]) for _ in range(12)) + "."


def test_quality_learns_junk_lines(spark):
    def make(rng, y):
        lines = [sentence(rng) for _ in range(6)]
        return "\n".join(lines if y else [x.upper().replace(" ", "!! ### ") for x in lines[1:]] + lines[:1])

    table, labels, known = labelled(spark, make)
    model = Q.learn(table, labels)
    clash = table.withColumn("score", F.lit("x")).withColumn("label", F.lit(9)).withColumn("held_out", F.lit(1))
    got = {r["doc_id"]: r for r in Q.score(clash, model).collect()}
    assert accuracy(got, known) >= 0.95 and abs(model.coupling) < 3
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == table.count()
    assert all(r["held_out"] == (i is not None and held(i)) for i, r in got.items())
    empty = Q.learn(table, labels.limit(0))
    assert {r["score"] for r in Q.score(table.where("text = ''"), empty).collect()} == {0.5}
    assert Q.score(table.limit(0), empty).count() == 0


def test_training_lowers_the_loss_of_documents_and_learns_the_coupling():
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 7, 80)
    at = np.concatenate(([0], np.cumsum(sizes)))
    ratios, chars = rng.random((at[-1], len(Q.RATIOS))).astype(np.float32), rng.integers(5, 90, at[-1])
    labels = rng.integers(0, 2, 80).astype(float)

    def loss(model):
        s = np.clip(model.scores(ratios, chars, at)[sizes > 0], 1e-6, 1 - 1e-6)
        return -np.mean(np.where(labels[sizes > 0] > 0, np.log(s), np.log(1 - s)))

    first, last = Q.train(ratios, chars, at, labels, steps=0), Q.train(ratios, chars, at, labels)
    assert first.coupling == 0 and 0 < abs(last.coupling) < 3 and loss(last) < loss(first)


def test_samples_are_bounded_in_rows_and_bytes(spark):
    rows = [(i % 20, "é" * (i % 7 + 1)) for i in range(200)] + [(None, "x"), (3, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] * 2, "doc_id long, quality int")
    got = Q.sample(table, labels, "quality", 12, 1 << 20).collect()
    assert len({r["doc_id"] for r in got}) <= 12 and len(got) <= 12 and not any(held(r["doc_id"]) for r in got)
    some = Q.sample(table, labels, "quality", 12, 9).collect()
    assert 0 < len(some) < len(got) and sum(len((r["text"] or "").encode()) for r in some) <= 9


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    sizes = [1, 4, 0, 6, 3]
    at = np.concatenate(([0], np.cumsum(sizes)))
    odds, c = rng.normal(size=at[-1]), 0.7
    good, equal = Q.Chain.marginals(odds, c, at)
    for a, b in zip(at[:-1], at[1:], strict=True):
        n = b - a
        total, up, same = 0.0, np.zeros(n), np.zeros(n)
        for bits in range(1 << n):
            y = [(bits >> k) & 1 for k in range(n)]
            w = np.exp(sum(o * v for o, v in zip(odds[a:b], y, strict=True)) + sum(c if p == q else -c for p, q in zip(y, y[1:], strict=False)))
            total += w
            up += w * np.array(y)
            same[1:] += w * np.array([p == q for p, q in zip(y, y[1:], strict=False)])
        if n:
            assert np.allclose(good[a:b], up / total) and np.allclose(equal[a + 1 : b], same[1:] / total)


def test_toxicity_knows_misspellings(spark):
    bad = ["dreadfool", "scoundrelly", "wretchling", "vilebeast"]

    def make(rng, y):
        words = " ".join(sentence(rng) for _ in range(rng.randint(1, 12))).split()
        for _ in range(2 * y):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        return " ".join(words)

    table, labels, known = labelled(spark, make)
    model = X.learn(table, labels)
    got = {r["doc_id"]: r for r in X.score(table, model).collect()}
    assert accuracy(got, known) >= 0.95 and all(0 <= r["score"] <= 1 for r in got.values())
    long = " ".join([sentence(random.Random(1))] * 300)
    clean, spelt = model.scores([long, long[:9000] + " scoundrely wretchlinng " + long[9000:]])
    assert clean < 0.5 < spelt
    assert X.score(table.limit(0), X.learn(table, labels.limit(0))).count() == 0


# ---------------------------------------------------------------- near duplicates


def plain_classes(texts):
    bags = [D.shingles([t or ""])[0] for t in texts]
    sets = [np.sort(D.strips(np.sort(b))) if len(b) else b for b in bags]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if len(sets[i]) and D.similarity(sets[i], sets[j]) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts: list = [None, "", "  ", "a b", "a  b", "a b c"]
    for _ in range(8):
        base = [word() for _ in range(rng.choice([20, 80, 300]))]
        texts.append(" ".join(base))
        for k in range(6):
            base = list(base)
            base[rng.randrange(len(base))] = word()
            texts.append(("\n" if k == 2 else " ").join(base))
        texts += [texts[-1]] * 2
    texts.append("loop here again " * 40)
    texts.append("loop here again " * 41)
    table = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, band string").withColumn("a", F.lit(1)).withColumn("_part", F.lit("p"))
    got = {r["doc_id"]: r for r in D.near_duplicates(table).collect()}
    want = plain_classes(texts)
    assert {i: r["class_id"] for i, r in got.items()} == dict(enumerate(want))
    assert all(r["kept"] == (i == r["class_id"]) and r["class_size"] == want.count(r["class_id"]) for i, r in got.items())
    small = {r["doc_id"]: r["class_id"] for r in D.near_duplicates(table, block=4).collect()}
    assert small == dict(enumerate(want))
    assert D.near_duplicates(table.limit(0)).count() == 0


def test_bands_whose_pairs_are_all_judged_are_not_opened(spark, monkeypatch):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(5):  # pairs of similarity 0.72: they share bands, and aren't linked
        base = [word() for _ in range(122)]
        texts.append(" ".join(base))
        for k in (20, 50, 80, 100):
            base[k] = word()
        texts.append(" ".join(base))
    opened, inside = [], D._linked_inside

    def seen(open_, *rest):
        opened.append(open_.count())
        return inside(open_, *rest)

    monkeypatch.setattr(D, "_linked_inside", seen)
    got = D.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == list(enumerate(plain_classes(texts)))
    assert opened == [0]


def test_bits_tell_rows_without_moving_them(spark):
    from quillmesh.llm import common

    rows = spark.range(0, 80000, 1, 3).select(F.col("id").alias("k"), F.monotonically_increasing_id().alias("_row"))
    rows = spark.createDataFrame(rows.toPandas())
    gone = rows.where("k % 7 = 3 or k in (0, 79999)").select("_row")
    want = {r["_row"] for r in rows.collect()} - {r["_row"] for r in gone.collect()}
    for most in (common.MOST_BITMAPS, 0):  # broadcast, and by shuffle
        with pytest.MonkeyPatch.context() as m:
            m.setattr(common, "MOST_BITMAPS", most)
            got = [r["_row"] for r in common.without(rows, "_row", gone, "gone").collect()]
        assert len(got) == len(want) and set(got) == want
    assert common.without(rows, "_row", gone.limit(0), "gone").count() == 80000
    stored = Scratch()
    ids = spark.createDataFrame([(-5,), (3,), (2**62,)], "id long")
    many = rows.select(F.col("k").alias("id")).union(ids)
    kept = [r["id"] for r in common.sieved(many, "id", ids, stored).collect()]
    assert kept.count(3) == 2 and {-5, 2**62} <= set(kept) and len(kept) < 200
    assert common.sieved(many, "id", ids.limit(0), stored).count() == 0
    stored.drop()


def test_hot_joins_keep_every_row(spark):
    many = spark.range(3000).select(F.when(F.col("id") < 1800, 7).when(F.col("id") < 1810, F.lit(None)).otherwise(F.col("id") % 60).alias("k"), F.lit("z").alias("w"), F.col("id").alias("x"))
    one = spark.range(40).select(F.col("id").alias("k"), F.lit("z").alias("w"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got, want = hot_join(many, one, ["k", "w"], ["x"], 3000, how), many.join(one, ["k", "w"], how)
        assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).count() == 0
    assert hot_join(many.limit(0), one, ["k", "w"], ["x"], 0).count() == 0


def test_pairs_of_a_text_with_many_partners_are_compared_exactly(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(999)}" for _ in range(60)]
    texts = [" ".join(base[: 60 - k % 20] + [f"n{k}"] * (k % 7)) for k in range(50)]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 50)] + [(3, 4)], "a long, b long")
    bags = [np.sort(D.strips(np.sort(D.shingles([t])[0]))) for t in texts]
    for per_task in (4096, 7):
        got = {(r["a"], r["b"]): r["j"] for r in D._compared(pairs, table, per_task).collect()}
        assert got == {(a, b): D.similarity(bags[a], bags[b]) for a, b in [*((0, k) for k in range(1, 50)), (3, 4)]}


def test_signatures_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = np.concatenate([a[:320], rng.integers(0, 1 << 63, 80, dtype=np.uint64)])
    a, b = np.concatenate([a, a[:50]]), np.concatenate([b, b[:50]])
    s = D.signatures([np.sort(a), np.sort(b), a[:1], np.empty(0, np.uint64)], k=2000)
    true = D.similarity(np.sort(D.strips(np.sort(a))), np.sort(D.strips(np.sort(b))))
    assert abs((s[0] == s[1]).mean() - true) < 0.05
    assert (s[2] != D._NONE).all() and (s[3] == D._NONE).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (7, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- embeddings


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(240):
        v = base[i % 12] + rng.normal(size=16) * 0.25 * (i % 3)
        rows.append((i, [float(x) for x in v], int(i % 2)))
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, [2 * x for x in rows[0][1]], 0), (1003, None, 0), (1004, [0.0] * 16, 0), (1005, rows[0][1], None), (1006, [float("nan")] + rows[0][1][1:], 0), (1007, rows[0][1][:5], 0), (1008, [], 0), (1009, [None] + rows[0][1][1:], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("root", F.lit("x")).withColumn("rep", F.lit("y")).withColumn("_part", F.lit(1))
    good = [(i, np.array(v), y) for i, v, y in rows if i < 1003 or i == 1007]
    links = {i: set() for i, _, _ in rows}
    for i, v, y in good:
        for j, w, z in good:
            if i != j and y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i].add(j)
    root = {i: i for i in links}
    for _ in range(300):
        changed = False
        for i, near in links.items():
            low = min([root[i], *(root[j] for j in near)])
            changed |= low != root[i]
            root[i] = low
        if not changed:
            break
    for block in (1024, 40):
        got = {r["vec_id"]: r for r in E.near_duplicates(table, block=block).collect()}
        found = sum(r["n_links"] for r in got.values())
        assert found >= 0.97 * sum(map(len, links.values()))
        assert all(got[i]["n_links"] <= len(links[i]) for i in links)
        if found == sum(map(len, links.values())):
            assert {i: r["component_id"] for i, r in got.items()} == root
        assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert E.near_duplicates(table.limit(0)).count() == 0


def test_calibrated_count_keeps_its_recall():
    count = E.calibrated_count(40, 0.5, 0.93, 0.995)
    p = E.collision(0.93, 0.5)
    hits = np.random.default_rng(0).binomial(40, p, 100_000)
    assert (hits >= count).mean() >= 0.99 and (hits >= count + 3).mean() < 0.995


# ---------------------------------------------------------------- mixing


def plain_targets(sizes, share=1.5, most=2.0):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    out, left = {}, share * sum(sizes.values())
    while len(out) < len(order):
        unit = left / sum(weight[s] for s in order if s not in out)
        full = [s for s in order if s not in out and unit * weight[s] >= most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in order if s not in out}
        out |= {s: most * sizes[s] for s in full}
        left = share * sum(sizes.values()) - sum(out.values())
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 0, None: 10}, {}, {"é": 5, "z": 1000, "Z": 3, None: 700, "": 80}, {f"s{i}": i * i for i in range(40)}, {"a": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([("" if s is None else "=" + s, s, n) for s, n in sizes.items()], "part string, source string, total long")
    got = {r["source"]: r["target"] for r in M.targets(rows, M.WEIGHTS, 1.5, 2, Scratch()).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 * max(1, want[k]) for k in want)


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["a", "b", "c", "c", "c", None]), "x") for i in range(600)]
    rows += [(600, None, "a", "x"), (601, "", "d", "x"), (600, " ", "a", "x"), (602, "w " * 3000, "c", "x"), (603, "tie", "b", "x"), (603, "tie", "b", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, rate string").withColumn("part", F.lit(1)).withColumn("_salt", F.lit(2)).withColumn("target", F.lit("t"))
    got = [r.asDict() for r in M.mix(table).collect()]
    again = [r.asDict() for r in M.mix(table.repartition(5), max_sent=1).collect()]
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes = {s: sum(r["size"] for r in got if r["source"] == s) for s in {r["source"] for r in got}}
    want = plain_targets(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]} and abs(own[0]["target"] - want[s]) < 1e-6
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(r["size"] for r in own)
        # The one exponential tilt of the odds that meets the target.
        if 0 < want[s] < 2 * sizes[s]:
            low, high = -50.0, 50.0
            for _ in range(200):
                tilt = (low + high) / 2
                rates = [2 / (1 + math.exp(-min(max(tilt * r["size"] * len(own) / sizes[s], -700), 700))) for r in own]
                low, high = (low, tilt) if sum(x * r["size"] for x, r in zip(rates, own, strict=True)) > want[s] else (tilt, high)
            assert all(abs(x - r["rate"]) < 1e-5 for x, r in zip(rates, own, strict=True) if r["size"])
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert M.mixed(table).count() == sum(r["copies"] for r in got) and M.mixed(table).columns == table.columns
    assert M.mix(table.limit(0)).count() == 0 and M.mixed(table.limit(0)).count() == 0


def test_rows_without_an_id_meet_their_targets(spark):
    rng = random.Random(8)
    rows = [(None if i % 2 else 5, " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 40))), "abc"[i % 3]) for i in range(900)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source", "target").agg(F.sum("taken").alias("n")).collect()
    assert len(got) == 3 and all(abs(r["n"] - r["target"]) <= 40 for r in got)


# ---------------------------------------------------------------- pipeline


def test_pipeline_keeps_what_it_should(spark):
    import corpus_pipeline as C

    rng = random.Random(11)
    clean = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(4000)}x" for _ in range(120)) for _ in range(40)]
    texts = [*clean, clean[3], clean[4] + " one more", "too short", None, clean[5].replace(" ", " ### ") + " #", "mail bob.7@mail.example.com " + clean[6][::-1]]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    step, kept = table, []
    for _, stage in C.STAGES[:-1]:
        step = stage(spark, step, "")
        assert tuple(step.columns) == C.COLUMNS
        step = spark.createDataFrame(step.collect(), step.schema)
        kept.append(sorted(r["doc_id"] for r in step.collect()))
    assert kept[0] == [i for i in range(len(texts)) if i not in (42, 43, 44)]
    assert kept[1] == [i for i in kept[0] if i not in (40, 41)] == kept[2]
    masked = {r["doc_id"]: r["text"] for r in step.collect()}
    assert "@" not in "".join(masked.values())
    packed = C.STAGES[-1][1](spark, step, "").collect()
    assert sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)


def test_quality_stage_keeps_short_documents_with_few_repeated_lines(spark):
    import corpus_pipeline as C

    rng = random.Random(12)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c = line(6), line(5), line(4)
    three, six = [a, line(90), a], [a, b, line(90), a, b, line(20)]
    many = [a, b, c, line(90), a, b, c, line(20)]
    texts = ["\n".join(x) for x in (three, six, many, [line(90)] * 2)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in C.quality_rules(spark, table, "").collect()) == [0, 1]


def test_near_dedup_keeps_different_texts_under_null_and_repeated_ids(spark):
    import corpus_pipeline as C

    rng = random.Random(13)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    none, same, copied = [text() for _ in range(5)], [text() for _ in range(5)], text()
    rows = [(None, t) for t in [*none, copied, copied]] + [(7, t) for t in [*same, same[0], same[1] + " more"]] + [(9, copied), (8, copied), (3, None), (3, "")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in C.near_dedup(spark, table, "").collect()]
    assert sorted((t for i, t in got if i is None)) == sorted(none)
    own = [t for i, t in got if i == 7]
    assert len(own) == 5 and {t.removesuffix(" more") for t in own} == set(same)
    assert sorted((i, t or "") for i, t in got if i not in (None, 7)) == [(3, ""), (3, ""), (8, copied)]


def test_near_dedup_does_not_deal_texts_to_drop_rows(spark):
    import corpus_pipeline as C

    rows = [(i, f"some few words number {i // 2} here", "en", "s", 30) for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = C.near_dedup(spark, table, "")
        assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in out.collect()) == list(range(0, 20, 2))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_span_hashes_do_not_depend_on_blocks():
    from quillmesh.llm.common import joined, span_hashes, word_bounds

    data, _ = joined(["ab cdé " * 3000 + "x" * 5000 + " tail q", "", "ab"])
    a, b = word_bounds(data)
    whole = span_hashes(data, a, b)
    assert (whole == span_hashes(data, a, b, 512)).all() and whole[0] == whole[-1] != whole[1]
