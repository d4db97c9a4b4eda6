import pytest
from pyspark.sql import functions as F

from quillmesh.functions.folds import folded
from quillmesh.operators import blocks as B
from quillmesh.operators import chunks as C
from quillmesh.operators import sessions as S
from quillmesh.plans.corpus import Corpus


def sources(spark, *texts):
    return spark.createDataFrame([(f"s{i}", "text", t) for i, t in enumerate(texts)], "source_id string, format string, text string")


def turns(spark, text):
    rows = Corpus(sources(spark, text)).turns.orderBy("turn_index").collect()
    return [(r["speaker"]["role"], round(r["speaker"]["confidence"], 2), r["speaker"]["source"]) for r in rows]


@pytest.mark.parametrize(
    "text, want",
    [
        ("User: Please fix the bug.\n\nAssistant: Done.", [("human", 0.98, "explicit_label"), ("ai", 0.98, "explicit_label")]),
        ("Altair: hello there\n\nAnkaa: hi", [("human", 0.9, "explicit_label"), ("ai", 0.9, "explicit_label")]),
        ("message.author.role: user\n\nmessage.author.role: assistant", [("human", 0.95, "metadata_pattern"), ("ai", 0.95, "metadata_pattern")]),
        ("one a\n\ntwo b\n\nthree c\n\nfour d", [("human", 0.55, "session_default"), ("ai", 0.47, "session_default"), ("human", 0.39, "session_default"), ("ai", 0.35, "session_default")]),
        ("only one", [("unknown", 0.0, "unknown")]),
        ("System: x y\n\nTool: a b\n\nUser: c d", [("system", 0.98, "explicit_label"), ("tool", 0.98, "explicit_label"), ("human", 0.98, "explicit_label")]),
        ("User: a b\n\nplain words\n\nUser: c d", [("human", 0.98, "explicit_label"), ("ai", 0.74, "turn_alternation"), ("human", 0.98, "explicit_label")]),
        ("lead in\n\nUser: a b\n\nmore words\n\nand more", [("ai", 0.5, "session_default"), ("human", 0.98, "explicit_label"), ("ai", 0.55, "session_default"), ("human", 0.47, "session_default")]),
    ],
)
def test_turn_fixtures(spark, text, want):
    assert turns(spark, text) == want


def block_types(spark, text):
    return [(r["type"], r["text"], r["start_offset"], r["leading_blank_lines"]) for r in B.blocks(sources(spark, text)).orderBy("block_no").collect()]


def test_blocks(spark):
    text = "# Title\nplain words here\n\n```\na = 1\n\nb = 2\n```\n> cited\nYes, well, maybe\n\"key\": 1\nCHAPTER ONE"
    got = block_types(spark, text)
    assert [g[0] for g in got] == ["section", "paragraph", "code", "quote", "table", "json", "section"]
    assert got[2][1] == "```\na = 1\n\nb = 2\n```" and got[2][3] == 1
    assert all(text[start : start + len(t)] == t for _, t, start, _ in got)


def test_empty_and_null_sources(spark):
    assert B.blocks(sources(spark, "", None, "  \n ")).count() == 0
    assert Corpus(sources(spark, "", None)).chunks.count() == 0


def test_sessions_split_like_a_plain_loop(spark):
    import random

    rng = random.Random(5)
    items = [(rng.randint(50, 3000), rng.choice([0, 20, 35, 49, 65])) for _ in range(200)]
    want, run = [], 0
    for i, (n, score) in enumerate(items):
        s = score + (24 if run > 7600 * 1.05 else 0) + (36 if run > 7600 * 1.3 else 0)
        if i and (run >= 7600 * 1.6 or (s >= 62 and run >= 7600 * 0.42)):
            want.append(i)
            run = 0
        run += n
    df = spark.createDataFrame([(k, i, *x) for k in "ab" for i, x in enumerate(items)], "source_id string, block_no int, n int, score int").repartition(3, "source_id")
    got = folded(df, ("source_id",), ("block_no",), ("n", "score"), "session_no", lambda: S.Cuts(7600)).collect()
    for k in "ab":
        numbers = [r["session_no"] for r in sorted(got, key=lambda r: r["block_no"]) if r["source_id"] == k]
        assert [i for i in range(1, 200) if numbers[i] != numbers[i - 1]] == want
        assert numbers[0] == 1 and numbers[-1] == len(want) + 1


def test_chunk_invariants(spark):
    text = "\n\n".join(f"User: word{i} alpha beta gamma delta epsilon zeta eta theta iota kappa lambda. " * (1 + i % 5) for i in range(40))
    c = Corpus(sources(spark, text))
    rows = c.chunks.orderBy("session_no", "seq_in_session").collect()
    assert rows and all(r["text"] for r in rows)
    for s in {r["session_no"] for r in rows}:
        seqs = [r["seq_in_session"] for r in rows if r["session_no"] == s]
        assert seqs == list(range(1, len(seqs) + 1))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = Corpus(sources(spark, text)).chunks.orderBy("session_no", "seq_in_session").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r["text"] for r in rows] == [r["text"] for r in again]


@pytest.mark.parametrize("text, kind", [("please fix this error", "error"), ("we decide now", "decision"), ("could you look", "request"), ("todo later", "task"), ('he said "x"', "quote"), ("this is it", "fact"), ("thésis", "statement")])
def test_kinds(spark, text, kind):
    assert spark.range(1).select(C.chunk_kind(F.lit(text)).alias("k")).first()["k"] == kind


def test_cues(spark):
    got = [spark.range(1).select(C.is_cue(F.lit(t)).alias("k")).first()["k"] for t in ("next, we", "next,we", "the next step", "However so", "nexts step")]
    assert got == [False, True, True, True, False]


@pytest.mark.parametrize("text, kind, label", [("function foo() {", "code", "foo"), ('{"a": 1, "b": 2}', "json_object", "a b"), ("Chapter 1 intro words", "document_section", "Chapter 1 intro words"), ("alpha | beta", "table", "alpha beta"), ("x", None, None)])
def test_labels(spark, text, kind, label):
    df = spark.createDataFrame([(text, kind)], "t string, k string")
    assert df.select(C.artifact_label(F.col("t"), F.col("k")).alias("l")).first()["l"] == label
