import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.functions.constants import STOP_WORDS
from quillmesh.functions.hashing import hash_texts
from quillmesh.functions.numbering import numbered


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value, want", [("  a \t b c ", "a b c"), (None, ""), ("", "")])
def test_normalize_space(spark, value, want):
    assert one(spark, T.normalize_space, value) == want


def test_tokens_match_a_plain_definition(spark):
    texts = ["The quick-brown fox's 2nd den", "", None, "a b cd", "Élan été x1_y", "it is not ours"]
    got = [r["y"] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(T.content_tokens(F.col("x")).alias("y")).collect()]
    want = [[w for w in re.findall(r"[a-z0-9][a-z0-9_\-']*", (t or "").lower()) if len(w) > 1 and w not in STOP_WORDS] for t in texts]
    assert got == want


def test_sentences_keep_offsets_and_drop_unmarked_lines(spark):
    got = one(spark, T.sentences, "abc line\ndef. Two words! tail")
    assert [(s["text"], s["start"]) for s in got] == [("def.", 9), ("Two words!", 14), ("tail", 25)]
    assert [s["text"] for s in one(spark, T.sentences, "...")] == ["..."]
    assert one(spark, T.sentences, None) == []


def test_jaccard_of_empty_sets(spark):
    row = spark.range(1).select(T.jaccard(F.array(), F.array()).alias("a"), T.jaccard(F.array(F.lit("x")), F.array().cast("array<string>")).alias("b"), T.jaccard(F.array(), F.array(), 0.0).alias("c")).first()
    assert tuple(row) == (1.0, 0.0, 0.0)


def test_ids_titles_and_durations(spark):
    row = spark.range(1).select(T.make_id("chunk", F.lit(1)).alias("a"), T.make_id("chunk", F.lit(1234567)).alias("b"), T.safe_title(F.lit("\n " + "x" * 95), F.lit("none")).alias("c"), T.safe_title(F.lit(" \n"), F.lit("none")).alias("d"), T.estimated_duration_ms(F.lit(17000), F.lit(1), F.lit(2)).alias("e")).first()
    assert row["a"] == "chunk_000001" and row["b"] == "chunk_1234567" and row["c"] == "x" * 87 + "..." and row["d"] == "none" and row["e"] == 489


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=8))
def test_hash_equals_one_at_a_time(texts):
    def slow(t):
        units = [int.from_bytes(t.encode("utf-16-le")[i : i + 2], "little") for i in range(0, 2 * len(t.encode("utf-16-le")) // 2, 2)]
        m = 0xFFFFFFFF
        a, b = 0xDEADBEEF ^ len(units), 0x41C6CE57 ^ len(units)
        for u in units:
            a, b = ((a ^ u) * 2654435761) & m, ((b ^ u) * 1597334677) & m
        a = (((a ^ (a >> 16)) * 2246822507) & m) ^ (((b ^ (b >> 13)) * 3266489909) & m)
        b = (((b ^ (b >> 16)) * 2246822507) & m) ^ (((a ^ (a >> 13)) * 3266489909) & m)
        return f"{b:08x}{a:08x}"

    assert hash_texts(texts) == [slow(t) for t in texts]


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("n", [0, 1, 100_000])
def test_numbers_are_dense_and_lose_no_row(spark, adaptive, n):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = spark.range(n).select((F.col("id") * 7919 % 100_003).alias("k"), F.repeat(F.lit("wide "), 30).alias("text"))
        got = numbered(rows, "number", "k")
        assert sorted(got.columns) == ["k", "number", "text"]
        r = got.agg(F.count("*").alias("n"), F.countDistinct("number").alias("d"), F.coalesce(F.max("number"), F.lit(0)).alias("m")).first()
        assert (r["n"], r["d"], r["m"]) == (n, n, n)
        order = got.select("k", (F.lag("k").over(Window.orderBy("number"))).alias("p"))
        assert order.where("p > k").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_long_lines_without_marks_are_read_once():
    line = "word " * 100_000
    assert T.sentences_of(line + "\nend.") == [("end.", len(line) + 1, len(line) + 5)]
