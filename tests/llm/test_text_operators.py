"""Chat formatting, personal data, rules, packing and page extraction against plain definitions."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.llm import chat_format as C
from quillmesh.llm import html_diff as H
from quillmesh.llm import packing as K
from quillmesh.llm import pii_bootstrap as P
from quillmesh.llm import rule_ledger as R
from quillmesh.llm.queries import op1_chat_format, tokenizer_path

SMALLEST = "/root/testdata/sf0.001"

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, size string, rate string, failed string"


def docs(spark, texts, schema="doc_id long, text string, source string"):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], schema)


# ---------------------------------------------------------------- chat formatting

pieces = st.lists(st.sampled_from([*C.CONTROLS, C.ESCAPE, C.ESCAPE + "1", "n", "0", "[", "<", "\n", "x", "é"]), max_size=12).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys\ntem", "<s>", ""]), pieces), max_size=5))
def test_chat_round_trip(turns):
    formatted, spans = C.render(turns)
    assert C.parse(formatted) == turns
    assert [C.unescape(formatted[s:e]) for s, e in spans] == [t for r, t in turns if r == "assistant"]
    assert formatted.count(C.OPEN) == formatted.count(C.CLOSE) == len(turns)
    assert not any(c in formatted.replace(C.OPEN, "").replace(C.CLOSE, "") for c in C.CONTROLS)


@pytest.mark.parametrize(
    "record, layout, turns",
    [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "id": 3}, "messages", [("user", "a"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, "conversations", [("user", "q"), ("assistant", "r")]),
        ({"instruction": "do", "input": "it", "output": "done"}, "instruction", [("user", "do\n\nit"), ("assistant", "done")]),
        ({"prompt": "p", "response": "r", "extra": {"prompt": 1}}, "prompt_response", [("user", "p"), ("assistant", "r")]),
        ({"question": "q", "answer": 4}, "question_answer", [("user", "q"), ("assistant", "4")]),
        ({"messages": [{"role": "user", "content": "a"}], "system": "s"}, "messages", [("system", "s"), ("user", "a")]),
        ({"messages": [{"role": "user", "content": "a"}, "loose"], "prompt": "p", "input": "i"}, "messages", [("user", "a"), ("", "loose")]),
        ({"conversations": [{"from": "human", "value": "q"}], "system": "s"}, "conversations", [("system", "s"), ("user", "q")]),
        ({"instruction": "do", "input": "it", "output": "done", "prompt": "p"}, "instruction", [("user", "do\n\nit"), ("assistant", "done")]),
        ({"prompt": "p", "response": "r", "completion": "c"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
        ({"prompt": "p", "completion": "c", "meta": {"x": [1]}}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"messages": []}, "messages", []),
        ({"other": 1}, "unknown", []),
        (None, "unknown", []),
        ([1], "unknown", []),
    ],
)
def test_layouts(record, layout, turns):
    assert C.canonical(record) == (layout, turns)


def test_chat_tables(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, "user", "hi"), (1, 0, None, "hi"), (2, None, "user", ""), (None, 0, "user", "x" * 100_000)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in C.read_back(C.format_records(C.records_of_turns(rows))).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest([("", "hi"), ("user", "hi"), ("assistant", "")]) and got[1]["loss_chars"] == 0
    assert got[2]["n_turns"] == 1 and got[None]["n_turns"] == 1
    assert C.read_back(C.format_records(C.records_of_turns(rows.limit(0)))).count() == 0
    bad = spark.createDataFrame([(1, "{no json"), (2, None)], "conv_id long, record string")
    assert {(r["layout"], r["unknown"]) for r in C.format_records(bad).collect()} == {("unknown", "{no json"), ("unknown", None)}
    clash = rows.withColumn("record", F.lit("x")).withColumn("layout", F.lit("y")).withColumn("messages", F.lit(3))
    assert sorted(map(repr, C.read_back(C.format_records(C.records_of_turns(clash))).collect())) == sorted(map(repr, got.values()))


def test_the_chat_query_equals_brute_force(spark):
    data = spark.read.parquet(f"{SMALLEST}/conversations.parquet").collect()
    ok = "</s>[INST] ok [/INST]"
    turns = defaultdict(list)
    for r in data:
        turns[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    turns[-7] = [(0, "user", ok), (1, "assistant", ok)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for k, v in turns.items():
        v.sort()
        loss = "".join(t for _, r, t in v if r == "assistant")
        want[k] = (len(v), sha("".join(f"{r}\n{t}\n" for _, r, t in v)), len(loss), sha(loss))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in op1_chat_format(spark, SMALLEST).collect()}
    assert got == want


# ---------------------------------------------------------------- personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return [(s, kind, e) for s, _, kind, e in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "@", ".", "x.y", "-", " ", "+", "1", "4242", "255", "256", "(", ")", "%", "é", "\n", "4111111111111111", "10.0.0.1", "+1 (555) 010-2233"]), max_size=24).map("".join))
def test_base_spans_equal_the_plain_patterns(text):
    assert P.base_spans(text) == plain_spans(text)


def test_contexts_find_what_no_base_pattern_knows(spark):
    rng = random.Random(3)
    filler = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(12))
    texts = [f"{filler()} member number {4000 + i}0000{i % 7}ab{rng.getrandbits(128):032x} was {filler()}" for i in range(30)]
    texts += [f"{filler()} member number K-77{i} was {filler()}" for i in range(3)] + [f"{filler()} room 1234 {filler()}", "", None]
    table = docs(spark, texts)
    table = table.withColumn("spans", F.lit(1)).withColumn("pattern", F.lit("x")).withColumn("digest", F.lit("y"))
    patterns = P.learn(table)
    assert patterns.get("member number _") == "secret"
    got = {r["doc_id"]: r for r in P.find(table, patterns).collect()}
    assert all("secret:" in got[i]["spans"] for i in range(33))
    assert got[33]["spans"] == got[34]["spans"] == got[35]["spans"] == ""
    assert got[35]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    masked = {r["doc_id"]: r["text"] for r in P.redacted(table, patterns).collect()}
    assert "K-770" not in masked[30] and "<SECRET>" in masked[30] and masked[35] is None and masked[33] == texts[33]
    assert P.learn(table.limit(0)) == {} and P.find(table.limit(0), {}).count() == 0


def test_parts_of_an_address_may_have_any_number_of_zeros():
    zeros = "0" * 30
    assert P.span_list(P.base_spans(f"1.2.3.{zeros}4 and 1.2.3.{zeros}256 and 0.0.0.{zeros}")) == f"ip:0:{len(zeros) + 7},ip:{len(f'1.2.3.{zeros}4 and 1.2.3.{zeros}256 and ')}:{len(f'1.2.3.{zeros}4 and 1.2.3.{zeros}256 and 0.0.0.{zeros}')}"


def test_names_and_handles_in_confident_contexts_are_found(spark):
    texts = [f"please write dear friend user{i}@mail.example.org soon" for i in range(20)] + ["please write dear friend annette soon", "hello dear friend (ann_lee), bye", "a friend annette soon"]
    texts += [f"go and see user{i}@mail.example.org now" for i in range(20)] + [f"go and see the{c} now" for c in "abcdefgh" * 3]
    table = docs(spark, texts)
    patterns = P.learn(table)
    assert patterns["dear friend _"] == "email" and "and see _" not in patterns
    got = {r["doc_id"]: r["spans"] for r in P.find(table, patterns).collect()}
    at = texts[20].index("annette")
    assert got[20] == f"email:{at}:{at + 7}" and got[21] == "email:19:26" and got[45] == ""


def plain_patterns(edges, confidence=0.8, least=3):
    """The scoring by dictionaries, to its fixed point."""
    n, whole = defaultdict(float), defaultdict(float)
    certain = {(i, k) for _, i, k, _ in edges if k}
    for p, i, _, c in edges:
        n[p, i] += c
        whole[p] += c
    score, kept = {x: 1.0 for x in certain}, None
    while True:
        hits = defaultdict(list)
        for (p, i), c in n.items():
            for (j, k), v in score.items():
                if j == i:
                    hits[p, k].append(c * v)
        now = {pk: sum(v) / (whole[pk[0]] + 1) for pk, v in hits.items() if sum(v) >= least and len(v) >= least and sum(v) / (whole[pk[0]] + 1) >= confidence}
        if kept is not None and set(now) == set(kept):
            return {p: max((c, k) for (q, k), c in now.items() if q == p)[1] for p, _ in now}
        kept, miss = now, defaultdict(lambda: 1.0)
        for (p, i) in n:
            for (q, k), c in now.items():
                if q == p:
                    miss[i, k] *= 1 - min(c, 0.999)
        score = {x: 1.0 for x in certain} | {x: 1 - m for x, m in miss.items() if x not in certain}


def test_pattern_scores_equal_the_plain_ones(spark):
    rng = random.Random(9)
    edges = [(f"p{rng.randint(0, 12)}", f"i{rng.randint(0, 40)}", rng.choice(["email", "email", "email", "phone", None]), rng.randint(1, 6)) for _ in range(260)]
    edges += [("clear", f"c{i}", "phone", 2) for i in range(9)] + [("next", f"c{i}", None, 3) for i in range(9)] + [("clear", "new", None, 1)] + [("last", x, None, 5) for x in ("new", "c1", "c2", "c3")]
    frame = spark.createDataFrame(edges, "pattern string, instance string, kind string, n long")
    want = plain_patterns(edges)
    assert P.accepted_patterns(frame) == want and want["last"] == "phone"


def test_long_texts_take_linear_time():
    import time

    text = "call +1 (555) 010-2233 or 10.0.0.1 about 12 x" * 20_000 + "y" * 300_000
    began = time.perf_counter()
    assert sum(1 for _ in P.occurrences(text)) > 40_000
    assert time.perf_counter() - began < 20


def test_rare_contexts_stay_beside_many_other_seeds(spark):
    rare = [("member number _", f"k{i}", "secret", 1) for i in range(40)]
    hot = [("write to _", f"m{i}", "email", 1000) for i in range(400)]
    edges = spark.createDataFrame(rare + hot, "pattern string, instance string, kind string, n long")
    want = {"member number _": "secret", "write to _": "email"}
    assert P.accepted_patterns(edges) == want
    assert {r["pattern"]: r["kind"] for r in P.accepted_patterns(edges, max_sent=1).collect()} == want


def test_a_table_of_patterns_gives_what_a_dictionary_gives(spark):
    texts = [None, "", "no digits", *[f"his member number K-77{i % 3} was here and room 1234 too" for i in range(9)], "call me at 12345 today", "x member number A123,"]
    rows = [(i if i % 4 else None, t, "s") for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = {"member number _": "secret", "at _ today": "phone"}
    many = spark.createDataFrame(list(few.items()), "pattern string, kind string")
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(P.find(table, few)) == plain(P.find(table, many)) and plain(P.redacted(table, few)) == plain(P.redacted(table, many))
    assert P.redacted(table, many).columns == table.columns and any("<SECRET>" in (r["text"] or "") for r in P.redacted(table, many).collect())


def test_mask_of_overlapping_spans():
    assert P.mask("abcdef", [(1, "email", 3), (2, "ip", 5)]) == "a<EMAIL>f"


# ---------------------------------------------------------------- quality rules


def plain_measures(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(lines), t.count("!")


def test_ledger_equals_plain_measures(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x " * 400, "é!\x0b| #\n" * 5, "q" * 50_000]
    texts += ["".join(rng.choice(["a", "b", "cc", " ", " ", "\n", "\t", "|", "!"]) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, "x", None, 1, "s", "r", "f") for i, t in enumerate(texts)], CLASHING)
    got = {r["doc_id"]: r for r in R.ledger(rows).collect()}
    for i, t in enumerate(texts):
        want = plain_measures(t)
        assert tuple(got[i]["measures"][m] for m in R.MEASURES) == want, repr(t)[:80]
        few, many = want[0] < 50, 100 * want[4] > 50 * want[0]
        assert (got[i]["failed"] & R.policy_mask("v1")) == few + 2 * many
    assert R.ledger(rows.limit(0)).count() == 0


def test_ablations_equal_recounting(spark):
    rng = random.Random(2)
    failed = [rng.randrange(64) for _ in range(300)]
    got = {(r["policy"], r["rule"]): (r["rejected"], r["by_rule"], r["only_by_rule"]) for r in R.ablations(spark.createDataFrame([(f,) for f in failed], "failed long")).collect()}
    bits = {r.name: 1 << r.bit for r in R.RULES}
    for policy, names in R.POLICIES.items():
        mask = R.policy_mask(policy)
        for n in names:
            want = (sum(bool(f & mask) for f in failed), sum(bool(f & bits[n]) for f in failed), sum((f & mask) == bits[n] for f in failed))
            assert got[policy, n] == want


# ---------------------------------------------------------------- packing


def test_pieces_tile_documents_and_sequences(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    vocab = ["hello", "World,", "it's", "naïve", "x" * 30, "日本", "don't!!", "a b", "q\x1cr", "1234", "(x)", "ÉCOLE."]
    texts = [None, "", " "] + [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 5, 60, 900, 9000]))) for _ in range(60)]
    table = docs(spark, texts).repartition(3)
    table = table.withColumn("length", F.lit("x")).withColumn("offset", F.lit(-1)).withColumn("ids", F.lit(2))
    rows = [r.asDict() for r in K.pack(table, tokenizer_path(), group_tokens=30_000).collect()]
    tok = Tokenizer.from_file(tokenizer_path())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert zlib.crc32(ids[r["start"] : at].tobytes()) == r["ids_crc32"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at & (at - 1) == 0 and at <= 4096
    assert K.pack(table.limit(0), tokenizer_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=40))
def test_assign_keeps_every_token(lengths):
    out = K.assign(lengths, budget=1024)
    for d, n in enumerate(lengths):
        own = sorted((s, k) for e, s, k, _, _ in out if e == d)
        assert sum(k for _, k in own) == n and all(a + k == b for (a, k), (b, _) in zip(own, own[1:], strict=False))


# ---------------------------------------------------------------- pages


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=14), st.lists(st.sampled_from("abcde"), max_size=14))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    found = sorted(H.common_lines(a, b))
    assert len(found) == plain_lcs(a, b)
    rest = iter(b)
    assert all(any(a[i] == y for y in rest) for i in found)


PAGE = '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href="/x">Menu</a></nav><!-- ad --><div class="ad">Buy</div><article><h1>Head</h1><p><b>One &amp; two.<br><p>Three\n  four</p></article><section id="comments"><p>nice</p></section><footer>F</footer>'


def test_article_text():
    page = H.Page("h", "/a", H.lines_of(PAGE))
    assert H.main_text(page, []) == "Head One & two. Three four"
    assert H.main_text(page, [page]) == "Head One & two. Three four"
    assert H.lines_of("") == [] and H.lines_of("<p") == []
    assert [x.text for x in H.lines_of("a &lt;b&gt; x<i>y</i><p>z")] == ["a <b> xy", "z"]


def test_shared_lines_go_where_no_article_is_marked(spark):
    body = "<html><body><div>Site name</div><div>About us</div><p>{}</p><div>All rights</div></body></html>"
    rows = [(1, "http://h.org/a/1", body.format("First text.")), (2, "http://h.org/a/2", body.format("Second text.")), (3, None, None), (4, "nonsense", "<p>Alone</p>"), (5, "http://g.org/", PAGE), (5, "http://g.org/", PAGE)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in H.extract(table).collect()]
    assert sorted(got) == [(1, "First text.", 11), (2, "Second text.", 12), (3, "", 0), (4, "Alone", 5), (5, "Head One & two. Three four", 26), (5, "Head One & two. Three four", 26)]
    assert H.extract(table.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html, want",
    [
        ("<main class='has-sidebar'><article><p>Text</p></article></main>", "Text"),
        ("<main class='sidebar'><p>Text</p></main>", "Text"),
        ("<body class='menu'><p>Text</p></body>", "Text"),
        ("<article class='post comments-open'><p>Text</p></article>", "Text"),
        ("<div class='with-sidebar'><p>Text</p></div>", "Text"),
        ("<article><div class='article-header'><h1>Head</h1></div><p class='related'>Text</p><h2 class='section-header'>More</h2></article>", "Head Text More"),
        ("<article><p>Text</p><div class='big ad'>Buy</div><div id='comments'><article class='comment'>nice</article></div></article>", "Text"),
        ("<div class='site-header'>Name</div><div class='cookie-banner'>Agree</div><div role='search'>Find</div><p>Text</p><div class='ad-slot'>Buy</div>", "Text"),
        ("<article><div class='entry-header'><h1>Head</h1></div><p class='search-notices'>Text</p><p class='ad'>More</p></article>", "Head Text More"),
        ("<div>Intro</div><article><p>Text</p></article>", "Intro Text"),
        ("<p>a<![CDATA[ b", "a b"),
        ("<article><p>Text</p></article><section class='comments'><article class='comment'>nice</article></section>", "Text"),
    ],
)
def test_wrappers_named_after_what_they_hold_are_kept(html, want):
    assert H.main_text(H.Page("h", "/a", H.lines_of(html)), []) == want


def test_mirrors_are_paired_with_the_next_different_page(spark):
    body = "<body><div>Site name</div><p>{}</p><div>All rights</div></body>"
    long = " ".join(f"word{i}" for i in range(60))
    near = body.format(f"{long}</p><p>seen 7")
    pages = [("http://m.org/a?x=1", body.format("Mirror text.")), ("http://m.org/a?x=2", body.format("Mirror text.")), ("http://n.org/a?x=1", body.format("Copy text.")), ("http://n.org/a?x=2", body.format("Copy text.")), ("http://n.org/b", body.format("Other text."))]
    pages += [("http://q.org/a?x=1", near), ("http://q.org/a?x=2", near.replace("seen 7", "seen 8"))]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r["page_id"]: r["text"] for r in H.extract(table).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == "Site name Mirror text. All rights"
    assert got[2] == got[3] == "Copy text." and got[4] == "Other text."
    assert long in got[5] and long in got[6]


def test_long_alignments_are_halved(monkeypatch):
    monkeypatch.setattr(H, "_CELLS", 40)
    import random

    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 60))] for _ in range(2))
        found = sorted(H.common_lines(a, b))
        assert len(found) == plain_lcs(a, b)
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in found)


def test_deep_pages_are_read_in_one_pass():
    n = 30_000
    assert [x.text for x in H.lines_of("<div>" * n + "</b>" * n + "deep" + "</div>" * n + "<p>end")] == ["deep", "end"]


def site_pages(n):
    """Pages whose boilerplate carries no telling names: only other pages of the host give it away."""
    import random

    rng = random.Random(1)
    out = []
    for i in range(n):
        host = f"h{rng.randint(0, 4)}.org"
        top, end = rng.choice(["Alpha site", "Beta site"]), f"Made by {host}"
        out.append((i, f"http://{host}/{rng.choice('abc')}/{rng.randint(0, 40)}?v={i}", f"<body><div class='x1'>{top}</div><div><span>own words {i}</span></div><p>text of page {i} {rng.random()}</p><div class='x2'>{end}</div></body>"))
    return out


@pytest.mark.parametrize("partitions, block", [(1, 128), (5, 16), (3, 20)])
def test_every_page_meets_its_nearest_pages_however_they_are_dealt(spark, partitions, block):
    data = [*site_pages(150), (7, "http://h1.org/a/7", None), (None, "http://h1.org/a/7", "<p>no id</p>"), (None, None, "<p>no url</p>")]
    near = 3
    pages = sorted((((*H.host_and_path(u), k is None, k or 0), k, u, H.Page(*H.host_and_path(u), H.lines_of(h or ""))) for k, u, h in data), key=lambda x: x[0])
    want = sorted((str(k), str(u), H.main_text(p, [x[3] for x in [*pages[max(0, i - near) : i], *pages[i + 1 : i + 1 + near]]])) for i, (_, k, u, p) in enumerate(pages))
    table = spark.createDataFrame([(*d, "other") for d in data], "page_id long, url string, html string, host string").repartition(partitions)
    got = sorted((str(r["page_id"]), str(r["url"]), r["text"]) for r in H.extract(table, near=near, block_pages=block).collect())
    assert got == want


def test_differencing_decides_on_pages_without_telling_names(spark):
    data = site_pages(150)
    table = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(table).collect()}
    alone = {k: H.main_text(H.Page(*H.host_and_path(u), H.lines_of(h)), []) for k, u, h in data}
    assert sum(got[k] != alone[k] for k in got) >= 145
    assert all(f"text of page {k} " in t and f"own words {k}" in t for k, t in got.items())
    assert sum("site" in t or "Made by" in t for t in got.values()) <= 5


def test_records_are_json(spark):
    row = C.records_of_turns(spark.createDataFrame([(1, 0, "user", 'a" ')], "conv_id long, turn long, role string, text string")).first()
    assert json.loads(row["record"]) == {"messages": [{"role": "user", "content": 'a" '}]}
