import json

from pyspark.sql import functions as F

from quillmesh.sources import conversations as V
from quillmesh.sources import json_flatten as J
from quillmesh.sources import normalize as N
from quillmesh.sources import readers, sinks


def col(spark, f, *values):
    return [r["y"] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x")).alias("y")).collect()]


def test_lines(spark):
    assert col(spark, N.normalize_lines, "a \t b \r\n\r\n\r\n\n c ", None, "") == ["a b\n\nc", "", ""]


def test_entities_are_decoded_once(spark):
    assert col(spark, N.decode_entities, "a &amp;lt; b &foo; c&nbsp;d") == ["a &lt; b   c d"]
    assert col(spark, N.decode_entities, "&#65;&#x1F600;x&#0;&#xD800;") == ["A\U0001f600x  "]


def test_html(spark):
    page = "<!doctype html><!-- c --><script>var a='<p>';</script><h1>T</h1><p>a<b>b</b> &amp; c<br>d</p><style>x</style><i"
    assert col(spark, N.html_to_text, page) == ["T\n\na b & c\nd"]


def test_roles_and_labels(spark):
    assert col(spark, N.chat_role, "Human", "the assistant", "GPT-4", "", "critic", None) == ["user", "assistant", "assistant", "unknown", "critic", "unknown"]


def test_transcripts_skip_blank_messages(spark):
    rows = spark.createDataFrame([(1, 2, "assistant", "b\n\n c"), (1, 1, "user", " a "), (1, 3, "user", None), (2, 0, "user", "")], "conv_id long, turn long, role string, text string")
    got = {r["source_id"]: r["text"] for r in N.render_transcripts(rows).collect()}
    assert got == {"conv:000001": "# Conversation: Conversation 1\n\nUser: a\n\nAssistant: b\nc", "conv:000002": ""}


def test_flatten():
    assert J.flatten({"b": [1, {"c": None}], "a": "x  y"}) == ["a: x y", "b[0]: 1", "b[1].c: null"]
    assert J.flatten({"": 1, "a-b": [], "t": True}) == ["(empty_key): 1", '["a-b"]: []', "t: true"]
    assert J.flatten_fragment('"role": "user", "content": "hi') == ["role: user", "content: hi"]
    assert J.flatten_fragment('{"a": [1, "x", {"b": false}], "c": 2') == ["a[0]: 1", "a[1]: x", "a[2].b: false", "c: 2"]
    assert J.flatten_fragment("") == []


def test_chat_export_messages_in_order(spark):
    export = '{"messages": [{"role": "user", "content": "late", "create_time": 5}, {"role": "assistant", "content": "early", "create_time": 1}, {"role": "user", "content": "untimed"}]}'
    lines = J.flatten_json(spark.createDataFrame([(1, export)], "id long, j string"), "id", "j")
    got = [(r["role"], r["text"]) for r in J.chat_messages(lines, "id").orderBy("pos").collect()]
    assert got == [("assistant", "early"), ("user", "late"), ("user", "untimed")]


def test_current_chain_ignores_siblings_and_cycles(spark):
    nodes = spark.createDataFrame([(1, "a", None), (1, "b", "a"), (1, "c", "b"), (1, "x", "a"), (2, "p", "q"), (2, "q", "p")], "conversation long, node string, parent string")
    current = spark.createDataFrame([(1, "c"), (2, "p")], "conversation long, node string")
    got = sorted((r["conversation"], r["pos"], r["node"]) for r in J.current_chain(nodes, current).collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "q"), (2, 1, "p")]


def test_files_become_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x  y\n\n\n\nz")
    (tmp_path / "b.html").write_text("<p>hi")
    (tmp_path / "c.json").write_text('{"title": "T", "id": 3}')
    (tmp_path / "d.bin").write_text("no")
    got = sorted((r["format"], r["text"]) for r in readers.normalized(readers.read_files(spark, str(tmp_path))).collect())
    assert got == [("html", "hi"), ("json", "title: T"), ("text", "x y\n\nz")]


def test_parts_and_shards(spark, tmp_path):
    files = spark.createDataFrame([("a", "json", (12 << 20) + 1), ("b", "text", 0)], "source_id string, format string, bytes long")
    got = sorted(tuple(r) for r in readers.part_plan(files).collect())
    assert got == [("a", 1, 0, 12 << 20), ("a", 2, 12 << 20, (12 << 20) + 1), ("b", 1, 0, 0)]
    rows = spark.range(0, 10).repartition(3)
    assert sorted((r["id"], r["shard"]) for r in sinks.sharded(rows, "id", 4).collect()) == [(i, i // 4 + 1) for i in range(10)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.txt").write_text("x")
    sinks.write_archive(str(tmp_path / "in"), str(tmp_path / "1.zip"))
    sinks.write_archive(str(tmp_path / "in"), str(tmp_path / "2.zip"))
    assert (tmp_path / "1.zip").read_bytes() == (tmp_path / "2.zip").read_bytes()


EXPORT = {
    "title": "T",
    "current_node": "c",
    "mapping": {
        "a": {"parent": None, "message": None, "children": ["b"]},
        "b": {"parent": "a", "message": {"author": {"role": "user"}, "content": {"parts": ["hi", "hi ", " x", {"text": "deep"}]}}, "children": ["c", "d"]},
        "c": {"parent": "b", "message": {"author": {"role": "assistant", "name": "Bo"}, "content": "yes", "create_time": 9}},
        "d": {"parent": "b", "message": {"author": {"role": "assistant"}, "content": "no", "create_time": 3}},
    },
}


def test_json_becomes_transcripts_or_lines(spark):
    fragment = '"messages": [{"role":"user","content":"a"},{"role":"assistant","content":"b"}'
    timed = '{"conversation":{"messages":[{"role":"user","content":"a","create_time":5},{"role":"assistant","content":"b","create_time":1}],"title":"Q"}}'
    cases = {
        json.dumps(EXPORT): "# Conversation: T\n\nUser: hi\nx\ndeep\n\nAssistant (Bo): yes",
        json.dumps([{"role": "user", "content": "q"}, {"text": "r"}]): "# Conversation: Conversation 1\n\nUser: q\n\nSpeaker: r",
        json.dumps({"conversations": [{"name": "N", "messages": [{"role": "user", "parts": ["p"]}]}, {"messages": []}, {"topic": "Z", "messages": [{"role": "tool", "text": 4}]}]}): "# Conversation: N\n\nUser: p\n\n# Conversation: Z\n\nTool: 4",
        fragment: "# Conversation: Conversation 1\n\nUser: a\n\nAssistant: b",
        timed: "# Conversation: Q\n\nAssistant: b\n\nUser: a",
        json.dumps({"title": "Only", "id": 3, "x": {"body": "z"}}): "title: Only\nx.body: z",
        "plain  words": "plain words",
        "{}": "",
        "": "",
        None: "",
    }
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)], "id long, raw string, text string")
    got = {r["id"]: r["text"] for r in V.json_texts(rows, "id", "raw").collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert V.json_texts(rows.limit(0), "id", "raw").count() == 0


def test_mappings_without_a_current_node_go_by_time_or_depth():
    nodes = EXPORT["mapping"]
    assert V.node_order(nodes, "c") == ["b", "c"] and V.node_order(nodes, "gone") == ["d", "c", "a", "b"]
    untimed = {k: {**v, "message": None} for k, v in nodes.items()}
    assert V.node_order(untimed, None) == ["a", "b", "c", "d"]
    loop = {"p": {"parent": "q", "children": ["q"]}, "q": {"parent": "p", "children": ["p"]}}
    assert V.node_order(loop, "p") == ["p", "q"]
    assert V.to_time("2024-01-02T00:00:00Z") == 1704153600000 and V.to_time("7") == 7 and V.to_time("soon") is None and V.to_time(True) is None


def test_compact_paths(spark):
    paths = {"$.title": "title", "$[0].title": "title", "a.mapping.x.message.author.role": "message.author.role", "messages[3].content.parts[0]": "message.content", "a.b.c.body": "b.c.body", "id": "", "conversations[2].name": ""}
    assert col(spark, J.compact_path, *paths) == list(paths.values())
    assert col(spark, J.title_path, "title", "a.b.title", "$[1].name", "x.message.title", "messages[0].name") == ["$", "a.b", "$[1]", None, None]
