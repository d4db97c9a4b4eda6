from pyspark.sql import functions as F

from quillmesh.operators import graph, indexes, obsessions, symbols, textpack
from quillmesh.plans.corpus import Corpus
from quillmesh.streaming.ingest import ingest, phrase_totals


def corpus(spark):
    talk = "\n\n".join(f"{'User' if i % 2 == 0 else 'Assistant'}: the solar panel array needs a battery bank {'and "grid tie inverter" work' if i % 3 == 0 else ''} as discussed. Round {i} is done." for i in range(24))
    rows = [(f"s{i}", "text", talk.replace("Round", f"Lap{i}")) for i in range(3)] + [("s9", "text", None)]
    return Corpus(spark.createDataFrame(rows, "source_id string, format string, text string"))


def test_edges_are_unique_and_bounded(spark, tmp_path):
    c = corpus(spark).stored(str(tmp_path))
    e = c.edges.cache()
    assert e.count() == e.select("src", "dst", "type").distinct().count() > 0
    assert e.where("weight < 0 or weight > 1").count() == 0
    kinds = {r["type"] for r in e.select("type").distinct().collect()}
    assert {"primary_topic_of", "adjacent_to", "references", "often_cooccurs_with"} <= kinds
    assert indexes.retrieve("solar", c.concepts, e, c.links, c.chunks).count() > 0
    chosen = c.obsessions.collect()
    assert 0 < len(chosen) <= obsessions.MAX_OBSESSIONS
    members = symbols.clusters(spark, c.concepts, e)
    assert members.count() == c.concepts.count() == members.select("concept_id").distinct().count()


def test_textpack_round_trip_with_deltas(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    texts = [base, base.replace("iota", "IOTA"), base, base + " tail", "", "short", base.replace("alpha", "omega"), "x\\Ey $1 (.*)"]
    rows = spark.createDataFrame([(f"c{i}", "s", i, t) for i, t in enumerate(texts)], "chunk_id string, session_id string, seq_in_session int, text string")
    bundle = textpack.encode(rows, "session_id", "seq_in_session")
    assert textpack.validate(bundle, rows).count() == 0
    assert bundle["records"].where("base_record is not null").count() > 0
    assert bundle["records"].count() == len(set(texts))
    assert textpack.common_suffix("abcabc", "abc", 3) == 0


def test_textpack_chains_of_edits_come_back_however_they_are_dealt(spark, monkeypatch):
    words = [f"w{i:03d}" for i in range(40)]
    texts = [" ".join([*words[: 30 + i % 9], f"edit{i}", *words[20:]]) for i in range(150)]
    rows = spark.createDataFrame([(f"c{i:03d}", "s", i, t) for i, t in enumerate(texts)], "chunk_id string, session_id string, seq_in_session int, text string")
    monkeypatch.setattr(textpack, "EPOCH", 40)
    kept = []
    for parts in (1, 5):
        bundle = textpack.encode(rows.repartition(parts), "session_id", "seq_in_session")
        assert textpack.validate(bundle, rows).count() == 0
        kept.append(sorted((r["record"], r["base_record"]) for r in bundle["records"].collect()))
    assert kept[0] == kept[1] and sum(b is not None for _, b in kept[0]) > 100
    assert all(b is None or (n - 1) // 40 == (b - 1) // 40 for n, b in kept[0])


def test_degrees_count_both_ends(spark):
    e = spark.createDataFrame([("concept_1", "concept_2", "related_to", 0.5), ("concept_1", "x/chunk_1", "mentioned_in", 0.5)], "src string, dst string, type string, weight double")
    concepts = spark.createDataFrame([("concept_1", "a"), ("concept_2", "b"), ("concept_3", "c")], "concept_id string, label string")
    got = {r["concept_id"]: (r["degree_total"], r["chunk_degree"], r["concept_degree"]) for r in graph.degrees(e, concepts).collect()}
    assert got == {"concept_1": (2, 1, 1), "concept_2": (1, 0, 1), "concept_3": (0, 0, 0)}


def test_evenly_spaced_rows(spark):
    rows = spark.range(10)
    got = sorted(r["id"] for r in textpack.evenly_spaced(rows, 4, "id").collect())
    assert got == [i * 10 // 4 for i in range(4)]
    assert textpack.evenly_spaced(rows, 20, "id").count() == 10


def test_streaming_ingest_adds_up(spark, tmp_path):
    folder = tmp_path / "in"
    rows = spark.createDataFrame([("a", "text", "solar panel array works well today."), ("b", "text", "solar panel array again.")], "source_id string, format string, text string")
    rows.repartition(2).write.parquet(str(folder))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = ingest(stream, str(tmp_path / "out"))
    q.awaitTermination(120)
    assert phrase_totals(spark, str(tmp_path / "out")).where(F.col("surface") == "solar panel").first()["chunk_mentions"] == 2
