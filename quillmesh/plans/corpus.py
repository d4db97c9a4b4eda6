"""The corpus build: sources to blocks, sessions, chunks, concepts, graph and indexes.

Each attribute is a DataFrame made from the ones before it. What several others read (blocks in
sessions, phrases, concepts and links) is written once into the shared folder when first asked
for; ``stored`` also writes the chunks and continues from what was written.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.tables import materialize
from ..operators import artifacts, concepts, graph, indexes, obsessions, symbols, textpack
from ..operators import blocks as block_ops
from ..operators import chunks as chunk_ops
from ..operators import sessions as session_ops
from ..operators import speaker as speaker_ops
from ..settings import Settings


class Corpus:
    def __init__(self, sources: DataFrame, settings: Settings = Settings()):
        self.sources, self.settings, self.spark = sources, settings, sources.sparkSession
        self._chunks: DataFrame | None = None

    @cached_property
    def blocks(self) -> DataFrame:
        return block_ops.blocks(self.sources)

    @cached_property
    def session_blocks(self) -> DataFrame:
        """Written once: turns, annotated blocks, chunks and session texts all read the parse."""
        return materialize(speaker_ops.with_turns(session_ops.with_sessions(self.blocks, self.settings.session_size)), "session-blocks")

    @cached_property
    def turns(self) -> DataFrame:
        return speaker_ops.inferred_turns(speaker_ops.turns(self.session_blocks))

    @cached_property
    def annotated(self) -> DataFrame:
        return speaker_ops.annotated_blocks(self.session_blocks, self.turns)

    @cached_property
    def chunks(self) -> DataFrame:
        return self._chunks if self._chunks is not None else chunk_ops.chunks(chunk_ops.units(self.annotated, self.settings.session_size), self.settings.session_size)

    @cached_property
    def sessions(self) -> DataFrame:
        texts = session_ops.session_texts(self.session_blocks)
        rows = indexes.session_index(texts, self.chunks, speaker_ops.session_rollup(self.turns))
        return rows.withColumn("session_id", F.concat_ws("/", "source_id", F.format_string("sess_%06d", "session_no")))

    @cached_property
    def candidates(self) -> DataFrame:
        return materialize(concepts.candidates(self.chunks), "candidates")

    @cached_property
    def concepts(self) -> DataFrame:
        return materialize(concepts.concept_table(self.candidates, self.chunks.agg(F.count("*").alias("n")), self.settings.concept_level), "concepts")

    @cached_property
    def links(self) -> DataFrame:
        return materialize(concepts.chunk_concepts(self.candidates, self.concepts), "links")

    @cached_property
    def versions(self) -> DataFrame:
        return versions(self.chunks)

    @cached_property
    def edges(self) -> DataFrame:
        sessions = self.chunks.select("source_id", "session_no", "session_id").distinct().join(indexes.session_concepts(self.links), "session_id", "left").withColumn("concept_ids", F.coalesce("concept_ids", F.array().cast("array<string>")))
        return graph.unique_edges(graph.topic_edges(self.links), graph.artifact_mentions(self.links, self.versions), graph.sequence_edges(self.chunks), graph.session_edges(sessions), graph.artifact_edges(self.versions), graph.cooccurrence_edges(self.links), graph.label_edges(self.concepts))

    @cached_property
    def symbol_members(self) -> DataFrame:
        return symbols.clusters(self.spark, self.concepts, self.edges)

    @cached_property
    def streams(self) -> DataFrame:
        return symbols.streams(self.chunks, self.links, self.symbol_members)

    @cached_property
    def obsessions(self) -> DataFrame:
        return obsessions.obsessions(obsessions.concept_meta(self.concepts, self.links))

    @cached_property
    def textpack(self) -> dict[str, DataFrame]:
        return textpack.encode(self.chunks, "session_id", "seq_in_session", delta=self.settings.enable_delta)

    def stored(self, folder: str) -> Corpus:
        """The same corpus, with its chunks written to a folder and read from there."""
        self.chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
        out = Corpus(self.sources, self.settings)
        out._chunks = self.spark.read.parquet(f"{folder}/chunks")
        return out

    def write(self, folder: str) -> None:
        """All tables as Parquet."""
        from ..sources.sinks import write_tables

        tables = {"chunks": self.chunks, "sessions": self.sessions, "concepts": self.concepts, "links": self.links, "edges": self.edges, "obsessions": self.obsessions, "keyword_index": indexes.keyword_index(self.concepts)}
        if self.settings.include_symbolic:
            tables |= {"symbols": symbols.symbol_library(self.symbol_members, self.concepts), "streams": self.streams}
        write_tables(tables | {f"textpack_{k}": v for k, v in self.textpack.items()}, folder, "overwrite")


def versions(chunks: DataFrame) -> DataFrame:
    """Artifact versions with global ids of artifacts and versions."""
    rows = artifacts.artifact_versions(chunks.withColumn("ord", F.col("session_id")))
    firsts = numbered(rows.where("version_index = 1").select("artifact_key", F.col("ord").alias("o"), F.col("chunk_id").alias("c")), "n", "o", "c")
    ids = firsts.select("artifact_key", F.format_string("artifact_%06d", "n").alias("artifact_id"))
    named = rows.join(ids, "artifact_key").withColumn("version_id", F.concat_ws("/", "artifact_id", F.format_string("version_%06d", "version_index")))
    return named.withColumn("previous_version_id", F.when(F.col("version_index") > 1, F.concat_ws("/", "artifact_id", F.format_string("version_%06d", F.col("version_index") - 1))))
