"""One object for documents in, answers out: chunks, embeddings, retrieval and synthesis as one plan."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.functions.models import echo, hash_embedding
from sparkwell.operators import chunking, ingestion, keywords, retrieval, synthesis, tree
from sparkwell.operators.common import numbered
from sparkwell.operators.workflow import Tool
from sparkwell.sources import readers

#: Settings of each index kind: hits, and how answers are made.
DEFAULTS = {
    "vector": (10, "compact"),
    "keyword": (10, "compact"),
    "summary": (None, "tree_summarize"),
    "tree": (None, "tree_summarize"),
    "graph": (2, "compact"),
}


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1024
    chunk_overlap: int = 200
    embed: Callable[[Column], Column] = field(default_factory=hash_embedding)
    model: Callable[[Column], Column] = echo
    call: Callable[[str], str] = field(default=lambda prompt: prompt)


class Engine:
    """Documents (doc_id, text) under an index of some kind; ask() takes queries (query_id, query_str) in batches."""

    def __init__(self, documents: DataFrame, kind: str = "vector", settings: Settings | None = None):
        if kind not in DEFAULTS or kind == "graph":
            raise ValueError(f"no index of kind {kind!r}; graphs have sparkwell.operators.graph")
        self.settings, self.kind = settings or Settings(), kind
        chunks = chunking.sentence_chunks(F.col("text"), self.settings.chunk_size, self.settings.chunk_overlap)
        self.nodes = chunking.nodes(documents, chunks)
        if kind == "vector":
            self.nodes = self.nodes.withColumn("embedding", self.settings.embed(F.col("text")))

    @classmethod
    def of_directory(cls, spark: SparkSession, folder: str, kind: str = "vector", settings: Settings | None = None) -> Engine:
        """An engine over the text files of a folder."""
        return cls(readers.directory(spark, folder).select("doc_id", "text"), kind, settings)

    def _changed(self, nodes: DataFrame) -> Engine:
        other = copy(self)
        other.nodes = nodes
        return other

    def insert(self, documents: DataFrame) -> Engine:
        """The engine with these documents too; documents that it has already are replaced."""
        new = Engine(documents, self.kind, self.settings).nodes
        return self._changed(self.delete(documents).nodes.unionByName(new))

    def delete(self, documents: DataFrame) -> Engine:
        """The engine without these documents (doc_id)."""
        return self._changed(self.nodes.join(documents.select("doc_id").distinct(), "doc_id", "left_anti"))

    def refresh(self, documents: DataFrame, stored: DataFrame) -> tuple[Engine, DataFrame]:
        """The engine with new and changed documents, against their stored hashes (doc_id, hash), and (doc_id, refreshed)."""
        told = ingestion.refresh(documents, stored)
        new = documents.join(told.where("refreshed").select("doc_id"), "doc_id", "left_semi")
        return self.insert(new), told

    def as_tool(self, name: str, description: str, k: int | None = None, answers: bool = True) -> Tool:
        """A tool for reasoning: the answer to one input, or the texts that are retrieved for it."""

        def call(input: str) -> str:
            asked = self.nodes.sparkSession.createDataFrame([(0, input)], "query_id long, query_str string")
            rows = self.ask(asked) if answers else self.chunks(asked, k).orderBy("pos").select("text")
            return "\n".join(r[-1] or "" for r in rows.limit(1 if answers else k or 10).collect())

        return Tool(name, description, call)

    def retrieve(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, node_id, score, ...)."""
        k = k or DEFAULTS[self.kind][0]
        if self.kind == "vector":
            return retrieval.dense_search(self.nodes, queries.withColumn("embedding", self.settings.embed(F.col("query_str"))), k)
        if self.kind == "keyword":
            return keywords.probe(keywords.keyword_table(self.nodes), queries, k)
        return retrieval.everything(self.nodes, queries)

    def chunks(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        hits = self.retrieve(queries, k)
        order = F.col("rank") if "rank" in hits.columns else F.xxhash64("node_id")
        return hits.join(self.nodes.select("node_id", "text", "metadata"), "node_id").select("query_id", order.cast("long").alias("pos"), "node_id", "text", "metadata")

    def ask(self, queries: DataFrame, mode: str | None = None) -> DataFrame:
        """(query_id, response)."""
        chunks = self.chunks(queries).select("query_id", "pos", "text")
        return synthesis.synthesize(mode or DEFAULTS[self.kind][1], chunks, queries, self.settings.model, self.settings.call)

    def tree(self, fan_out: int = 10) -> DataFrame:
        place = F.concat_ws("/", "source_id", F.lpad(F.col("chunk_index").cast("string"), 9, "0"))
        leaves = numbered(self.nodes.select("node_id", "text", place.alias("__place")), "__place")
        return tree.build(leaves.select("node_id", "pos", "text"), fan_out)
