"""Command line: `python -m sparkwell ingest FOLDER STORE` and `python -m sparkwell search STORE QUESTION [-k N]`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkwell.operators import chunking, keywords
from sparkwell.operators.stores import DocumentStore
from sparkwell.sources import readers


def ingest(spark: SparkSession, folder: str, store: str, size: int = 1024, overlap: int = 200) -> int:
    """Chunks of the folder's text files, put into a store; how many nodes it then has."""
    docs = readers.directory(spark, folder).select("doc_id", "text")
    nodes = chunking.nodes(docs, chunking.sentence_chunks(F.col("text"), size, overlap))
    held = DocumentStore(spark, store)
    held.add(nodes.select("node_id", "text", "metadata", "source_id", F.col("node_hash").alias("hash")))
    return held.read().count()


def search(spark: SparkSession, store: str, question: str, k: int = 5) -> list[tuple[float, str, str]]:
    """(score, node_id, text) of the k nodes that BM25 finds for the question."""
    nodes = DocumentStore(spark, store).read()
    asked = spark.createDataFrame([(0, question)], "query_id long, query_str string")
    weights = keywords.bm25_weights(nodes, "node_id", only=keywords.bm25_tokens(asked, "query_id", "query_str"))
    hits = keywords.bm25_search(weights, asked, k, "node_id").join(nodes, "node_id").orderBy("rank")
    return [(r.score, r.node_id, r.text) for r in hits.collect()]


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sparkwell", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    into = commands.add_parser("ingest")
    into.add_argument("folder")
    into.add_argument("store")
    into.add_argument("--size", type=int, default=1024)
    into.add_argument("--overlap", type=int, default=200)
    asked = commands.add_parser("search")
    asked.add_argument("store")
    asked.add_argument("question")
    asked.add_argument("-k", type=int, default=5)
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("sparkwell").getOrCreate()
    if a.command == "ingest":
        print(ingest(spark, a.folder, a.store, a.size, a.overlap), "nodes")
    else:
        for score, node, told in search(spark, a.store, a.question, a.k):
            print(f"{score:.4f}  {node}\n{told}\n")


if __name__ == "__main__":
    main()
