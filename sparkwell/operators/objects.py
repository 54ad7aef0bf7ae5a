"""Objects and tools as nodes with a description, and their retrieval by what they say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell.operators import retrieval

NODE = ["node_id", "text", "metadata"]


def object_nodes(objects: DataFrame, kind: str = "object", key: str | None = None, name: str | None = None, description: str | None = None) -> DataFrame:
    """(node_id, text, metadata, payload) of a row for each object.

    The text is the description, or all of the object as JSON; without a key the id is the JSON's digest. metadata holds
    the object's kind and name, payload its JSON.
    """
    payload = F.to_json(F.struct(*objects.columns), {"ignoreNullFields": "false"})
    own = objects.withColumn("__payload", payload)
    told = F.nullif(F.col(description), F.lit("")) if description else F.lit(None).cast("string")
    held = F.create_map(F.lit("object_type"), F.lit(kind), F.lit("name"), F.col(name).cast("string") if name else F.lit(None).cast("string"))
    return own.select(
        (F.col(key).cast("string") if key else F.sha2(F.col("__payload").cast("binary"), 256)).alias("node_id"),
        F.coalesce(told, "__payload").alias("text"),
        F.map_filter(held, lambda k, v: v.isNotNull()).alias("metadata"),
        F.col("__payload").alias("payload"),
    )


def tool_nodes(tools: DataFrame) -> DataFrame:
    """Nodes of tools (name, description, return_direct, parameters): the name is the id, and the text where none is described."""
    held = {"name": F.col("name"), "description": F.col("description"), "object_type": F.lit("tool"), "return_direct": F.col("return_direct").cast("string")}
    held["parameters"] = F.col("parameters")
    metadata = F.create_map(*[x for k, v in held.items() for x in (F.lit(k), v)])
    return tools.select(
        F.col("name").alias("node_id"),
        F.coalesce(F.nullif(F.col("description"), F.lit("")), "name").alias("text"),
        F.map_filter(metadata, lambda k, v: v.isNotNull()).alias("metadata"),
        F.to_json(F.struct("name", "description", "return_direct", "parameters")).alias("payload"),
    )


def retrieve(nodes: DataFrame, queries: DataFrame, embed: Callable[[Column], Column], k: int = 3) -> DataFrame:
    """(query_id, node_id, score, rank, payload): the k objects whose text is nearest to each query (query_id, query_str)."""
    own = nodes.withColumn("embedding", embed(F.col("text")))
    hits = retrieval.dense_search(own, queries.select("query_id", embed(F.col("query_str")).alias("embedding")), k)
    return hits.join(nodes.select("node_id", "payload"), "node_id")
