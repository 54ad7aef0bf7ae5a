"""Knowledge graph as an edge table (subject, relation, object)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.functions import parsers, vectors
from sparkwell.operators.common import small_side, top_k

EDGE = ["subject", "relation", "object"]


def upsert(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.select(*EDGE).unionByName(new.select(*EDGE)).dropDuplicates(EDGE)


def delete(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(*EDGE), EDGE, "left_anti")


def of_subjects(edges: DataFrame, subjects: DataFrame) -> DataFrame:
    return edges.join(subjects.select("subject").distinct(), "subject", "left_semi")


def size(edges: DataFrame) -> DataFrame:
    """(n_subjects, n_edges)."""
    own = edges.select(*EDGE).distinct()
    return own.agg(F.countDistinct("subject").alias("n_subjects"), F.count(F.lit(1)).alias("n_edges"))


def relation_map(edges: DataFrame, subjects: DataFrame, depth: int = 2, limit: int | None = 30) -> DataFrame:
    """(start, level, subject, relation, object): edges on paths of up to `depth` steps from each subject.

    Each level is a join on the objects of the one before, with repeats of an edge at a level counted once. The limit
    keeps a start's first edges by level, subject, relation and object.
    """
    own = edges.select(*EDGE).distinct()
    starts = subjects.select(F.col("subject").alias("start")).distinct()
    level = starts.join(own, F.col("start") == F.col("subject")).select("start", F.lit(1).alias("level"), *EDGE)
    out = level
    for d in range(2, depth + 1):
        ends = level.select("start", F.col("object").alias("__o")).distinct()
        level = ends.join(own, F.col("__o") == F.col("subject")).select("start", F.lit(d).alias("level"), *EDGE)
        out = out.unionByName(level)
    if limit is None:
        return out
    w = Window.partitionBy("start").orderBy("level", *EDGE)
    return out.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit).drop("__r")


def extract(nodes: DataFrame, answers: Column, most: int = 10) -> DataFrame:
    """(node_id, subject, relation, object) from each node's model answer."""
    return nodes.select("node_id", F.explode(parsers.triplets(answers, most)).alias("t")).select("node_id", "t.*")


def entity_nodes(triplets: DataFrame) -> DataFrame:
    """(entity, node_id): the nodes that name an entity, once each."""
    one = lambda c: triplets.select(F.col(c).alias("entity"), "node_id")
    return one("subject").unionByName(one("object")).distinct()


def nodes_of(entities: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, keyword, node_id) for (query_id, keyword), whatever the case."""
    return keywords.join(entities, F.lower("keyword") == F.lower("entity")).select("query_id", "keyword", "node_id")


def without_substrings(texts: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value isn't contained in another, longer one of the same key (equal lengths: the first by order stays)."""
    a, b = texts.select(key, value).distinct(), texts.select(F.col(key).alias("__k"), F.col(value).alias("__v")).distinct()
    longer = (F.octet_length("__v") > F.octet_length(value)) & F.contains(F.col("__v"), F.col(value))
    return a.join(b, (F.col(key) == F.col("__k")) & longer, "left_anti")


def retrieve(
    edges: DataFrame, entities: DataFrame, queries: DataFrame, depth: int = 2, limit: int = 30, per_keyword: int = 3, top: int = 10
) -> tuple[DataFrame, DataFrame]:
    """(nodes: query_id, node_id, n, rank; relation texts: query_id, texts) of each query's keywords."""
    asked = queries.select("query_id", F.explode(F.array_distinct(parsers.query_keywords(F.col("query_str")))).alias("keyword"))
    found = nodes_of(entities, asked)
    w = Window.partitionBy("query_id", "keyword").orderBy("node_id")
    found = found.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_keyword).drop("__r")
    counted = found.groupBy("query_id", "node_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = top_k(counted, top, F.col("n"), "node_id").withColumn("score", F.lit(1000.0))
    own = edges.select(*EDGE).distinct()
    start = asked.join(own.select("subject").distinct(), F.lower("keyword") == F.lower("subject")).select("query_id", "subject")
    relations = relation_map(edges, start, depth, limit)
    texts = start.join(relations.withColumnRenamed("subject", "s"), start["subject"] == relations["start"]).select(
        "query_id", F.concat(F.lit("["), F.concat_ws(", ", "s", "relation", "object"), F.lit("]")).alias("t")
    )
    joined = texts.distinct().groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("t")), "\n").alias("texts"))
    told = queries.select("query_id").join(joined, "query_id", "left")
    return ranked, told.withColumn("texts", F.coalesce("texts", F.lit("No relationships found.")))


def triplet_search(edges: DataFrame, queries: DataFrame, embed, k: int = 2) -> DataFrame:
    """The k triplets nearest to each query, by the embedding of (s, r, o)."""
    own = edges.select(F.concat(F.lit("("), F.concat_ws(", ", *EDGE), F.lit(")")).alias("triplet")).distinct()
    scored = own.withColumn("v", embed(F.col("triplet"))).crossJoin(small_side(queries.select("query_id", F.col("embedding").alias("q"))))
    return top_k(scored.select("query_id", "triplet", vectors.cosine(F.col("v"), F.col("q")).alias("score")), k, F.col("score"), "triplet")


def get(edges: DataFrame, subjects: list[str] | None = None, relations: list[str] | None = None, objects: list[str] | None = None) -> DataFrame:
    """The edges that all given lists allow."""
    own = edges
    for column, values in (("subject", subjects), ("relation", relations), ("object", objects)):
        own = own if values is None else own.where(F.col(column).isin(values))
    return own


def property_upsert(vertices: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """Vertices (key, label, properties) with the new ones in place of those of the same key, new properties added to old."""
    old = vertices.select(key, F.col("label").alias("__l"), F.col("properties").alias("__p"))
    none = F.create_map().cast("map<string,string>")
    added = F.coalesce("properties", none)
    kept = F.map_filter(F.coalesce("__p", none), lambda k, v: ~F.array_contains(F.map_keys(added), k))
    return old.join(new, key, "full").select(key, F.coalesce("label", "__l").alias("label"), F.map_concat(kept, added).alias("properties"))


def property_get(vertices: DataFrame, keys: list[str] | None = None, labels: list[str] | None = None, properties: dict[str, str] | None = None, key: str = "name") -> DataFrame:
    own = vertices if keys is None else vertices.where(F.col(key).isin(keys))
    own = own if labels is None else own.where(F.col("label").isin(labels))
    for name, value in (properties or {}).items():
        own = own.where(F.try_element_at("properties", F.lit(name)) == value)
    return own


def property_delete(vertices: DataFrame, edges: DataFrame, gone: DataFrame, key: str = "name") -> tuple[DataFrame, DataFrame]:
    """Vertices and edges without the vertices `gone` and their edges."""
    out = gone.select(F.col(key).alias("__g")).distinct()
    left = vertices.join(out, F.col(key) == F.col("__g"), "left_anti")
    kept = edges.join(out, F.col("subject") == F.col("__g"), "left_anti").join(out, F.col("object") == F.col("__g"), "left_anti")
    return left, kept
