"""Summary trees: groups of consecutive nodes get a parent until few are left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.functions import text, vectors
from sparkwell.operators.common import ordered_list, small_side, top_k


def build(leaves: DataFrame, fan_out: int = 10, summarize=None) -> DataFrame:
    """(node_id, level, pos, parent_id, text) from leaves (node_id, pos, text) numbered 0, 1, ... without gaps.

    A parent's text is the model's summary, or the first 500 bytes of its children's texts. There are as many rounds as
    levels, log n of them.
    """
    level, depth = leaves.select(F.col("node_id").cast("string"), F.col("pos").cast("long"), "text"), 0
    n, out = leaves.count(), []
    while n > fan_out:
        up = F.floor(F.col("pos") / fan_out)
        name = F.concat(F.lit(f"summary-{depth + 1}-"), up.cast("string"))
        out.append(level.select("node_id", F.lit(depth).alias("level"), "pos", name.alias("parent_id"), "text"))
        joined = level.groupBy(up.alias("pos")).agg(
            F.array_join(ordered_list(F.concat("text", F.lit("\n")), F.col("pos")), "").alias("t")
        )
        summary = summarize(F.col("t")) if summarize else text.head_bytes(F.col("t"), 500, "...")
        depth += 1
        level = joined.select(F.concat(F.lit(f"summary-{depth}-"), F.col("pos").cast("string")).alias("node_id"), F.col("pos").cast("long"), summary.alias("text"))
        n = -(-n // fan_out)
    out.append(level.select("node_id", F.lit(depth).alias("level"), "pos", F.lit(None).cast("string").alias("parent_id"), "text"))
    tree = out[0]
    for t in out[1:]:
        tree = tree.unionByName(t)
    return tree


def insert(tree: DataFrame, new: DataFrame, fan_out: int = 10, summarize=None) -> DataFrame:
    """The tree with more leaves at its end; levels are built again, in one batch."""
    leaves = tree.where("level = 0").select("node_id", "pos", "text")
    n = leaves.count()
    more = new.select(F.col("node_id").cast("string"), (F.col("pos") + n).alias("pos"), "text")
    return build(leaves.unionByName(more), fan_out, summarize)


def all_leaves(tree: DataFrame) -> DataFrame:
    return tree.where("level = 0").withColumn("score", F.lit(1.0))


def roots(tree: DataFrame) -> DataFrame:
    return tree.where("parent_id is null").withColumn("score", F.lit(1.0))


def children(tree: DataFrame) -> DataFrame:
    return tree.where("parent_id is not null").select("parent_id", F.col("node_id").alias("child_id"), "pos")


def select_leaves(tree: DataFrame, queries: DataFrame, embed, beam: int = 1, depth: int | None = None) -> DataFrame:
    """From the roots down, the `beam` children nearest to each query at every level; the leaves that are reached."""
    own = tree.withColumn("embedding", embed(F.col("text")))
    asked = small_side(queries.select("query_id", F.col("embedding").alias("q")))
    depth = tree.agg(F.max("level")).first()[0] if depth is None else depth

    def best(rows: DataFrame) -> DataFrame:
        scored = rows.withColumn("score", vectors.cosine(F.col("embedding"), F.col("q")))
        return top_k(scored, beam, F.col("score"), "pos").select("query_id", "q", "node_id", "level", "score")

    found = best(own.where("parent_id is null").crossJoin(asked))
    out = found.where("level = 0")
    for _ in range(depth or 0):
        up = found.where("level > 0").select("query_id", "q", F.col("node_id").alias("parent_id"))
        found = best(own.join(up, "parent_id"))
        out = out.unionByName(found.where("level = 0"))
    return out.select("query_id", "node_id", "score")


def choice_prompt(tree: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, parent_id, prompt): the children of each parent as a numbered list to choose from."""
    listed = F.array_join(ordered_list(text.head_bytes(F.col("text"), 500), F.col("pos")), "\n")
    groups = tree.groupBy("parent_id").agg(listed.alias("choices"))
    prompt = text.format_prompt("{choices}\n\nWhich answers: {query}?", {"choices": F.col("choices"), "query": F.col("query_str")})
    return groups.crossJoin(small_side(queries)).select("query_id", "parent_id", prompt.alias("prompt"))


def choose_leaves(tree: DataFrame, queries: DataFrame, model, depth: int = 10) -> DataFrame:
    """(query_id, node_id, score): from the roots down, the child that a model names by its number; the leaf reached.

    An answer without a number of the list takes the first child. One round for each level.
    """
    listed = F.array_join(ordered_list(F.concat(F.lit("("), F.col("i").cast("string"), F.lit(") "), text.head_bytes(F.col("text"), 500)), F.col("i")), "\n")
    within = Window.partitionBy("query_id").orderBy("pos")
    rows = tree.where("parent_id is null").crossJoin(small_side(queries.select("query_id", "query_str")))
    out = None
    for _ in range(depth):
        offered = rows.withColumn("i", F.row_number().over(within))
        asked = offered.groupBy("query_id", "query_str").agg(listed.alias("choices"), F.count(F.lit(1)).alias("n"))
        prompt = text.format_prompt("{choices}\n\nWhich answers: {query}?", {"choices": F.col("choices"), "query": F.col("query_str")})
        named = F.regexp_extract(model(prompt), r"(\d+)", 1).try_cast("int")
        taken = asked.select("query_id", F.when(named.between(1, F.col("n")), named).otherwise(F.lit(1)).alias("i"))
        found = offered.join(taken, ["query_id", "i"])
        leaves = found.where("level = 0").select("query_id", "node_id", F.lit(1.0).alias("score"))
        out = leaves if out is None else out.unionByName(leaves)
        up = found.where("level > 0").select("query_id", "query_str", F.col("node_id").alias("parent_id"))
        if up.isEmpty():
            break
        rows = tree.join(up, "parent_id")
    return out
