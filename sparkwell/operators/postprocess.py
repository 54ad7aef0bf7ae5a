"""What happens to retrieved rows (query_id, node_id, text, metadata, score, rank) before they are used."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from sparkwell.functions import parsers, recency, text, vectors
from sparkwell.operators.chunking import prose_sentences
from sparkwell.operators.common import ordered_list, top_k

Step = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, steps: list[Step]) -> DataFrame:
    """The steps one after the other."""
    return reduce(lambda d, s: d.transform(s), steps, df)


def similarity_cutoff(df: DataFrame, cutoff: float = 0.0) -> DataFrame:
    """Scores of at least the cutoff; a score of exactly 0 always goes."""
    return df.where((F.col("score") != 0) & (F.col("score") >= cutoff))


def keyword_filter(df: DataFrame, required: tuple[str, ...] = (), excluded: tuple[str, ...] = (), case: bool = False) -> DataFrame:
    own = F.col("text") if case else F.lower("text")
    fold = (lambda w: w) if case else str.lower
    for w in required:
        df = df.where(F.contains(own, F.lit(fold(w))))
    for w in excluded:
        df = df.where(~F.contains(own, F.lit(fold(w))))
    return df


def replace_by_metadata(df: DataFrame, key: str = "window") -> DataFrame:
    return df.withColumn("text", F.coalesce(F.try_element_at("metadata", F.lit(key)), F.col("text")))


def compress(df: DataFrame, stop_words: bool = False, most: int | None = None) -> DataFrame:
    return df.withColumn("text", text.compressed(F.col("text"), stop_words, most))


def best(df: DataFrame, k: int = 10, key: str = "node_id") -> DataFrame:
    return top_k(df.drop("rank"), k, F.col("score"), key)


def long_context_order(df: DataFrame, key: str = "node_id") -> DataFrame:
    """Position 0.. such that the best rows stand at both ends: ascending rows go in turn to the front and the back."""
    w = Window.partitionBy("query_id").orderBy("score", key)
    own = df.withColumn("__i", F.row_number().over(w) - 1)
    place = F.when(F.col("__i") % 2 == 0, -F.col("__i")).otherwise(F.col("__i"))
    order = Window.partitionBy("query_id").orderBy("__place")
    return own.withColumn("__place", place).withColumn("position", F.row_number().over(order) - 1).drop("__i", "__place")


def batches(df: DataFrame, size: int = 10, key: str = "node_id") -> DataFrame:
    """batch and place (1..) of each row in consecutive runs of `size` by score."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    i = F.row_number().over(w) - 1
    return df.withColumn("batch", F.floor(i / size).cast("int")).withColumn("place", (i % size + 1).cast("int"))


def recency_order(
    df: DataFrame, date: Column, now: Column, k: int | None = None, mode: str | None = None, most_age: float | None = None, key: str = "node_id", **weights
) -> DataFrame:
    """By date (undated rows last), or by the score weighted by age; undated rows keep their score and pass the age filter."""
    own = df.withColumn("__t", date)
    age = recency.age_seconds(F.col("__t"), now)
    if most_age:
        own = own.where(F.col("__t").isNull() | (age <= most_age))
    if mode:
        weighted = {
            "linear": lambda: recency.linear(F.col("score"), age, most_age),
            "exponential": lambda: recency.exponential(F.col("score"), age, weights.get("rate", 0.99), most_age),
            "step": lambda: recency.step(F.col("score"), age, weights.get("recent", 86_400), weights.get("recent_weight", 1.0), weights.get("old_weight", 0.5)),
        }[mode]()
        own = own.withColumn("score", F.when(F.col("__t").isNull(), F.col("score")).otherwise(weighted))
        by = F.col("score")
    else:
        by = F.col("__t")
    return top_k(own.drop("rank"), k or (1 << 30), by, key).drop("__t")


def optimize_sentences(df: DataFrame, queries: DataFrame, embed, k: int = 5, threshold: float = 0.0, context: int = 0, key: str = "node_id") -> DataFrame:
    """Each row's text reduced to its k sentences nearest to the query, with `context` neighbours, in their order."""
    own = df.select("query_id", key, F.posexplode(prose_sentences(F.col("text"))).alias("i", "sentence"))
    own = own.withColumn("v", embed(F.col("sentence"))).join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    scored = own.withColumn("s", vectors.cosine(F.col("v"), F.col("q"))).where(F.col("s") >= threshold)
    w = Window.partitionBy("query_id", key).orderBy(F.col("s").desc(), "i")
    near = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    wanted = near.select("query_id", key, F.explode(F.sequence(F.col("i") - context, F.col("i") + context)).alias("i")).distinct()
    kept = own.select("query_id", key, "i", "sentence").join(wanted, ["query_id", key, "i"])
    made = kept.groupBy("query_id", key).agg(F.array_join(ordered_list(F.col("sentence"), F.col("i")), " ").alias("__text"))
    return df.join(made, ["query_id", key], "left").withColumn("text", F.coalesce("__text", "text")).drop("__text")


def llm_rerank(df: DataFrame, queries: DataFrame, model, k: int = 5, size: int = 10, key: str = "node_id") -> DataFrame:
    """Batches of rows judged by a model: prompt, answer with Doc and Relevance, best k of all. An answer without any
    leaves the batch in its order with falling scores."""
    own = batches(df, size, key)
    listing = F.array_join(ordered_list(F.concat(F.lit("Document "), F.col("place").cast("string"), F.lit(":\n"), F.col("text")), F.col("place")), "\n\n")
    asked = own.groupBy("query_id", "batch").agg(listing.alias("docs"), F.count(F.lit(1)).cast("int").alias("n")).join(queries.select("query_id", "query_str"), "query_id")
    prompt = text.format_prompt("{docs}\n\nQuestion: {query}\nAnswer with Doc: n, Relevance: r lines.", {"docs": F.col("docs"), "query": F.col("query_str")})
    told = asked.withColumn("answer", model(prompt)).withColumn("found", parsers.relevances(F.col("answer"), F.col("n")))
    falling = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(i.alias("doc"), (F.lit(1.0) / i).alias("relevance")))
    judged = told.select("query_id", "batch", F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(falling)).alias("f"))
    judged = judged.select("query_id", "batch", F.col("f.doc").alias("place"), F.col("f.relevance").alias("score"))
    return top_k(own.drop("score", "rank").join(judged, ["query_id", "batch", "place"]), k, F.col("score"), key).drop("batch", "place")


def rankgpt(df: DataFrame, queries: DataFrame, model, k: int = 5, key: str = "node_id") -> DataFrame:
    """One permutation for each query from a model; rows it doesn't name follow in order; scores stay."""
    own = batches(df, 1 << 30, key)
    listing = F.array_join(ordered_list(F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.col("text")), F.col("place")), "\n")
    asked = own.groupBy("query_id").agg(listing.alias("docs"), F.count(F.lit(1)).cast("int").alias("n")).join(queries.select("query_id", "query_str"), "query_id")
    prompt = text.format_prompt("Rank by relevance to {query}:\n{docs}", {"query": F.col("query_str"), "docs": F.col("docs")})
    order = asked.select("query_id", F.posexplode(parsers.permutation(model(prompt), F.col("n"))).alias("position", "i"))
    placed = own.join(order.select("query_id", "position", (F.col("i") + 1).alias("place")), ["query_id", "place"])
    return placed.where(F.col("position") < k).withColumn("rank", F.col("position") + 1).drop("batch", "place", "position")


def sliding_rankgpt(df: DataFrame, queries: DataFrame, judge: Callable[[str, list[str]], list[int]], window: int = 20, step: int = 10, k: int = 5, key: str = "node_id") -> DataFrame:
    """Windows of rows ranked from the tail to the head, so good rows climb; `judge(query, texts)` gives an order."""
    schema = df.drop("rank").schema
    rows = df.drop("rank").join(queries.select("query_id", F.col("query_str").alias("__q")), "query_id")
    names = [f.name for f in schema]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", key], ascending=[False, True]).reset_index(drop=True)
        order, end = list(range(len(pdf))), len(pdf)
        while end > 0:
            start = max(0, end - window)
            part = order[start:end]
            named = list(dict.fromkeys(i for i in judge(pdf["__q"][0], [pdf["text"][j] for j in part]) if 0 <= i < len(part)))
            order[start:end] = [part[i] for i in named + [i for i in range(len(part)) if i not in set(named)]]
            if start == 0:
                break
            end -= step
        out = pdf.iloc[order[:k]][names].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return rows.groupBy("query_id").applyInPandas(run, schema.add("rank", IntegerType()))
