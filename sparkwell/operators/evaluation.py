"""Evaluation rows (evaluator, query, response, contexts, reference) to nullable score and passing, and their summaries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell.functions import parsers, vectors
from sparkwell.functions.text import format_prompt

Evaluator = Callable[[DataFrame], DataFrame]


def summary(results: DataFrame) -> DataFrame:
    """average_score over rows with a score (0 without any), passing_rate over all rows, total_count of each evaluator."""
    return results.groupBy("evaluator").agg(
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"),
        F.avg(F.coalesce("passing", F.lit(False)).cast("double")).alias("passing_rate"),
        F.count(F.lit(1)).alias("total_count"),
    )


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences b - a of two summaries for the evaluators that both have."""
    one, two = a.alias("a"), b.alias("b")
    return one.join(two, "evaluator").select(
        "evaluator",
        (F.col("b.average_score") - F.col("a.average_score")).alias("score_diff"),
        (F.col("b.passing_rate") - F.col("a.passing_rate")).alias("passing_rate_diff"),
    )


def mean_with_missing_as_zero(results: DataFrame) -> DataFrame:
    return results.agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))


def context_share(judged: DataFrame, key: str = "query_id", threshold: float = 0.5) -> DataFrame:
    """Share of a query's contexts judged relevant (answer contains yes); passing above the threshold."""
    own = judged.groupBy(key).agg(F.avg(parsers.says_yes(F.col("answer"))).alias("score"))
    return own.withColumn("passing", F.col("score") > threshold)


def _result(df: DataFrame, name: str, score: Column, passing: Column, valid: Column, why: str) -> DataFrame:
    return df.select(
        "query_id",
        F.lit(name).alias("evaluator"),
        F.when(valid, score).alias("score"),
        F.when(valid, passing).alias("passing"),
        F.when(~valid, F.lit(why)).alias("invalid_reason"),
    )


def semantic_similarity(embed, metric: str = "cosine", threshold: float = 0.8) -> Evaluator:
    def run(df: DataFrame) -> DataFrame:
        own = df.withColumn("__a", embed(F.col("response"))).withColumn("__b", embed(F.col("reference")))
        s = vectors.similarity(F.col("__a"), F.col("__b"), metric)
        valid = F.col("response").isNotNull() & F.col("reference").isNotNull()
        return _result(own, "semantic_similarity", s, s >= threshold, valid, "response or reference is missing")

    return run


def correctness(model: Callable[[Column], Column], threshold: float = 4.0) -> Evaluator:
    def run(df: DataFrame) -> DataFrame:
        prompt = format_prompt("Query: {q}\nReference: {r}\nAnswer: {a}\nScore 1 to 5 on its own line.", {"q": F.col("query"), "r": F.coalesce("reference", F.lit("")), "a": F.col("response")})
        own = df.withColumn("__s", parsers.score(model(prompt)))
        return _result(own, "correctness", F.col("__s"), F.col("__s") >= threshold, F.col("__s").isNotNull(), "no score in the answer")

    return run


def yes_or_no(name: str, template: str, model: Callable[[Column], Column]) -> Evaluator:
    """Faithfulness, relevancy, answer relevancy: 1 if the model says yes."""

    def run(df: DataFrame) -> DataFrame:
        values = {"query": F.col("query"), "response": F.col("response"), "contexts": F.array_join("contexts", "\n\n")}
        own = df.withColumn("__s", parsers.says_yes(model(format_prompt(template, values))))
        valid = F.col("response").isNotNull() & (F.coalesce(F.size("contexts"), F.lit(0)) > 0)
        return _result(own, name, F.col("__s"), F.col("__s") == 1, valid, "response or contexts are missing")

    return run


def batch(df: DataFrame, evaluators: list[Evaluator]) -> DataFrame:
    """All evaluators over all rows."""
    return reduce(DataFrame.unionByName, [e(df) for e in evaluators])
