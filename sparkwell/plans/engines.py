"""Engines made of engines: routing, sub-questions, and rewriting of queries. An engine maps queries to (query_id, response)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell.functions import parsers
from sparkwell.functions.text import format_prompt
from sparkwell.operators import synthesis
from sparkwell.operators.common import ordered_list

Ask = Callable[[DataFrame], DataFrame]


def routed(engines: dict[str, Ask], queries: DataFrame, model: Callable[[Column], Column], chosen: Column | None = None) -> DataFrame:
    """Answers of the engines that a query's `chosen` array names (all by default), summarised if there are several."""
    parts = []
    for i, (name, ask) in enumerate(engines.items()):
        own = queries if chosen is None else queries.where(F.array_contains(chosen, name))
        parts.append(ask(own).withColumn("pos", F.lit(i)))
    told = reduce(DataFrame.unionByName, parts).groupBy("query_id")
    told = told.agg(F.count(F.lit(1)).alias("n"), F.array_join(ordered_list(F.col("response"), F.col("pos")), "\n\n").alias("r"))
    own = told.join(queries.select("query_id", "query_str"), "query_id")
    prompt = format_prompt(synthesis.SUMMARY, {"query_str": F.col("query_str"), "context_str": F.col("r")})
    return own.select("query_id", F.when(F.col("n") == 1, F.col("r")).otherwise(model(prompt)).alias("response"))


def sub_questions(engines: dict[str, Ask], queries: DataFrame, plan: Callable[[Column], Column], model: Callable[[Column], Column]) -> DataFrame:
    """A model's [tool] question lines, each answered by its tool; the pairs are the context of the final answer.

    Lines that name no known tool are left out.
    """
    asked = queries.select("query_id", F.posexplode(parsers.bracketed_questions(plan(F.col("query_str")))).alias("pos", "s"))
    asked = asked.select("query_id", "pos", F.col("s.tool").alias("tool"), F.col("s.question").alias("sub_question"))
    asked = asked.withColumn("sub_id", F.xxhash64("query_id", "pos"))
    parts = []
    for name, ask in engines.items():
        own = asked.where(F.col("tool") == name)
        answers = ask(own.select(F.col("sub_id").alias("query_id"), F.col("sub_question").alias("query_str")))
        parts.append(own.join(answers.withColumnRenamed("query_id", "sub_id"), "sub_id").select("query_id", "pos", "sub_question", "response"))
    pairs = synthesis.sub_question_chunks(reduce(DataFrame.unionByName, parts))
    return synthesis.simple(pairs, queries, model)


def rewritten(ask: Ask, rewrite: Callable[[Column], Column]) -> Ask:
    """The engine over rewritten queries."""
    return lambda queries: ask(queries.withColumn("query_str", rewrite(F.col("query_str"))))
