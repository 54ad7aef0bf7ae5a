"""Metadata extractors over nodes (node_id, source_id, pos, text, metadata)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.functions import parsers
from sparkwell.functions.text import format_prompt
from sparkwell.operators.common import ordered_list

Model = Callable[[Column], Column]


def with_metadata(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds keys to metadata; null values add nothing, existing keys are replaced."""
    own = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("string") for v in values.values()]))
    own = F.map_filter(own, lambda k, v: v.isNotNull())
    held = F.map_filter("metadata", lambda k, v: ~F.array_contains(F.map_keys(own), k))
    return df.withColumn("metadata", F.map_concat(held, own))


def keywords(df: DataFrame, model: Model, most: int = 5) -> DataFrame:
    answer = model(format_prompt("{text}\n\nGive {n} keywords, comma-separated.", {"text": F.col("text"), "n": F.lit(most)}))
    return with_metadata(df, {"excerpt_keywords": F.array_join(F.slice(parsers.keywords(answer), 1, most), ", ")})


def questions(df: DataFrame, model: Model, most: int = 5) -> DataFrame:
    answer = model(format_prompt("{text}\n\nGive {n} questions that this answers.", {"text": F.col("text"), "n": F.lit(most)}))
    return with_metadata(df, {"questions_this_excerpt_can_answer": F.array_join(F.slice(parsers.questions(answer), 1, most), "\n")})


def neighbours(df: DataFrame, value: str, order: str = "pos", partition: str = "source_id") -> DataFrame:
    """prev_<value> and next_<value> in each source document's order; empty ones are null."""
    w = Window.partitionBy(partition).orderBy(order)
    full = lambda c: F.nullif(c, F.lit(""))
    return df.withColumn(f"prev_{value}", full(F.lag(value).over(w))).withColumn(f"next_{value}", full(F.lead(value).over(w)))


def summaries(df: DataFrame, model: Model, which: tuple[str, ...] = ("self",)) -> DataFrame:
    own = df.withColumn("__summary", model(format_prompt("Summarize:\n{text}", {"text": F.col("text")})))
    own = neighbours(own, "__summary")
    columns = {"self": ("section_summary", "__summary"), "prev": ("prev_section_summary", "prev___summary"), "next": ("next_section_summary", "next___summary")}
    values = {columns[w][0]: F.nullif(F.col(columns[w][1]), F.lit("")) for w in which}
    return with_metadata(own, values).drop("__summary", "prev___summary", "next___summary")


def first_nodes(df: DataFrame, n: int = 5, partition: str = "source_id", order: str = "pos") -> DataFrame:
    """The first n nodes of each source document."""
    w = Window.partitionBy(partition).orderBy(order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def titles(df: DataFrame, model: Model, n: int = 5) -> DataFrame:
    """document_title from the candidates of each document's first n nodes."""
    some = first_nodes(df, n).withColumn("__c", model(format_prompt("Give a title for:\n{text}", {"text": F.col("text")})))
    joined = some.groupBy("source_id").agg(F.array_join(ordered_list(F.col("__c"), F.col("pos")), ", ").alias("__cs"))
    named = joined.select("source_id", model(format_prompt("{titles}\nBest title:", {"titles": F.col("__cs")})).alias("__t"))
    return with_metadata(df.join(named, "source_id", "left"), {"document_title": F.col("__t")}).drop("__t")


def chain(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return reduce(lambda d, s: d.transform(s), steps, df)
