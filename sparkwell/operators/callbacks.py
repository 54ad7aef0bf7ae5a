"""Logged events (event_id, parent_id, event_type, token counts, times): totals, selections, trace trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_totals(events: DataFrame) -> DataFrame:
    """Events, tokens and mean duration by type."""
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.avg("duration").alias("mean_duration"),
    )


def of_type(events: DataFrame, *types: str) -> DataFrame:
    return events.where(F.col("event_type").isin(*types))


def trace_tree(events: DataFrame) -> DataFrame:
    """(parent_id, children): child events in order of id."""
    return events.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.array_sort(F.collect_list("event_id")).alias("children"))
