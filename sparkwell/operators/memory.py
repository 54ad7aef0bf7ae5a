"""Conversation memory over (conv_id, turn, role, text): budgets, summaries, vector memory. Tokens are bytes / 4."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.functions import vectors
from sparkwell.functions.text import format_prompt
from sparkwell.operators.common import ordered_list, top_k


def history(turns: DataFrame) -> DataFrame:
    return turns.orderBy("conv_id", "turn")


def _suffixes(turns: DataFrame) -> DataFrame:
    """tokens of the messages from each turn to the end, joined by spaces."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    size = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(w)
    return turns.withColumn("__n", F.row_number().over(w)).withColumn("tokens", F.floor((size + F.col("__n") - 1) / 4))


def within_budget(turns: DataFrame, limit: int, used: int = 0) -> DataFrame:
    """The whole history if it fits, else its longest suffix that fits and doesn't begin with an assistant or tool."""
    if used > limit:
        raise ValueError(f"{used} tokens used already exceed the limit {limit}")
    own = _suffixes(turns)
    fits = F.col("tokens") + used <= limit
    last = Window.partitionBy("conv_id")
    may_start = fits & (~F.col("role").isin("assistant", "tool") | (F.col("__n") == F.max("__n").over(last)))
    start = F.min(F.when(may_start, F.col("turn"))).over(last)
    return own.withColumn("__start", start).where(F.col("turn") >= F.col("__start")).drop("__n", "__start", "tokens")


def summarized(turns: DataFrame, limit: int, model: Callable[[Column], Column]) -> DataFrame:
    """What fits stays; what comes before it becomes one system message with the model's summary, at turn -1."""
    kept = within_budget(turns, limit).select("conv_id", "turn", "role", "text")
    start = kept.groupBy("conv_id").agg(F.min("turn").alias("__start"))
    early = turns.join(start, "conv_id", "left").where(F.col("__start").isNull() | (F.col("turn") < F.col("__start")))
    told = F.array_join(ordered_list(F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))), F.col("turn")), "\n")
    old = early.groupBy("conv_id").agg(told.alias("t"))
    summary = old.select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), model(format_prompt("Summarize:\n{t}", {"t": F.col("t")})).alias("text"))
    return kept.unionByName(summary)


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def user_batches(turns: DataFrame) -> DataFrame:
    """(conv_id, batch, text): the messages from each user or system message to the next, joined by lines."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    batch = F.sum(F.col("role").isin("user", "system").cast("int")).over(w)
    own = turns.withColumn("batch", batch)
    line = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))
    return own.groupBy("conv_id", "batch").agg(F.array_join(ordered_list(line, F.col("turn")), "\n").alias("text"))


def recall(turns: DataFrame, queries: DataFrame, embed, k: int = 5) -> DataFrame:
    """The k batches of a conversation nearest to the query (conv_id, query_id, embedding)."""
    own = user_batches(turns).withColumn("v", embed(F.col("text")))
    hits = own.join(queries.select("conv_id", "query_id", F.col("embedding").alias("q")), "conv_id")
    scored = hits.select("query_id", "conv_id", "batch", "text", vectors.cosine(F.col("v"), F.col("q")).alias("score"))
    return top_k(scored, k, F.col("score"), "batch")


def condensed(turns: DataFrame, messages: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """(conv_id, query_str): a stand-alone question from each conversation's history and its new message."""
    line = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))
    told = turns.groupBy("conv_id").agg(F.array_join(ordered_list(line, F.col("turn")), "\n").alias("h"))
    asked = messages.join(told, "conv_id", "left")
    prompt = format_prompt("History:\n{h}\nFollow up: {m}\nStandalone question: ", {"h": F.coalesce("h", F.lit("")), "m": F.col("message")})
    return asked.select("conv_id", F.when(F.col("h").isNull(), F.col("message")).otherwise(model(prompt)).alias("query_str"))


def replied(turns: DataFrame, messages: DataFrame, contexts: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """The history with each new message (conv_id, message) and the model's answer to it in its context (conv_id, context)."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    asked = messages.join(last, "conv_id", "left").join(contexts, "conv_id", "left")
    next_turn = F.coalesce("last", F.lit(-1).cast("long")) + 1
    prompt = format_prompt("Context:\n{c}\nUser: {m}\nAssistant: ", {"c": F.coalesce("context", F.lit("")), "m": F.col("message")})
    user = asked.select("conv_id", next_turn.alias("turn"), F.lit("user").alias("role"), F.col("message").alias("text"))
    answer = asked.select("conv_id", (next_turn + 1).alias("turn"), F.lit("assistant").alias("role"), model(prompt).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(user).unionByName(answer)
