"""Answers from retrieved chunks: prompts are columns, the model is a column function or a plain function for folds.

Chunks are rows (query_id, pos, text), queries rows (query_id, query_str).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.functions.text import citation, format_prompt
from sparkwell.operators.common import ordered_list

QA = "Context information is below.\n---------------------\n{context_str}\n---------------------\nGiven the context information and not prior knowledge, answer the query.\nQuery: {query_str}\nAnswer: "
REFINE = "The original query is: {query_str}\nExisting answer: {existing_answer}\nNew context: {context_msg}\nRefined Answer: "
SUMMARY = "Summarize for the query {query_str}:\n{context_str}\n"
EMPTY = "Empty Response"


def _pack_numbers(most: int, gap: int):
    """For an array of sizes the number of the pack that each goes to: a sequential fold, as an Arrow function."""

    @F.pandas_udf("array<int>")
    def run(sizes: pd.Series) -> pd.Series:
        out = []
        for row in sizes:
            packs, pack, held = [], -1, 0
            for n in row:
                if held == 0 or held + gap + n > most:
                    pack, held = pack + 1, n
                else:
                    held += gap + n
                packs.append(pack)
            out.append(packs)
        return pd.Series(out)

    return run


def packed(chunks: DataFrame, most: int = 4096, separator: str = "\n\n") -> DataFrame:
    """(query_id, pos, text): consecutive chunks joined while they fit in `most` bytes.

    The running size restarts with each pack, so it is a fold over each query's array of sizes; texts are then joined by
    group.
    """
    sizes = chunks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.octet_length("text").alias("n")))).alias("s"))
    numbers = _pack_numbers(most, len(separator.encode()))(F.transform("s", lambda x: F.coalesce(x["n"], F.lit(0))))
    places = F.transform("s", lambda x: x["pos"].cast("bigint"))
    packs = sizes.select("query_id", F.explode(F.arrays_zip(places.alias("pos"), numbers.alias("pack"))).alias("o")).select("query_id", "o.pos", "o.pack")
    own = chunks.join(packs, ["query_id", "pos"])
    joined = own.groupBy("query_id", "pack").agg(F.array_join(ordered_list(F.col("text"), F.col("pos")), separator).alias("text"))
    return joined.select("query_id", F.col("pack").alias("pos"), "text")


def _answered(queries: DataFrame, answers: DataFrame) -> DataFrame:
    return queries.select("query_id").join(answers, "query_id", "left").withColumn("response", F.coalesce("response", F.lit(EMPTY)))


def simple(chunks: DataFrame, queries: DataFrame, model: Callable[[Column], Column], template: str = QA) -> DataFrame:
    """One call for each query over all its chunks."""
    joined = chunks.groupBy("query_id").agg(F.array_join(ordered_list(F.col("text"), F.col("pos")), "\n\n").alias("c"))
    asked = joined.join(queries, "query_id")
    prompt = format_prompt(template, {"context_str": F.col("c"), "query_str": F.col("query_str")})
    return _answered(queries, asked.select("query_id", model(prompt).alias("response")))


def refine(chunks: DataFrame, queries: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """A fold over each query's chunks: the first gives an answer, each later one refines it."""
    rows = chunks.join(queries.select("query_id", "query_str"), "query_id").select("query_id", "query_str", "pos", "text")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        answer = None
        for text, query in zip(pdf["text"], pdf["query_str"], strict=True):
            if answer is None:
                answer = call(QA.replace("{context_str}", text).replace("{query_str}", query))
            else:
                prompt = REFINE.replace("{query_str}", query, 1).replace("{context_msg}", text, 1)
                answer = call(prompt.replace("{existing_answer}", answer, 1))
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]], "response": [answer]})

    return _answered(queries, rows.groupBy("query_id").applyInPandas(run, "query_id long, response string"))


def compact_and_refine(chunks: DataFrame, queries: DataFrame, call: Callable[[str], str], most: int = 4096) -> DataFrame:
    return refine(packed(chunks, most), queries, call)


def tree_summarize(chunks: DataFrame, queries: DataFrame, model: Callable[[Column], Column], most: int = 4096, depth: int = 8) -> DataFrame:
    """Packs are summarised and packed again until one is left for each query, at most `depth` times."""
    own = packed(chunks, most)
    for _ in range(depth):
        asked = own.join(queries, "query_id")
        prompt = format_prompt(SUMMARY, {"context_str": F.col("text"), "query_str": F.col("query_str")})
        own = asked.select("query_id", "pos", model(prompt).alias("text"))
        if own.groupBy("query_id").count().where("count > 1").isEmpty():
            break
        own = packed(own, most)
    joined = own.groupBy("query_id").agg(F.array_join(ordered_list(F.col("text"), F.col("pos")), "\n\n").alias("response"))
    return _answered(queries, joined)


def accumulate(chunks: DataFrame, queries: DataFrame, model: Callable[[Column], Column], separator: str = "\n---------------------\n", most: int | None = None) -> DataFrame:
    """An answer for each chunk (or pack), joined under numbers."""
    own = packed(chunks, most) if most else chunks
    asked = own.join(queries, "query_id")
    prompt = format_prompt(QA, {"context_str": F.col("text"), "query_str": F.col("query_str")})
    w = Window.partitionBy("query_id").orderBy("pos")
    told = asked.select("query_id", "pos", F.row_number().over(w).alias("i"), model(prompt).alias("r"))
    one = F.concat(F.lit("Response "), F.col("i").cast("string"), F.lit(": "), F.col("r"))
    return _answered(queries, told.groupBy("query_id").agg(F.array_join(ordered_list(one, F.col("i")), separator).alias("response")))


def no_text(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """The retrieved rows without an answer."""
    return _answered(queries, chunks.groupBy("query_id").agg(F.lit("").alias("response")))


def synthesize(mode: str, chunks: DataFrame, queries: DataFrame, model: Callable[[Column], Column], call: Callable[[str], str]) -> DataFrame:
    """By mode's name; generation, no_text and context_only are the simple one."""
    modes = {
        "refine": lambda: refine(chunks, queries, call),
        "compact": lambda: compact_and_refine(chunks, queries, call),
        "tree_summarize": lambda: tree_summarize(chunks, queries, model),
        "accumulate": lambda: accumulate(chunks, queries, model),
        "compact_accumulate": lambda: accumulate(chunks, queries, model, most=4096),
    }
    return modes.get(mode, lambda: simple(chunks, queries, model))()


def sources(chunks: DataFrame, n: int = 100) -> DataFrame:
    """(query_id, sources): each query's chunks as citations; needs node_id."""
    one = citation(F.col("node_id"), F.col("text"), n)
    return chunks.groupBy("query_id").agg(F.array_join(ordered_list(one, F.col("pos")), "\n\n").alias("sources"))


def response_metadata(chunks: DataFrame) -> DataFrame:
    """(query_id, metadata): map from node_id to its metadata."""
    pairs = F.array_sort(F.collect_set(F.struct("node_id", F.to_json("metadata").alias("metadata"))))
    return chunks.groupBy("query_id").agg(F.map_from_entries(pairs).alias("metadata"))


def sub_question_chunks(answers: DataFrame) -> DataFrame:
    """Chunks made of (query_id, pos, sub_question, response): question and answer pairs; failed ones are left out."""
    made = F.concat(F.lit("Sub question: "), F.col("sub_question"), F.lit("\nResponse: "), F.col("response"))
    return answers.where(F.col("response").isNotNull()).select("query_id", "pos", made.alias("text"))


def hypothetical(queries: DataFrame, model: Callable[[Column], Column], keep: bool = True) -> DataFrame:
    """Queries with embedding_str: a made-up answer, after the query itself if it is kept."""
    prompt = format_prompt("Please write a passage to answer the question\n{query_str}\nPassage: ", {"query_str": F.col("query_str")})
    told = model(prompt)
    return queries.withColumn("embedding_str", F.concat_ws("\n", "query_str", told) if keep else told)
