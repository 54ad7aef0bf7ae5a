"""Programs: prompts from columns, a model's answer, and its JSON read by a schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell.functions import parsers
from sparkwell.functions.text import format_prompt

Model = Callable[[Column], Column]


def prompt_of(rows: DataFrame, template: str | None = None) -> Column:
    """The template filled with the row's columns; without one its input or query, else all columns as JSON."""
    if template is not None:
        return format_prompt(template, {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns})
    for name in ("input", "query"):
        if name in rows.columns:
            return F.col(name).cast("string")
    return F.to_json(F.struct(*rows.columns))


def instructions(schema: str) -> str:
    return f"Answer with JSON of this form and nothing else: {schema}"


def run(rows: DataFrame, model: Model, schema: str, template: str | None = None) -> DataFrame:
    """`rows` with raw (the answer) and output (its JSON by the schema, null where it has none)."""
    prompt = F.concat(prompt_of(rows, template), F.lit("\n\n" + instructions(schema)))
    return rows.withColumn("raw", model(prompt)).withColumn("output", parsers.json_value(F.col("raw"), schema))


def run_several(rows: DataFrame, model: Model, schema: str, n: int, template: str | None = None) -> DataFrame:
    """As run(), with an array of outputs asked for and read."""
    asked = f"\n\nGive {n} different outputs as a JSON array.\n\n" + instructions(schema)
    prompt = F.concat(prompt_of(rows, template), F.lit(asked))
    return rows.withColumn("raw", model(prompt)).withColumn("output", parsers.json_value(F.col("raw"), f"array<{schema}>"))


def call(rows: DataFrame, model: Model, name: str, schema: str, template: str | None = None) -> DataFrame:
    """Function programs: `model` answers with JSON of its calls, an array of {name, arguments: text}.

    raw becomes the arguments of the first call of `name`; without such a call the whole answer is read.
    """
    answer = rows.withColumn("__answer", model(prompt_of(rows, template)))
    calls = F.from_json("__answer", "array<struct<name:string,arguments:string>>")
    mine = F.get(F.filter(calls, lambda c: c["name"] == name), 0)["arguments"]
    told = answer.withColumn("raw", F.coalesce(mine, "__answer")).drop("__answer")
    return told.withColumn("output", parsers.json_value(F.col("raw"), schema))
