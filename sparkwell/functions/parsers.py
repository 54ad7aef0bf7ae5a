"""What models answer, read as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwell.functions.text import fields, trimmed


def keywords(text: Column) -> Column:
    """Comma-separated keywords, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), trimmed), lambda k: k != "")


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: x != "")


def questions(text: Column) -> Column:
    """Lines without their numbers."""
    return F.filter(F.transform(lines(text), lambda x: trimmed(F.regexp_replace(x, r"^\d+[.)]\s*", ""))), lambda x: x != "")


def json_text(text: Column) -> Column:
    """The JSON in an answer: fenced, else from the first brace or bracket to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    loose = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.coalesce(F.nullif(trimmed(fenced), F.lit("")), F.nullif(loose, F.lit("")))


def json_value(text: Column, schema: str) -> Column:
    """The answer's JSON by a schema; null if it isn't such."""
    return F.from_json(json_text(text), schema)


def boolean(text: Column) -> Column:
    """true, yes, y, 1 as a word is true; false, no, n, 0 is false; else null."""
    words = F.transform(fields(F.lower(text)), lambda w: F.regexp_replace(w, r"^\W+|\W+$", ""))
    return (
        F.when(F.arrays_overlap(words, F.array(*map(F.lit, ("true", "yes", "y", "1")))), True)
        .when(F.arrays_overlap(words, F.array(*map(F.lit, ("false", "no", "n", "0")))), False)
    )


def says_yes(text: Column) -> Column:
    """1 if the answer has the word yes, else 0."""
    return F.when(F.rlike(F.lower(text), F.lit(r"\byes\b")), 1.0).otherwise(0.0)


def score(text: Column) -> Column:
    """A score on its own line, or after score:; null without one."""
    own = F.regexp_extract(text, r"(?m)^\s*(\d+(?:\.\d+)?)\s*$", 1)
    named = F.regexp_extract(text, r"(?i)score\s*:\s*(\d+(?:\.\d+)?)", 1)
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(named, F.lit(""))).try_cast("double")


def unit_score(s: Column) -> Column:
    """1..5 to 0..1."""
    return (s - 1) / 4


def five_score(s: Column) -> Column:
    return s * 4 + 1


# fixed value: a triplet in an answer
_TRIPLET = r"\(([^,]+),\s*([^,]+),\s*([^)]+)\)"


def triplets(text: Column, most: int = 10, longest: int = 128) -> Column:
    """Array of struct(subject, relation, object) of an answer's parenthesised triplets."""
    part = lambda g: F.regexp_extract_all(text, F.lit(_TRIPLET), F.lit(g))
    clean = lambda x: F.regexp_replace(trimmed(x), "^[\"']+|[\"']+$", "")
    upper = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))
    zipped = F.arrays_zip(part(1).alias("s"), part(2).alias("r"), part(3).alias("o"))
    short = lambda x: (x != "") & (F.octet_length(x) <= longest)
    kept = F.filter(
        F.transform(zipped, lambda t: F.struct(clean(t["s"]).alias("s"), clean(t["r"]).alias("r"), clean(t["o"]).alias("o"))),
        lambda t: short(t["s"]) & short(t["r"]) & short(t["o"]),
    )
    return F.slice(
        F.transform(kept, lambda t: F.struct(upper(t["s"]).alias("subject"), t["r"].alias("relation"), upper(t["o"]).alias("object"))),
        1,
        most,
    )


# fixed values: words of a question that name nothing
QUESTION_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall of in to for"
    " with on at by from as and or but if then that which who whom whose this these those it its what when where why how"
).split()


def query_keywords(text: Column, most: int = 10) -> Column:
    """Lower-cased words of more than two letters or digits that are no QUESTION_WORDS, the first ones in order."""
    words = F.transform(fields(F.lower(text)), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.slice(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(QUESTION_WORDS)), 1, most)


def listed_keywords(text: Column) -> Column:
    """Upper-cased keywords of an answer after KEYWORDS:."""
    return F.transform(keywords(F.regexp_replace(text, r"(?s)^.*KEYWORDS:", "")), F.upper)


def selections(text: Column) -> Column:
    """Zero-based choices of a JSON list or object {choice, reason}."""
    schema = "array<struct<choice:int,reason:string>>"
    many = json_value(text, schema)
    one = F.from_json(json_text(text), "struct<choice:int,reason:string>")
    found = F.coalesce(many, F.when(one["choice"].isNotNull(), F.array(one)))
    return F.transform(found, lambda s: F.struct((s["choice"] - 1).alias("index"), s["reason"].alias("reason")))


def sub_questions(text: Column) -> Column:
    """struct(sub_question, tool_name) items of a JSON answer."""
    plain = F.from_json(json_text(text), "array<struct<sub_question:string,tool_name:string>>")
    wrapped = F.from_json(json_text(text), "struct<items:array<struct<sub_question:string,tool_name:string>>>")
    # an object read as an array is an array of it
    return F.coalesce(F.when(F.startswith(json_text(text), F.lit("{")), wrapped["items"]), plain)


def bracketed_questions(text: Column) -> Column:
    """struct(tool, question) of lines such as [tool] question."""
    found = F.filter(lines(text), lambda x: F.rlike(x, F.lit(r"^\[[^\]]+\]\s*\S")))
    return F.transform(
        found,
        lambda x: F.struct(
            trimmed(F.regexp_extract(x, r"^\[([^\]]+)\]", 1)).alias("tool"),
            trimmed(F.regexp_extract(x, r"^\[[^\]]+\]\s*(.*)$", 1)).alias("question"),
        ),
    )


def relevances(text: Column, n: Column) -> Column:
    """struct(doc, relevance) of Doc: n, Relevance: r lines; 5 if none is given, repeats and numbers past n are left out."""
    pattern = r"(?i)doc:?\s*(\d+)(?:\s*,\s*relevance:?\s*(\d+(?:\.\d+)?))?"
    part = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    zipped = F.arrays_zip(part(1).alias("d"), part(2).alias("r"))
    made = F.transform(
        zipped, lambda z: F.struct(z["d"].try_cast("int").alias("doc"), F.coalesce(z["r"].try_cast("double"), F.lit(5.0)).alias("relevance"))
    )
    fits = F.filter(made, lambda m: (m["doc"] >= 1) & (m["doc"] <= n))
    docs = F.transform(fits, lambda m: m["doc"])
    return F.filter(fits, lambda m, i: F.array_position(docs, m["doc"]) == i + 1)


def permutation(text: Column, n: Column) -> Column:
    """Zero-based order of n passages: the numbers in the answer, then those not named."""
    named = F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int") - 1)
    named = F.array_distinct(F.filter(named, lambda i: (i >= 0) & (i < n)))
    every = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.concat(named, F.array_except(every, named))


def react(text: Column) -> Column:
    """struct(thought, action, action_input, answer) of a reasoning step; what is missing is null."""
    part = lambda p: F.nullif(trimmed(F.regexp_extract(text, p, 1)), F.lit(""))
    return F.struct(
        part(r"(?s)Thought:\s*(.*?)(?=\n\s*(?:Action|Answer):|\z)").alias("thought"),
        part(r"Action:\s*([^\n(]+)").alias("action"),
        F.replace(part(r"(?s)Action Input:\s*(\{.*?\})\s*(?:\n|\z)"), F.lit("'"), F.lit('"')).alias("action_input"),
        part(r"(?s)Answer:\s*(.*)\z").alias("answer"),
    )
