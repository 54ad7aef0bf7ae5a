"""Personal data: masking, detection and filtering by ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell.functions.arrays import let, running

# fixed values: kinds in the order in which they are applied
PATTERNS = {
    "email": (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    "phone": (r"(\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", "[PHONE]"),
    "ssn": (r"\d{3}[-\s]?\d{2}[-\s]?\d{4}", "[SSN]"),
    "credit_card": (r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}", "[CREDIT_CARD]"),
    "ip_address": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_ADDRESS]"),
}
#: What a text without the kind surely lacks, so that most texts are not searched.
HINTS = {"email": "@", "phone": "[0-9]{3}", "ssn": "[0-9]{3}", "credit_card": "[0-9]{4}", "ip_address": "[0-9]\\."}
# fixed values: titles before names, and what a name looks like
TITLES = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.")
NAME = r"\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"


def mask(text: Column, kinds: list[str] | None = None, with_mask: str | None = None) -> Column:
    """The kinds' patterns replaced one after the other, so an undelimited card number is masked as a phone number."""
    for kind in kinds or PATTERNS:
        pattern, own = PATTERNS[kind]
        text = let(text, _replaced(kind, pattern, with_mask or own))
    return text


def _replaced(kind: str, pattern: str, put: str):
    return lambda t: F.when(_may_have(t, kind), F.regexp_replace(t, pattern, put)).otherwise(t)


def _may_have(text: Column, kind: str) -> Column:
    hint = HINTS[kind]
    return F.contains(text, F.lit(hint)) if len(hint) == 1 else F.rlike(text, F.lit(hint))


def mask_nodes(df: DataFrame, kinds: list[str] | None = None, with_mask: str | None = None, store_original: bool = False) -> DataFrame:
    """Rows with their text masked; metadata keeps original_text and pii_masked of changed ones, if asked."""
    own = df.withColumn("__masked", mask(F.col("text"), kinds, with_mask))
    if store_original:
        changed = F.col("__masked") != F.col("text")
        notes = F.create_map(F.lit("original_text"), F.col("text"), F.lit("pii_masked"), F.lit("true"))
        held = F.map_filter("metadata", lambda k, v: ~k.isin("original_text", "pii_masked"))
        own = own.withColumn("metadata", F.when(changed, F.map_concat(held, notes)).otherwise(F.col("metadata")))
    return own.withColumn("text", F.col("__masked")).drop("__masked")


def has_pii(text: Column, kinds: list[str] | None = None) -> Column:
    found = F.lit(False)
    for kind in kinds or PATTERNS:
        found = found | F.rlike(text, F.lit(PATTERNS[kind][0]))
    return found


def drop_pii(df: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    return df.where(~F.coalesce(has_pii(F.col("text"), kinds), F.lit(False)))


def detect(df: DataFrame, key: str, kinds: list[str] | None = None) -> DataFrame:
    """(key, pii_type, value, start, end) of each match on the unmasked text; offsets are bytes. One pass over the rows."""
    one = "struct<pii_type:string,value:string,start:int,end:int>"

    def of(kind):
        pattern = PATTERNS[kind][0]

        def found(hits):
            gaps = F.slice(F.split("text", pattern, -1), F.lit(1), F.size(hits))
            steps = F.zip_with(gaps, hits, lambda gap, hit: F.octet_length(gap) + F.octet_length(hit))
            ends = running(steps, lambda x, y: x + y, F.lit(0))
            return F.zip_with(
                ends, hits, lambda end, hit: F.struct(F.lit(kind).alias("pii_type"), hit.alias("value"), (end - F.octet_length(hit)).alias("start"), end.alias("end"))
            )

        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        return F.when(_may_have(F.col("text"), kind), let(hits, found)).otherwise(F.array().cast(f"array<{one}>"))

    every = F.concat(*[of(k) for k in kinds or PATTERNS])
    return df.where(F.col("text").isNotNull()).select(key, F.explode(every).alias("h")).select(key, "h.*")


def names(text: Column) -> Column:
    """Titles followed by capitalised words."""
    found = [
        F.regexp_extract_all(text, F.lit(t.replace(".", r"\.") + NAME), F.lit(0))
        for t in TITLES
    ]
    return F.concat(*found)
