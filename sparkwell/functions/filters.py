"""Metadata filters as boolean columns: the declared operators, and/or/not, nesting."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    key: str
    value: Any = None
    op: str = "=="


@dataclass(frozen=True)
class Filters:
    filters: tuple = field(default_factory=tuple)
    condition: str = "and"


def _text(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _compare(held: Column, op: str, value: Any) -> Column:
    if isinstance(value, int | float) and not isinstance(value, bool):
        held, value = held.try_cast("double"), F.lit(float(value))
    else:
        value = F.lit(_text(value))
    return {">": held > value, "<": held < value, ">=": held >= value, "<=": held <= value}[op]


def _one(f: Filter, metadata: Column) -> Column:
    held = F.get(F.array(F.try_element_at(metadata, F.lit(f.key))), 0)
    parts = F.from_json(held, "array<string>")
    array = F.coalesce(parts, F.split(held, r",\s*"))
    if f.op == "==":
        out = held == _text(f.value)
    elif f.op == "!=":
        out = held != _text(f.value)
    elif f.op in (">", "<", ">=", "<="):
        out = _compare(held, f.op, f.value)
    elif f.op == "in":
        out = held.isin([_text(v) for v in f.value])
    elif f.op == "nin":
        out = ~held.isin([_text(v) for v in f.value])
    elif f.op == "any":
        out = F.arrays_overlap(array, F.array(*[F.lit(_text(v)) for v in f.value]))
    elif f.op == "all":
        out = F.size(F.array_except(F.array(*[F.lit(_text(v)) for v in f.value]), array)) == 0
    elif f.op == "text_match":
        out = F.contains(held, F.lit(_text(f.value)))
    elif f.op == "text_match_insensitive":
        out = F.contains(F.lower(held), F.lit(_text(f.value).lower()))
    elif f.op == "contains":
        out = F.array_contains(array, _text(f.value))
    elif f.op == "is_empty":
        return F.coalesce(held, F.lit("")) == ""
    else:
        raise ValueError(f"unknown filter operator {f.op!r}")
    return F.coalesce(out, F.lit(False))  # a missing key matches nothing


def matches(f: Filter | Filters, metadata: Column) -> Column:
    if isinstance(f, Filter):
        return _one(f, metadata)
    parts = [matches(x, metadata) for x in f.filters]
    if f.condition == "not":
        out = F.lit(False)
        for p in parts:
            out = out | p
        return ~out
    out = F.lit(f.condition == "and" or not parts)
    for p in parts:
        out = (out & p) if f.condition == "and" else (out | p)
    return out


def equal_to(pairs: dict[str, Any], metadata: Column) -> Column:
    """AND of equalities, the stores' own form."""
    return matches(Filters(tuple(Filter(k, v) for k, v in pairs.items())), metadata)


def restricted(ids: list[str] | None, column: Column) -> Column:
    """To the listed ids; None is no restriction."""
    return F.lit(True) if ids is None else column.isin(list(ids))
