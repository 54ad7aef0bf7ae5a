"""Hooks for models: text to text, and text to vector, in Arrow batches. The defaults are deterministic stand-ins."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ModelFn = Callable[[pd.Series], pd.Series]


def model(fn: ModelFn, retries: int = 0, wait: float = 1.0):
    """A column function of a batch function; a failing batch is tried again so many times."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        for attempt in range(retries + 1):
            try:
                return fn(prompts)
            except Exception:
                if attempt == retries:
                    raise
                time.sleep(wait)
        raise AssertionError

    return run


def echo(prompt: Column) -> Column:
    """The stand-in for a model: its prompt."""
    return prompt


def fixed(answer: str) -> Callable[[Column], Column]:
    return lambda prompt: F.when(prompt.isNotNull(), F.lit(answer))


def hash_embedding(dimension: int = 128):
    """v[i mod dimension] += code point / 1000, i being the character's byte offset."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v, at = [0.0] * dimension, 0
            for c in t or "":
                v[at % dimension] += ord(c) / 1000.0
                at += len(c.encode())
            out.append(v)
        return pd.Series(out)

    return run


def embedding(fn: Callable[[pd.Series], pd.Series]):
    """A column function of a batch function from texts to lists of numbers."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return fn(texts)

    return run
