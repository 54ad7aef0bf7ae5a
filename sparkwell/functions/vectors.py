"""Vector arithmetic on array columns. Lengths that differ, and zero vectors, give null (strict) or 0 (lenient)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if the lengths differ."""
    own = _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))
    return F.when(F.size(a) == F.size(b), own)


def magnitude(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def cosine_strict(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero or empty vector or different lengths."""
    norm = magnitude(a) * magnitude(b)
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector or different lengths."""
    return F.coalesce(cosine_strict(a, b), F.lit(0.0))


def euclidean_distance(a: Column, b: Column) -> Column:
    own = _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))
    return F.when(F.size(a) == F.size(b), F.sqrt(own))


def euclidean_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + distance)."""
    return F.lit(1.0) / (F.lit(1.0) + euclidean_distance(a, b))


def negative_distance(a: Column, b: Column) -> Column:
    """-distance, minus infinity for different lengths; the evaluators' form."""
    return F.coalesce(-euclidean_distance(a, b), F.lit(float("-inf")))


METRICS = {
    "cosine": cosine,
    "dot_product": lambda a, b: F.coalesce(dot(a, b), F.lit(0.0)),
    "euclidean": euclidean_similarity,
    "negative_distance": negative_distance,
}


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """By the metric's name; an unknown name means cosine."""
    return METRICS.get(metric, cosine)(a, b)


def normalize(v: Column) -> Column:
    """Unit vector; null for a zero vector."""
    return F.when(magnitude(v) > 0, F.transform(doubles(v), lambda x: x / magnitude(v)))


def add(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(doubles(a), doubles(b), lambda x, y: x + y))


def subtract(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(doubles(a), doubles(b), lambda x, y: x - y))


def scale(v: Column, by: float) -> Column:
    return F.transform(doubles(v), lambda x: x * F.lit(float(by)))


def mean(df: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """(key, dimension, embedding): the element-wise mean of each key's vectors; vectors must have one length.

    Positions are averaged before vectors are put together, so no key's vectors meet in one row.
    """
    own = df.where(F.col(embedding).isNotNull()).select(key, F.size(embedding).alias("dimension"), F.posexplode(doubles(F.col(embedding))).alias("pos", "x"))
    means = own.groupBy(key, "pos").agg(F.avg("x").alias("x"), F.min("dimension").alias("lo"), F.max("dimension").alias("hi"))
    entry = F.array_sort(F.collect_list(F.struct("pos", "x")))
    made = means.groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("dimension"), entry.alias("e"))
    same = F.when(F.col("lo") == F.col("dimension"), F.transform("e", lambda p: p["x"]))
    return made.select(key, "dimension", F.coalesce(same, F.raise_error(F.lit("vectors of different lengths")).cast("array<double>")).alias("embedding"))


def to_sparse(v: Column, threshold: float = 0.0) -> Column:
    """struct(indices, values, dimension) of the entries whose size exceeds the threshold."""
    pairs = F.filter(
        F.transform(doubles(v), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: F.abs(p["x"]) > threshold
    )
    return F.struct(
        F.transform(pairs, lambda p: p["i"]).alias("indices"),
        F.transform(pairs, lambda p: p["x"]).alias("values"),
        F.size(v).alias("dimension"),
    )


def to_dense(s: Column) -> Column:
    """Array of `dimension` doubles of a sparse struct; without a dimension, the largest index decides."""
    size = F.when(s["dimension"] > 0, s["dimension"]).otherwise(F.coalesce(F.array_max(s["indices"]) + 1, F.lit(0)))
    at = lambda i: F.coalesce(F.get(s["values"], (F.array_position(s["indices"], i) - 1).cast("int")), F.lit(0.0))
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), at)).otherwise(F.array().cast("array<double>"))


def sparse_get(s: Column, index: Column) -> Column:
    """Value at an index, 0 where there is none."""
    place = F.array_position(s["indices"], index)
    return F.when(place > 0, F.get(s["values"], (place - 1).cast("int"))).otherwise(F.lit(0.0))


def sparse_dot(a: Column, b: Column) -> Column:
    entries = F.arrays_zip(a["indices"].alias("i"), a["values"].alias("x"))
    return F.aggregate(entries, F.lit(0.0), lambda t, e: t + e["x"] * sparse_get(b, e["i"]))


def sparse_cosine(a: Column, b: Column) -> Column:
    norm = magnitude(a["values"]) * magnitude(b["values"])
    return F.when(norm > 0, sparse_dot(a, b) / norm).otherwise(F.lit(0.0))


def sparse_normalize(s: Column) -> Column:
    norm = magnitude(s["values"])
    values = F.when(norm > 0, F.transform(s["values"], lambda x: x / norm)).otherwise(s["values"])
    return F.struct(s["indices"].alias("indices"), values.alias("values"), s["dimension"].alias("dimension"))


def sparse_add(a: Column, b: Column) -> Column:
    indices = F.array_sort(F.array_union(a["indices"], b["indices"]))
    return F.struct(
        indices.alias("indices"),
        F.transform(indices, lambda i: sparse_get(a, i) + sparse_get(b, i)).alias("values"),
        F.greatest(a["dimension"], b["dimension"]).alias("dimension"),
    )


def hybrid_similarity(dense_a: Column, dense_b: Column, sparse_a: Column, sparse_b: Column, alpha: float) -> Column:
    """alpha * dense cosine + (1 - alpha) * sparse cosine."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    return F.lit(alpha) * cosine(dense_a, dense_b) + F.lit(1 - alpha) * sparse_cosine(sparse_a, sparse_b)
