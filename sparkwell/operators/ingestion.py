"""Ingestion: union of inputs, upserts, duplicates, deletions, a transform cache, refresh."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sparkwell.functions.text import document_hash


def inputs(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Documents and nodes as one table."""
    return documents.unionByName(nodes, allowMissingColumns=True)


def hashed(docs: DataFrame, own: Column | None = None) -> DataFrame:
    return docs.withColumn("hash", own if own is not None else document_hash(F.col("doc_id"), F.col("text")))


def upserts(new: DataFrame, stored: DataFrame, order: str | None = None) -> DataFrame:
    """`new` (doc_id, hash, ...) with status insert, update or skip against `stored` (doc_id, hash); the last row of an id wins."""
    w = Window.partitionBy("doc_id").orderBy(F.col(order).desc() if order else F.col("hash"))
    last = new.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    old = stored.select("doc_id", F.col("hash").alias("__old"))
    status = F.when(F.col("__old").isNull(), "insert").when(F.col("__old") != F.col("hash"), "update").otherwise("skip")
    return last.join(old, "doc_id", "left").withColumn("status", status).drop("__old")


def deletions(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored ids that the input no longer has."""
    return stored.select("doc_id").join(new.select("doc_id"), "doc_id", "left_anti")


def without_duplicates(new: DataFrame, stored: DataFrame, order: str = "doc_id") -> DataFrame:
    """Rows whose hash is neither stored nor seen earlier in the batch. The minimum is combined before the shuffle."""
    first = new.groupBy("hash").agg(F.min(order).alias(order))
    fresh = first.join(stored.select("hash").distinct(), "hash", "left_anti")
    return new.join(fresh, ["hash", order], "left_semi")


def run(
    new: DataFrame,
    stored: DataFrame,
    transforms: list[Callable[[DataFrame], DataFrame]],
    strategy: str = "upserts",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transformed rows, the store's hashes afterwards, ids to delete) by strategy upserts, duplicates_only or upserts_and_delete."""
    new = hashed(new) if "hash" not in new.columns else new
    gone = deletions(new, stored) if strategy == "upserts_and_delete" else stored.select("doc_id").limit(0)
    if strategy == "duplicates_only":
        work = without_duplicates(new, stored)
    elif strategy in ("upserts", "upserts_and_delete"):
        work = upserts(new, stored).where("status <> 'skip'").drop("status")
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    after = stored.join(work.select("doc_id"), "doc_id", "left_anti").join(gone, "doc_id", "left_anti")
    after = after.select("doc_id", "hash").unionByName(work.select("doc_id", "hash"))
    out = work
    for t in transforms:
        out = out.transform(t)
    return out, after, gone


def refresh(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """(doc_id, refreshed): whether each document is new or changed."""
    return upserts(hashed(docs), stored).select("doc_id", (F.col("status") != "skip").alias("refreshed"))


class Cache:
    """Transformed rows by input content and the transform's name and parameters, as tables under a folder."""

    def __init__(self, folder: str):
        self.folder = folder

    def path(self, df: DataFrame, name: str, parameters: dict) -> str:
        # the content's digest: an order-free sum of row hashes
        content = df.select(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
        key = repr((content.s, content.n, sorted(df.dtypes), name, sorted(parameters.items())))
        return f"{self.folder}/{hashlib.sha256(key.encode()).hexdigest()}"

    def through(self, df: DataFrame, transform: Callable[[DataFrame], DataFrame], name: str, **parameters) -> DataFrame:
        path = self.path(df, name, parameters)
        try:
            return df.sparkSession.read.parquet(path)
        except AnalysisException:
            transform(df).write.mode("overwrite").parquet(path)
            return df.sparkSession.read.parquet(path)
