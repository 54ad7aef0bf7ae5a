"""Weighted rendezvous hashing of stable record keys (law `key`), DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.llm.common import whole_text

#: Rows of one shard are numbered in so many independent parts.
PARTS = 256
#: Copies of one row that one task writes out.
BLOCK = 4096


def _score(key: Column, shard: int, weight: float) -> Column:
    # 52 bits of the hash as a fraction in (0, 1); -w / ln(u) is the weighted rendezvous score
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12)
    return F.lit(-float(weight)) / F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52)))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (its index in `weights`) with the highest score for `key`; ties go to the lowest index.

    A shard of weight 0 gets nothing. Adding a shard moves only the keys that the new shard wins.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a positive weight")
    scores = [F.struct(_score(key, i, w).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return (-F.array_max(F.array(*scores))["shard"]).cast("int")


def shard_documents(
    docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None, parts: int = PARTS
) -> DataFrame:
    """Every row of `docs` with its shard, its place there and its shard after one more shard is added.

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law (`key`), shard, slot (0, 1, ... in
    each shard without gaps) and grown_shard. A null text has no bytes, a null doc_id is a key like any other,
    repeated rows each get a slot, an empty table gives an empty result; other columns are ignored.

    Equal rows are counted before the shuffle, so a repeated row costs its partition one row; its copies are dealt out
    again in blocks. A very long text counts by its size and checksum only. Slots come from a
    numbering inside `parts` parts of each shard and the parts' offsets (shards * parts rows, hence broadcast),
    so no shard is ever sorted by one task.
    """
    weights = [1.0] * shards if weights is None else list(weights)
    grown = [*weights, max(weights)]
    text = whole_text()
    rows = (
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("shard", rendezvous(F.col("doc_id"), weights))
        .withColumn("grown_shard", rendezvous(F.col("doc_id"), grown))
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(parts)).cast("int"))
    )
    counts = rows.groupBy("shard", "part").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = (
        Window.partitionBy("shard", "part")
        .orderBy("doc_id", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.withColumn("earlier", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    # a row with very many copies is dealt to several tasks before it is written out
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(BLOCK).cast("long")))
    return (
        placed.join(F.broadcast(offsets), ["shard", "part"])
        .withColumn("block", block)
        .repartition("doc_id", "text_crc32", "block")
        .withColumn("copy", F.explode(F.sequence("block", F.least(F.col("block") + BLOCK, F.col("copies")) - 1)))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("offset") + F.col("earlier") + F.col("copy")).alias("slot"),
            "grown_shard",
        )
    )
