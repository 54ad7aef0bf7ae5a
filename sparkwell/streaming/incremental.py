"""Incremental ingestion: new files or rows as a stream, merged into a store batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkwell.operators.ingestion import hashed, upserts
from sparkwell.operators.stores import Table


def csv_stream(spark: SparkSession, folder: str, columns: list[str], header: bool = True) -> DataFrame:
    """Rows of arriving CSV files as documents (doc_id, path, text, metadata) of all columns.

    A stream doesn't number a file's rows, so a row's id is its file's path and the digest of its text.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.readStream.schema(schema).csv(folder, header=header, ignoreLeadingWhiteSpace=True)
    cells = [F.concat(F.lit(f"{c}: "), F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))) for c in columns]
    own = df.select(F.col("_metadata.file_path").alias("path"), F.concat_ws("\n", *cells).alias("text"), *[F.col(f"`{c}`") for c in columns])
    held = F.map_filter(F.create_map(*[x for c in ["path", *columns] for x in (F.lit(c), F.col(f"`{c}`"))]), lambda k, v: v.isNotNull())
    doc_id = F.concat("path", F.lit("_row_"), F.md5(F.col("text").cast("binary")))
    return own.select(doc_id.alias("doc_id"), "path", "text", held.alias("metadata"))


def ingest_stream(docs: DataFrame, store: Table, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Upserts a stream of (doc_id, text) into a store with doc_id, text and hash; a batch that is repeated changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        new = upserts(hashed(batch), store.read().select("doc_id", "hash")).where("status <> 'skip'").drop("status")
        new = transform(new) if transform else new
        store.upsert(new, ["doc_id"])

    return docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: events by type in tumbling windows with a watermark, for batches and streams."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = own.groupBy(F.window("ts", every).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
