"""Documents to packed training sequences, by five of the operators in sparkwell.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwell.llm import decontamination, langid, near_duplicates, packing, secrets
from sparkwell.llm.common import cut
from sparkwell.llm.queries import table, tokenizer_file


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be determined; a null lang becomes the predicted language.

    These are null texts, texts without a letter, and texts whose best language is less likely than the others together.
    The model is fitted on a bounded sample of the labelled documents of this input that are not held out; where none is
    labelled, all texts with a letter stay. Each row is judged by its text only, so repeated rows and rows without doc_id
    are like others; an empty table stays empty; more columns stay as they are.
    """
    return langid.identified(docs, langid.train(docs.where(~langid.is_held_out())))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest doc_id.

    Rows that repeat both doc_id and text count as one. Rows without doc_id can't be told apart and stay. Empty texts are
    no duplicates of one another; an empty table stays empty; more columns stay as they are.
    """
    found = near_duplicates.near_duplicates(docs)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("__kept_id"), "left_semi")
    again = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    once = named.withColumn("__again", F.row_number().over(again)).where("__again = 1").drop("__again")
    return once.unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item or a re-parameterised one.

    Each row is judged by its own text, whatever shares its doc_id or has none too; null and empty texts stay; an empty
    table or benchmark drops nothing; more columns stay as they are.
    """
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by their kind; every document stays. n_chars follows the text.

    Null and empty texts, repeated rows and rows without doc_id stay; an empty table stays empty; more columns stay as
    they are.
    """
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of at most 2048; a row for each piece, as packing.pack() returns them.

    A null text is empty and has its closing id all the same; repeated rows are packed each, rows without doc_id too; an
    empty table gives no rows; more columns are not read.
    """
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]
#: SQL has neither the classifier nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each computed once and cut from its predecessors."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
