"""What the corpus operators share: the checkpoint folder and small column helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.functions.arrays import let, running, runs  # noqa: F401  shared with the operators here


def shared_folder(spark: SparkSession) -> str:
    """The folder in which lineage is cut: the session's own, or on a single machine a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="sparkwell-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the shared folder, so that a lost executor costs no recomputation.

    The driver then collects its garbage: a long row of small jobs else lets its heap grow to its limit, and shuffles and
    checkpoints that nothing refers to any more stay on disk.
    """
    shared_folder(df.sparkSession)
    done = df.checkpoint()
    df.sparkSession.sparkContext._jvm.System.gc()
    return done


#: Rows of a few numbers each up to which a table is broadcast.
FEW = 500_000


def few(df: DataFrame, most: int | None = None) -> DataFrame:
    """`df`, to be joined: broadcast if it has at most `most` rows, FEW by default (it is counted), else as it is."""
    most = FEW if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def whole_text(column: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))
