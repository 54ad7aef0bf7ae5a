"""What the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, by: Column, tie: str, partition: str = "query_id", rank: str = "rank") -> DataFrame:
    """The k best rows of each partition, best first; ties by ascending `tie`. Ranks start at 1."""
    order = Window.partitionBy(partition).orderBy(by.desc_nulls_last(), F.col(tie))
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def ordered_list(value: Column, position: Column) -> Column:
    """Aggregate: values in the order of their positions."""
    return F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), value.alias("v")))), lambda x: x["v"])


def small_side(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """`df` broadcast if it has at most `limit` rows (it is counted), else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ranges(df: DataFrame, order: str, sample: int = 4_000) -> tuple[DataFrame, int]:
    """`df` with __part: which of the returned number of ranges of `order` a row is in (null: the first).

    Bounds come from the `sample` values with the smallest hashes, sorted on the driver, so they are the same whenever
    a task is repeated.
    """
    spark = df.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = df.select(order).where(F.col(order).isNotNull()).distinct().orderBy(F.xxhash64(order)).limit(sample).collect()
    values = sorted(r[0] for r in some)
    bounds = sorted({values[i * len(values) // n] for i in range(1, n)}) if values else []
    if not bounds:
        return df.withColumn("__part", F.lit(0)), 1
    step = max(1, int(len(bounds) ** 0.5))
    array = lambda x: F.array(*[F.lit(v) for v in x]).cast(f"array<{df.schema[order].dataType.simpleString()}>")
    below = lambda a: F.size(F.filter(a, lambda x: x <= F.col(order)))
    rows = df.withColumn("__block", F.when(F.col(order).isNull(), 0).otherwise(below(array(bounds[step - 1 :: step])) * step))
    part = F.col("__block") + below(F.slice(array(bounds), F.col("__block") + 1, F.lit(step)))
    return rows.withColumn("__part", F.when(F.col(order).isNull(), 0).otherwise(part)).drop("__block"), len(bounds) + 1


def numbered(df: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """`df` with 0, 1, ... in ascending order of `order` (nulls first; of equals, in any order).

    Rows are numbered inside ranges and the ranges' sizes, a few numbers on the driver, are added: no task orders all rows.
    """
    rows, n = ranges(df, order)
    sizes = {r["__part"]: r["count"] for r in rows.groupBy("__part").count().collect()}
    before, total = [], 0
    for p in range(n):
        before.append(total)
        total += sizes.get(p, 0)
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order)).cast("long") - 1
    first = F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col("__part"))
    return rows.withColumn(name, inside + first).drop("__part")
