"""Seeded order and exact ranks that no single task has to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_key(seed: int, salt: str, *cols: str | Column) -> Column:
    """Sort key of a seeded permutation: md5 of seed, salt and the row's key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]).cast("binary"))


def exact_rank(df: DataFrame, partition: list[str], key: str, tie: list[str], out: str = "rank", total: str | None = None) -> DataFrame:
    """0-based rank by (key, tie) within each partition, key being hexadecimal; on request with the partition's number of rows.

    Rows are ranked within the 4096 buckets of the key's first digits; the buckets' counts, at most 4096 a partition, give the
    offsets. A partition that holds most of the table is thus spread over many tasks.
    """
    df = df.withColumn("_bucket", F.substring(key, 1, 3))
    counts = df.groupBy(*partition, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*partition).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy(*partition)))
    offsets = offsets.drop("_n")
    inside = Window.partitionBy(*partition, "_bucket").orderBy(key, *tie)
    ranked = df.withColumn("_in", F.row_number().over(inside)).join(offsets, [*partition, "_bucket"])
    return ranked.withColumn(out, (F.col("_before") + F.col("_in") - 1).cast("long")).drop("_bucket", "_in", "_before")
