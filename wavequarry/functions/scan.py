"""Running values over long sequences: blocks of rows that follow each other, what each block hands on, and a second look within the blocks.

A window over a whole group puts the group into one task. Here the rows are dealt to blocks by ranges of their order, each block is
summed up in a row, the few rows of blocks are scanned, and a window then only spans a block.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Positions of a block where the order is a number without large gaps.
BLOCK = 1 << 18


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; below a fresh local one only where that setting is absent and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a shared folder")
        found = tempfile.mkdtemp(prefix="spark-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_blocks(df: DataFrame, *order: str) -> DataFrame:
    """``df`` stored with ``_block``: blocks rise with the order and are of about equal size, however the values are spread; equal values share one.

    There are as many as the session has shuffle partitions, so their number grows with what the cluster is set up for."""
    return stored(df.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()), "blocks")


def handed_on(rows: DataFrame, group: list[str], **values: tuple[Column, Column]) -> DataFrame:
    """A row per group and block with what all earlier blocks of the group hand on. values: name = (value of a block, over a window of blocks)."""
    blocks = rows.groupBy(*group, "_block").agg(*[v.alias(n) for n, (v, _) in values.items()])
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*group, "_block", *[over.over(before).alias(n) for n, (_, over) in values.items()])


def with_handed_on(rows: DataFrame, group: list[str], **values: tuple[Column, Column]) -> DataFrame:
    """``rows`` with the values that their block gets; groups may be null."""
    blocks = handed_on(rows, group, **values)
    keys = [*group, "_block"]
    renamed = blocks.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(renamed, same, "left").drop(*[f"_of_{k}" for k in keys])


def ranked(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """0-based place of each row in its group by ``order``, which has to tell the group's rows apart; in blocks by ranges of (group, order)."""
    rows = with_handed_on(range_blocks(df, *group, *order), group, _before=(F.count(F.lit(1)), F.sum("_before")))
    inside = F.row_number().over(Window.partitionBy(*group, "_block").orderBy(*order))
    return rows.withColumn(out, (F.coalesce("_before", F.lit(0)) + inside - 1).cast("long")).drop("_before", "_block")


def numbered(df: DataFrame, group: list[str], position: str, out: str, block: int = BLOCK) -> DataFrame:
    """0-based place of each row in its group by ``position``, a whole number without large gaps; in blocks of positions, without sorting a group."""
    rows = with_handed_on(df.withColumn("_block", F.floor(F.col(position) / block)), group, _before=(F.count(F.lit(1)), F.sum("_before")))
    inside = F.row_number().over(Window.partitionBy(*group, "_block").orderBy(position))
    return rows.withColumn(out, (F.coalesce("_before", F.lit(0)) + inside - 1).cast("long")).drop("_before", "_block")
