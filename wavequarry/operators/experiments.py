"""Experiment tables: metric logs, rankings, pruning, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_epoch(logs: DataFrame, keys: list[str], epoch: str, line: str, metric: str) -> DataFrame:
    """The metric of the last epoch of each run, among rows that have one; a missing epoch is that of the row before, ties go to the later row."""
    w = Window.partitionBy(*keys).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    rows = logs.withColumn("_e", F.coalesce(F.max(epoch).over(w), F.lit(-1.0))).where(F.col(metric).isNotNull())
    return rows.groupBy(*keys).agg(F.max_by(metric, F.struct("_e", line)).alias(metric))


def group_summary(runs: DataFrame, group: str, metric: str, sample: bool = False) -> DataFrame:
    spread = F.coalesce(F.stddev_samp(metric), F.lit(0.0)) if sample else F.stddev_pop(metric)
    return runs.groupBy(group).agg(F.round(F.avg(metric), 6).alias("mean"), F.round(spread, 6).alias("std"), F.count(metric).alias("n_runs"))


def ranked_groups(summary: DataFrame) -> DataFrame:
    """Groups by falling mean. One row a group."""
    return summary.withColumn("place", F.dense_rank().over(Window.orderBy(F.desc("mean"))))


def reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that a combination breaks, or null."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(broken, F.lit(name)).otherwise(out)
    return out


def incompatible() -> list[tuple[str, Column]]:
    """Combinations that repeat another one of a sweep, from the columns unfreezing, lora, frozen (booleans) and decay."""
    unfreezing, lora, frozen, decays = (F.coalesce(c, F.lit(False)) for c in (F.col("unfreezing"), F.col("lora"), F.col("frozen"), F.col("decay") > 0))
    return [
        ("unfreezing of a frozen encoder", unfreezing & frozen),
        ("unfreezing with adapters", unfreezing & lora),
        ("adapters of a frozen encoder", lora & frozen),
        ("adapters with a decay", lora & decays),
        ("a frozen encoder with a decay", frozen & decays),
    ]


def folds(configs: DataFrame, ids: DataFrame, corpus: str) -> DataFrame:
    """Each configuration with every fold of its own corpus."""
    return configs.join(ids, corpus)
