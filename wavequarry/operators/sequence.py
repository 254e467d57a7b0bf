"""Order-dependent operators: transitions, cuts, ranks, masks, folds and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavequarry.functions import scan
from wavequarry.functions.rank import seeded_key


def transitions(df: DataFrame, group: list[str], order: list[str], label: str, invalid: Column) -> DataFrame:
    """pos and changed: a valid row whose label differs from the last valid one before; never the first row. A first
    valid row behind invalid ones counts as changed.

    A group may hold most rows: blocks of it by ranges of the order hand on their number of rows and their last valid label."""
    df = df.withColumn("_v", F.when(~invalid, F.col(label)))
    rows = scan.range_blocks(df, *group, *order)
    place = F.struct(*order)
    rows = scan.with_handed_on(rows, group, _rows=(F.count(F.lit(1)), F.sum("_rows")), _label=(F.max_by("_v", F.when(F.col("_v").isNotNull(), place)), F.last("_label", ignorenulls=True)))
    w = Window.partitionBy(*group, "_block").orderBy(*order)
    rows = rows.withColumn("pos", (F.coalesce("_rows", F.lit(0)) + F.row_number().over(w) - 1).cast("long"))
    before = F.coalesce(F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_label")
    changed = F.col("_v").isNotNull() & (F.col("pos") > 0) & ~F.col("_v").eqNullSafe(F.col("_before"))
    return rows.withColumn("_before", before).withColumn("changed", changed).drop("_v", "_before", "_rows", "_label", "_block")


def cut_transients(df: DataFrame, group: list[str], cut: int, block: int = scan.BLOCK) -> DataFrame:
    """Without the ``cut`` rows from each change on. A change only reaches ``cut`` rows ahead, so a window spans a block of positions and the
    changes that reach into it."""
    block = max(block, cut)
    rows = df.withColumn("_block", F.floor(F.col("pos") / block)).withColumn("_own", F.lit(True))
    reaching = rows.where(F.col("changed") & (F.col("pos") % block > block - cut)).withColumns({"_block": F.col("_block") + 1, "_own": F.lit(False)})
    w = Window.partitionBy(*group, "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("changed"), F.col("pos")), ignorenulls=True).over(w)
    cut_out = rows.unionByName(reaching).withColumn("_last", last).where(F.col("_own") & (F.col("_last").isNull() | (F.col("pos") - F.col("_last") >= cut)))
    return cut_out.drop("_block", "_own", "_last")


def cut_length(ms: float, fs: float) -> int:
    return max(round(ms / 1000 * fs), 1)


def first_per_key(df: DataFrame, keys: list[str], order: list[str], k: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def fold_rotation(ids: DataFrame, key: str) -> DataFrame:
    """(test, val): val is the next id in the sorted cycle; needs two ids. The ids are few."""
    out = ids.select(F.col(key).alias("test")).withColumn("val", F.coalesce(F.lead("test").over(Window.orderBy("test")), F.min("test").over(Window.orderBy("test").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return out.where("test <> val")


def token_mask(tokens: DataFrame, ratio: float, seed: int) -> DataFrame:
    """masked and restore: of the valid tokens of an owner, the round((1 - ratio) n) first by noise, at least one, are kept."""
    noise = seeded_key(seed, "mask", "owner_id", "pos")
    own = Window.partitionBy("owner_id")
    df = tokens.withColumn("_n", F.sum(F.col("valid").cast("int")).over(own)).withColumn("_noise", noise)
    df = df.withColumn("_rank", F.row_number().over(own.orderBy(F.col("valid").desc(), "_noise")) - 1)
    kept = F.greatest(F.bround((1 - ratio) * F.col("_n")), F.lit(1))
    return df.withColumn("masked", ~(F.col("valid") & (F.col("_rank") < kept))).withColumn("restore", F.col("_rank").cast("int")).drop("_n", "_noise", "_rank")


def natural_key(name: Column) -> list[Column]:
    return [F.coalesce(F.regexp_extract(name, r"(\d+)$", 1).try_cast("long"), F.lit(1 << 62)), name]


def filler_pool(df: DataFrame, deficit: Column, order: list[str], partition: list[str]) -> DataFrame:
    """The last min(max(2 deficit, 32), n) rows of each partition's order."""
    w = Window.partitionBy(*partition).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("pool_rank", F.row_number().over(w) - 1).where(F.col("pool_rank") < F.greatest(2 * deficit, F.lit(32)))
