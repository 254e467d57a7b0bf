"""Splits, caps, epochs, shards and grids. Every draw is a seeded order by md5, the same in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavequarry.functions import scan
from wavequarry.functions.rank import exact_rank, seeded_key

SPLITS = {"train": 0.8, "val": 0.1, "test": 0.1}


def allocation(n: Column, ratios: dict[str, float], ties: str = "name") -> dict[str, Column]:
    """Largest-remainder sizes. Equal fractions favour the greatest name (``name``) or the first of the list (``order``)."""
    whole = sum(ratios.values())
    exact = {k: n * F.lit(r / whole) for k, r in ratios.items()}
    rest = n - sum((F.floor(x) for x in exact.values()), F.lit(0))
    rank = {k: v for v, k in enumerate(sorted(ratios, reverse=True) if ties == "name" else ratios)}
    out = {}
    for k, x in exact.items():
        ahead = F.lit(0)
        for other, y in exact.items():
            if other != k:
                fx, fy = x - F.floor(x), y - F.floor(y)
                ahead = ahead + ((fy > fx) | (fy == fx) & F.lit(rank[other] < rank[k])).cast("int")
        out[k] = (F.floor(x) + (ahead < rest).cast("int")).cast("long")
    return out


def stratified_split(df: DataFrame, stratum: str, key: str, ratios: dict[str, float] = SPLITS, seed: int = 42) -> DataFrame:
    """split: within each stratum, consecutive slices of a seeded permutation with largest-remainder sizes."""
    ranked = exact_rank(df.withColumn("_key", seeded_key(seed, "split", key)), [stratum], "_key", [key], "_rank", "_total")
    at, split = F.lit(0), F.lit(None).cast("string")
    cases = []
    for name, size in allocation(F.col("_total"), ratios).items():
        at = at + size
        cases.append((name, at))
    for name, end in reversed(cases):
        split = F.when(F.col("_rank") < end, F.lit(name)).otherwise(split)
    return ranked.withColumn("split", split).drop("_key", "_rank", "_total")


def capped(df: DataFrame, stratum: str, key: str, caps: dict[str, int], seed: int = 42, salt: str = "cap") -> DataFrame:
    """At most caps[stratum] rows of each stratum; strata without a cap pass whole."""
    cap = F.lit(None).cast("long")
    for name, n in caps.items():
        cap = F.when(F.col(stratum) == name, F.lit(n)).otherwise(cap)
    limited = df.where(F.col(stratum).isin(*caps)) if caps else df.limit(0)
    ranked = exact_rank(limited.withColumn("_key", seeded_key(seed, salt, key)), [stratum], "_key", [key], "_rank")
    return ranked.where(F.col("_rank") < cap).drop("_key", "_rank").unionByName(df.where(~F.col(stratum).isin(*caps)) if caps else df)


def dynamic_epoch(df: DataFrame, stratum: str, dominating: str, k: int, key: str, seed: int, epoch: int) -> DataFrame:
    """k fresh rows of the dominating stratum for each epoch, all others always."""
    return capped(df, stratum, key, {dominating: k}, seed + epoch, "epoch")


def fixed_subset(df: DataFrame, stratum: str, dominating: str, k: int, key: str, seed: int, salt: int) -> DataFrame:
    """k rows of the dominating stratum, the same in every epoch, and all others; place: their order by key."""
    chosen = capped(df, stratum, key, {dominating: k}, seed + salt, "subset")
    return scan.ranked(chosen, [], [key], "place")


def proportional(df: DataFrame, stratum: str, dominating: str, ratio: float, key: str, seed: int = 42) -> DataFrame:
    return capped(df, stratum, key, {dominating: proportional_cap(df.count(), ratio)}, seed)


def proportional_cap(total: int, ratio: float) -> int:
    """A share of the whole table, the dominating stratum included."""
    return int(ratio * total)


def sharded(df: DataFrame, key: str, world: int, seed: int, drop_last: bool = True) -> DataFrame:
    """rank_id of each row: stride over the seeded order, cut to a multiple of ``world`` or padded with its first rows."""
    ranked = global_rank(df, key, seed, "rank", "_pos")
    n = df.count()
    if drop_last:
        out = ranked.where(F.col("_pos") < n - n % world)
    else:
        pad = ranked.where(F.col("_pos") < (-n) % world).withColumn("_pos", F.col("_pos") + n)
        out = ranked.unionByName(pad)
    return out.withColumn("rank_id", (F.col("_pos") % world).cast("int")).drop("_pos")


def global_rank(df: DataFrame, key: str, seed: int, salt: str, out: str) -> DataFrame:
    return exact_rank(df.withColumn("_all", F.lit(0)).withColumn("_key", seeded_key(seed, salt, key)), ["_all"], "_key", [key], out).drop("_all", "_key")


def random_split(df: DataFrame, key: str, val: float, test: float, seed: int = 42) -> DataFrame:
    """Sizes rounded half to even; a split without rows is an error."""
    n = df.count()
    n_test, n_val = round(test * n), round(val * n)
    if n_test < 1 or n_val < 1 or n_test + n_val >= n:
        raise ValueError("a split would be empty")
    return global_rank(df, key, seed, "random", "_r").withColumn("split", F.when(F.col("_r") < n_test, "test").when(F.col("_r") < n_test + n_val, "val").otherwise("train")).drop("_r")


def leave_one_out(df: DataFrame, group: str, test: int, val: int | None = None, seed: int = 42) -> DataFrame:
    """One group for the test, a whole other one (given, or picked by seed) for validation."""
    if val is None:
        rest = df.where(F.col(group) != test).select(group).distinct().orderBy(seeded_key(seed, "val", group), group).limit(1).collect()
        if not rest:
            raise ValueError("no group is left for validation")
        val = rest[0][0]
    if val == test:
        raise ValueError("the same group can't be test and validation")
    return df.withColumn("split", F.when(F.col(group) == test, "test").when(F.col(group) == val, "val").otherwise("train"))


def leave_one_out_slice(df: DataFrame, group: str, test: int, key: str, val: float, seed: int = 42) -> DataFrame:
    """One group for the test, a seeded share of the other rows for validation (none at 0)."""
    pool = df.where(F.col(group) != test)
    n = round(val * pool.count())
    ranked = global_rank(pool, key, seed, "slice", "_r").withColumn("split", F.when(F.col("_r") < n, "val").otherwise("train")).drop("_r")
    return ranked.unionByName(df.where(F.col(group) == test).withColumn("split", F.lit("test")))


def balanced(df: DataFrame, subject: str, label: str, key: str, seed: int = 42) -> DataFrame:
    """Every class of a subject cut to the subject's smallest class."""
    least = df.groupBy(subject, label).agg(F.count(F.lit(1)).alias("_n")).groupBy(subject).agg(F.min("_n").alias("_least"))
    ranked = exact_rank(df.withColumn("_key", seeded_key(seed, "balance", key)), [subject, label], "_key", [key], "_rank")
    return ranked.join(least, subject).where("_rank < _least").drop("_key", "_rank", "_least")


def filled(shards: DataFrame, key: str, k: int, order: str) -> DataFrame:
    """The rows with enough fillers behind them to make the last shard whole. order: 0-based place of each row."""
    n = shards.count()
    deficit = (-n) % k
    rows = shards.withColumn("is_filler", F.lit(False))
    if not deficit or not n:
        return rows
    size = min(max(2 * deficit, 32), n)
    pool = shards.where(F.col(order) >= n - size).withColumn("_j", F.col(order) - (n - size))
    extra = pool.withColumn("_fill", F.explode(F.sequence(F.lit(0), F.lit(deficit - 1)))).where(F.col("_fill") % size == F.col("_j"))
    extra = extra.withColumn(key, F.concat(F.col(key), F.lit("__filler"), F.col("_fill"))).withColumn(order, F.lit(n) + F.col("_fill")).withColumn("is_filler", F.lit(True))
    return rows.unionByName(extra.select(*rows.columns))


def grid(spark, axes: dict[str, list]) -> DataFrame:
    """All combinations of the axes, numbered; one map of settings each. The axes are a configuration, not data."""
    out = spark.range(1).select(F.lit(0).cast("long").alias("combo"), F.create_map().cast("map<string,string>").alias("settings"))
    for name, values in axes.items():
        axis = spark.createDataFrame([(i, str(v)) for i, v in enumerate(values)], "i int, v string")
        out = out.crossJoin(F.broadcast(axis)).select((F.col("combo") * len(values) + F.col("i")).alias("combo"), F.map_concat("settings", F.create_map(F.lit(name), F.col("v"))).alias("settings"))
    return out


def view_crops(df: DataFrame, signal: str, key: str, width: int, ratios: list[float], seed: int) -> DataFrame:
    """Patch-aligned crops: of n patches round(ratio n), at least one, from a start drawn by hash."""
    views = F.array(*[F.struct(F.lit(i).alias("view"), F.lit(r).alias("ratio")) for i, r in enumerate(ratios)])
    out = df.withColumn("_n", F.floor(F.size(signal) / width).cast("int")).where("_n > 0").withColumn("_v", F.explode(views))
    out = out.withColumn("view", F.col("_v.view")).withColumn("patches", F.greatest(F.bround(F.col("_v.ratio") * F.col("_n")), F.lit(1)).cast("int"))
    noise = F.conv(F.substring(seeded_key(seed, "view", key, "view"), 1, 8), 16, 10).cast("long")
    out = out.withColumn("start", (noise % (F.col("_n") - F.col("patches") + 1)).cast("int"))
    return out.withColumn("crop", F.slice(signal, F.col("start") * width + 1, F.col("patches") * width)).drop("_n", "_v")


def shuffled_channels(df: DataFrame, signal: str, key: str, seed: int) -> DataFrame:
    order = F.array_sort(F.transform(signal, lambda c, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("channel"), F.col(key).cast("string"), i.cast("string")).cast("binary")).alias("k"), i.alias("i"), c.alias("c"))))
    return df.withColumn(signal, F.transform(order, lambda x: x["c"])).withColumn("channel_order", F.transform(order, lambda x: x["i"]))


#: Strategies and splits by name.
STRATEGIES = {"static": capped, "dynamic_epoch": dynamic_epoch, "proportional": proportional, "fixed": fixed_subset}
MODES = {"random": random_split, "grouped": leave_one_out, "slice": leave_one_out_slice}


def sample(df: DataFrame, strategy: str, **options) -> DataFrame:
    return STRATEGIES[strategy](df, **options)


def split(df: DataFrame, mode: str, **options) -> DataFrame:
    return MODES[mode](df, **options)

