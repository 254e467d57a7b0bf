"""Filters, predicates, labels and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INVALID = (-2147483648, -9223372036854775808)
#: fixed values: synonyms of label names
SYNONYMS = {"rotopen2": "rotopen", "start": "rest", "pour": "front"}


def keep_channel(channel: Column, keep: list[int] | None = None, exclude: list[int] = ()) -> Column:
    """A keep-list overrides the exclude-list."""
    return channel.isin(*keep) if keep is not None else ~channel.isin(*exclude) if exclude else F.lit(True)


def base_dataset(source: Column) -> Column:
    return F.substring_index(source, "::", 1)


def valid_waveform(cells: Column, length: int) -> Column:
    """No channel cell is null, of another length or has NaN."""
    return ~F.exists(cells, lambda c: F.coalesce(c.isNull() | (F.size(c) != length) | F.exists(c, lambda v: v.isNull() | F.isnan(v)), F.lit(True)))


def invalidate(df: DataFrame, label: str, carried: list[str]) -> DataFrame:
    """An invalid label turns the label and all carried columns into -1."""
    bad = F.col(label).isin(*INVALID)
    return df.withColumns({c: F.when(bad, F.lit(-1).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in [label, *carried]})


def vocabulary(df: DataFrame, label: str) -> DataFrame:
    """Sorted distinct labels with 0-based ids. The labels are few; the rows are not ranked."""
    return df.select(label).where(F.col(label).isNotNull()).distinct().withColumn("label_id", F.row_number().over(Window.orderBy(label)) - 1)


def encode_labels(df: DataFrame, label: str, vocab: DataFrame, synonyms: dict[str, str] = SYNONYMS) -> DataFrame:
    """Renames synonyms and joins the vocabulary; unknown labels fall out."""
    name = F.col(label)
    for old, new in synonyms.items():
        name = F.when(F.col(label) == old, F.lit(new)).otherwise(name)
    return df.withColumn(label, name).join(vocab, label)


def exclude(df: DataFrame, *tables: tuple[DataFrame, list[str]]) -> DataFrame:
    """Rows that match none of the exclusion tables."""
    for rows, keys in tables:
        df = df.join(rows, keys, "left_anti")
    return df


def session_id(patient: Column, token: Column) -> Column:
    """Globally unique session: patient * 100 + the token's digits (``session2_1`` is 21)."""
    return patient * 100 + F.regexp_replace(token, r"\D", "").try_cast("int")


def sample_id(*parts: Column) -> Column:
    return F.concat_ws("/", *[p.cast("string") for p in parts])


def with_params(signals: DataFrame, params: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Left join of the parameters by base dataset; a missing one has its default."""
    out = signals.join(params, "base_dataset", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def merge_counters(kept: DataFrame, discarded: DataFrame, keys: list[str]) -> DataFrame:
    out = kept.join(discarded, keys, "full")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("kept", "discarded")})


def without_fillers(rows: DataFrame, skip: Column | bool = True) -> DataFrame:
    """Rows that only fill shards go where ``skip`` holds (validation by default; training may keep them)."""
    skip = F.lit(skip) if isinstance(skip, bool) else skip
    return rows.where(~(F.coalesce(F.col("is_filler"), F.lit(False)) & skip))


#: Where a truncation may cut.
CUTS = ("left", "right", "center")


def config_rules(filtered: bool) -> dict[str, Column]:
    """What a row of parameters has to meet: samples_per_shard, batch_size, train, val, test, tx_fc_hz, rf_bandwidth_fraction,
    truncate_signal_length, truncate_signal_mode, interpolation_truncate_mode. filtered: whether a filtered format is written."""
    given = lambda c, ok: F.col(c).isNull() | ok
    rules = {
        "shard": (F.col("batch_size") > 0) & (F.col("samples_per_shard") % F.col("batch_size") == 0),
        "ratios": F.abs(F.col("train") + F.col("val") + F.col("test") - 1) < 1e-6,
        "bandwidth": given("rf_bandwidth_fraction", (F.col("rf_bandwidth_fraction") > 0) & (F.col("rf_bandwidth_fraction") <= 1)),
        "length": given("truncate_signal_length", F.col("truncate_signal_length") > 0),
        "mode": given("truncate_signal_length", given("truncate_signal_mode", F.lower("truncate_signal_mode").isin(*CUTS))),
        "interpolation": given("interpolation_truncate_mode", F.lower("interpolation_truncate_mode").isin(*CUTS)),
    }
    return rules | ({"centre": F.col("tx_fc_hz").isNotNull() & (F.col("tx_fc_hz") > 0)} if filtered else {})


def violations(params: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for every rule that a row of the table breaks."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return params.withColumn("rule", F.explode(F.array_compact(broken)))


def coerce_targets(targets: Column, k: int) -> Column:
    return F.when(F.size(targets) == k, F.transform(targets, lambda v: v.cast("float"))).otherwise(F.raise_error(F.lit(f"a label vector must have {k} values")))


def complement(df: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    for o in others:
        df = df.join(o.select(key), key, "left_anti")
    return df
