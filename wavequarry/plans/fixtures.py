"""Views over the given tables that stand for signals, frames, tokens, predictions and metric logs; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rate(key: str) -> Column:
    k = F.col(key) % 5
    return F.when(k == 0, 8e6).when(k == 1, 12e6).when(k == 2, 20e6).when(k == 3, 40.96e6)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal per user and event type."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("signal"))
    return rows.select(F.concat_ws(":", "user_id", "event_type").alias("sample_id"), F.concat("event_type", F.lit("::s"), F.col("user_id") % 3).alias("source_dataset"), F.col("event_type").alias("base_dataset"), (F.col("user_id") % 8).cast("int").alias("channel_idx"), rate("user_id").cast("double").alias("fs"), "signal")


SIG = """sig AS (SELECT user_id || ':' || event_type AS sample_id, event_type || '::s' || (user_id % 3) AS source_dataset, event_type AS base_dataset,
  (user_id % 8)::INT AS channel_idx, (CASE user_id % 5 WHEN 0 THEN 8e6 WHEN 1 THEN 12e6 WHEN 2 THEN 20e6 WHEN 3 THEN 40.96e6 END)::DOUBLE AS fs,
  list(value ORDER BY ts, event_id) AS signal FROM events GROUP BY user_id, event_type)"""
SAMPLES = SIG + """, smp AS (SELECT sample_id, source_dataset, base_dataset, channel_idx, fs, len(signal)::INT AS n,
  unnest(signal) AS v, generate_subscripts(signal, 1) - 1 AS pos FROM sig)"""


def long_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long signals: the quantities of a supplier."""
    c = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x["l_quantity"]).alias("signal"))
    return rows.select(F.col("l_suppkey").alias("sample_id"), rate("l_suppkey").cast("double").alias("fs"), "signal")


LONG = """sig AS (SELECT l_suppkey AS sample_id, (CASE l_suppkey % 5 WHEN 0 THEN 8e6 WHEN 1 THEN 12e6 WHEN 2 THEN 20e6 WHEN 3 THEN 40.96e6 END)::DOUBLE AS fs,
  list(l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS signal FROM lineitem GROUP BY l_suppkey)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four channels of sixteen samples."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("frame_id"), F.array(*[F.slice("embedding", 16 * c + 1, 16) for c in range(4)]).alias("signal"), "label", (1 + F.col("vec_id") % 6).alias("session_id"), (F.col("vec_id") % 4).alias("patient_id"))


FRAMES = """frm AS (SELECT vec_id AS frame_id, ((i - 1) // 16)::INT AS channel, ((i - 1) % 16)::INT AS pos, embedding[i]::DOUBLE AS v, label, 1 + vec_id % 6 AS session_id, vec_id % 4 AS patient_id
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select(F.col("frame_id").alias("owner_id"), F.posexplode("signal").alias("pos", "vec"))
    return f.withColumn("valid", (F.col("owner_id") + F.col("pos")) % 5 != 0)


TOKENS = FRAMES + ", tok AS (SELECT frame_id AS owner_id, channel AS pos, pos AS dim, v, (frame_id + channel) % 5 <> 0 AS valid FROM frm)"


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("grp"), (F.col("o_custkey") % 6).alias("run"), F.col("o_orderkey").alias("line_no"), F.when(F.col("o_orderkey") % 7 != 0, F.month("o_orderdate").cast("double")).alias("epoch"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 1e6).alias("acc"))


LOGS = """logs AS (SELECT o_orderpriority AS grp, o_custkey % 6 AS run, o_orderkey AS line_no, CASE WHEN o_orderkey % 7 <> 0 THEN month(o_orderdate)::DOUBLE END AS epoch,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1e6 END AS acc FROM orders)"""
