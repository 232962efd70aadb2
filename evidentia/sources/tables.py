"""Readers for the engine's tables, and the adapters that give stored tables the shape of the analytic records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline events: one row for each stored event, times in UTC without a zone."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id"), F.col("user_id").alias("subject_id"), F.col("ts").cast("timestamp_ntz").alias("observed_at"), F.col("event_type").alias("value"), F.col("value").alias("magnitude"), "props")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence ledger: a line of an order is a piece of evidence, its supplier the source."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("evidence_id"), (F.col("l_orderkey") % 50).alias("case_id"), F.col("l_suppkey").alias("source_id"),
        F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("collected_at"), F.round(1 - F.col("l_discount"), 2).alias("reliability"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_returnflag").alias("kind"),
    )


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry: a negative balance is a confidence that was never assessed (NULL, not 0)."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("actor_id"), F.col("c_name").alias("handle"), F.col("c_mktsegment").alias("category"), F.col("c_nationkey").alias("source_id"), F.when(F.col("c_acctbal") >= 0, F.round(F.col("c_acctbal") / 10000, 4)).alias("confidence"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases: an order each, due two days after its date."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("actor_id"), F.lower(F.substring("o_orderpriority", 3, 20)).alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("opened_at"), F.expr("cast(o_orderdate as timestamp_ntz) + interval 2 days").alias("sla_due_at"), F.col("o_totalprice").alias("amount"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as (tx_id, input, output): the order's customer pays each of its suppliers."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tx_id"), F.col("l_suppkey").alias("s")).distinct()
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx_id"), F.concat(F.lit("c"), "o_custkey").alias("input"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    return o.join(line, "tx_id").select("tx_id", "input", F.concat(F.lit("s"), "s").alias("output"), "amount", "ts")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal graph edges customer -> supplier with their activity window."""
    return flows(spark, sf_dir).groupBy(F.col("input").alias("source"), F.col("output").alias("target")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"), F.min("tx_id").alias("evidence_id"))
