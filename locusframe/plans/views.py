"""Views over the driver tables that several queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import table


def seconds(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))").cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, t (whole seconds)."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", seconds("ts").alias("t"))


def days(ts: str) -> Column:
    """Whole days since 1970."""
    return F.floor(seconds(ts) / 86_400).cast("long")


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """custkey, orderkey, start and end in days: from the order to its last shipment."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), days("o_orderdate").alias("start"))
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.max(days("l_shipdate")).alias("end"))
    return orders.join(last, "orderkey").filter("end >= start").select("custkey", "orderkey", "start", "end")


#: The same views in SQL.
EVENTS_SQL = "ev AS (SELECT event_id, user_id, event_type, value, (epoch_us(ts) // 1000000)::BIGINT AS t FROM events)"
SPANS_SQL = """spans AS (
  SELECT o_custkey AS custkey, o_orderkey AS orderkey, (epoch_us(o_orderdate) // 86400000000)::BIGINT AS "start", e AS "end"
  FROM orders JOIN (SELECT l_orderkey, max(epoch_us(l_shipdate) // 86400000000)::BIGINT AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  WHERE e >= (epoch_us(o_orderdate) // 86400000000))"""
