"""The scan as a stream: bins with a watermark, loci as session windows, and a ledger that batch work finalises.

Positions are event time: one second is one base. A bin closes when the
watermark passes it, and rows that come later than that are dropped. What needs
the whole run (factors, e-values, selection) is left to the batch plan over the
ledger that the stream writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_position_time(df: DataFrame, pos: str) -> DataFrame:
    """Adds ``at``: the position as a timestamp."""
    return df.withColumn("at", F.timestamp_seconds(F.col(pos)))


def bin_counts(df: DataFrame, keys: list[str], pos: str, end: str, width: int, late: int) -> DataFrame:
    """(keys, bin, members, owned) of every bin that rows touch.

    A row counts in each of its bins at the time of its own position, so a bin
    may come in several parts; ``late`` positions behind the furthest, the parts
    of a position window are final. Parts add up.
    """
    timed = with_position_time(df, pos).withWatermark("at", f"{late} seconds")
    spread = timed.withColumn("bin", F.explode(F.sequence(F.floor(F.col(pos) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))))
    owner = F.floor(F.col(pos) / width) == F.col("bin")
    parts = spread.groupBy(F.window("at", f"{width} seconds").alias("opened"), *keys, "bin").agg(F.count(F.lit(1)).alias("members"), F.count_if(owner).alias("owned"))
    return parts.drop("opened")


def loci(df: DataFrame, keys: list[str], pos: str, gap: int, late: int) -> DataFrame:
    """Loci as session windows: rows up to ``gap`` apart join. Columns: keys, first, last, n."""
    timed = with_position_time(df, pos).withWatermark("at", f"{late} seconds")
    session = F.session_window("at", f"{gap} seconds 1 microseconds")
    return timed.groupBy(*keys, session.alias("session")).agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("n")).drop("session")


def write_ledger(stream: DataFrame, path: str, checkpoint: str):
    """Append finished loci to a Parquet ledger, once each, and stop when the input is drained."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
