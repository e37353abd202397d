"""The ordered scan as a stateful stream: a bin holds its rows until the scan has passed its end.

State is a list per bin in the RocksDB store, so it spills to disk and is
bounded by the rows that overlap bins not yet passed. Bins are keys, so they
close in parallel. A killed executor restarts from the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """The state store that lists and timers need; set it before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def contig_starts(lengths: dict[str, int], width: int) -> dict[str, int]:
    """Where each contig begins on one line through all of them, in file order.

    Each contig takes whole bins, so its last bin ends where the next contig begins.
    """
    starts, at = {}, 0
    for name, length in lengths.items():
        starts[name] = at
        at += -(-length // width) * width
    return starts


def on_one_line(contig: str, pos: str, starts: dict[str, int]) -> Column:
    """Position on the line of ``contig_starts``; null for contigs that it lacks."""
    table = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair))  # a header's contigs
    return table[F.col(contig)] + F.col(pos)


class _Bins(StatefulProcessor):
    """Rows of one (contig, bin) until the watermark passes the bin's end."""

    def __init__(self, width: int, starts: dict[str, int], held: StructType, order: list[str], fold: Callable[[tuple, pd.DataFrame], pd.DataFrame]):
        self.width, self.starts, self.held, self.order, self.fold = width, starts, held, order, fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        closes = (self.starts[key[0]] + (key[1] + 1) * self.width) * 1000
        if timerValues.getCurrentWatermarkInMs() < closes:
            for part in rows:
                self.rows.appendList([tuple(r) for r in part[self.held.names].itertuples(index=False)])
            self.handle.registerTimer(closes)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        members = pd.DataFrame(list(self.rows.get()), columns=self.held.names).sort_values(self.order, kind="stable", ignore_index=True)
        self.rows.clear()
        yield self.fold(key, members)

    def close(self) -> None:
        pass


def closed_bins(df: DataFrame, contig: str, pos: str, end: str, lengths: dict[str, int], width: int, late: int, order: list[str], fold: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fold((contig, bin), rows)`` for every bin, once, when the scan is ``late`` positions past its end.

    A row belongs to all bins that it touches, an end before the position counts
    as the position. ``fold`` gets a bin's rows in the order of ``order`` and
    returns rows of ``schema``. Rows more than ``late`` behind the scan are
    dropped, closed bins never open again, and rows without a position or on
    contigs outside ``lengths`` are in no bin. Bins that the scan has not passed
    when it stops stay in the state and close on the next run.
    """
    starts = contig_starts(lengths, width)
    placed = df.withColumn("_at", F.timestamp_seconds(on_one_line(contig, pos, starts))).filter("_at is not null").withWatermark("_at", f"{late} seconds")
    last = F.greatest(F.col(pos), F.coalesce(F.col(end), F.col(pos)))
    spread = placed.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(pos) / width).cast("long"), F.floor(last / width).cast("long"))))
    worker = _Bins(width, starts, df.schema, order, fold)
    return spread.groupBy(contig, "_bin").transformWithStateInPandas(statefulProcessor=worker, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def run_while(query, goes_on: Callable[[int], bool], every: float = 1.0) -> int:
    """Wait for a streaming query and stop it once ``goes_on(rows read so far)`` says no; returns the rows read."""
    read, seen = 0, -1
    while True:
        ended = query.awaitTermination(every)
        for progress in query.recentProgress:
            if progress.batchId > seen:
                seen, read = progress.batchId, read + progress.numInputRows
        if ended:
            return read
        if not goes_on(read):
            query.stop()


def tallied(df: DataFrame, name: str, passes: Column) -> DataFrame:
    """The rows that pass; the query's progress reports ``total`` and ``passed`` of each batch under ``name``, final once it is drained."""
    return df.observe(name, F.count(F.lit(1)).alias("total"), F.count_if(passes).alias("passed")).filter(passes)
