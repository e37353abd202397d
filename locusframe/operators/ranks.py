"""Ranked selection: first maxima, top-k, first-wins dedup, e-value step-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import NumericType


def first_per_group(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each group in an order that has to be total."""
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank`` where it is named. Spark keeps at most ``k`` a group before the shuffle."""
    found = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= k)
    return found.withColumnRenamed("_r", rank) if rank else found.drop("_r")


def best_by_name(records: DataFrame, name: str, length: str, primary: str, ties: list[str]) -> DataFrame:
    """One record for every name: the longest, then a primary one."""
    return first_per_group(records, [name], [F.desc(length), F.desc(primary), *ties])


def longest_first(df: DataFrame, keys: list[str], text: str, most: int, budget: int | None = None, each: float = 6.0) -> DataFrame:
    """The ``most`` longest texts of each key (ties by text), and no more than fit a budget of ``each`` bytes a text and squared
    letter of the longest; one always stays."""
    w = W.partitionBy(*keys)
    ranked = df.withColumns({"_r": F.row_number().over(w.orderBy(F.desc(F.length(text)), text)), "_l": F.max(F.length(text)).over(w)})
    room = F.lit(most) if budget is None else F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(float(budget)) / (each * F.greatest(F.lit(1), F.col("_l")) * F.greatest(F.lit(1), F.col("_l"))))))
    return ranked.filter(F.col("_r") <= room).drop("_r", "_l")


def component_order(df: DataFrame, keys: list[str], anchor: str, weight: str, reads: str) -> DataFrame:
    """Adds ``place`` of components within their keys: by anchor, then most weight, then most reads."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(anchor, F.desc(weight), F.desc(reads))))


def best_and_second(df: DataFrame, keys: list[str], score: str, name: str) -> DataFrame:
    """Best of each group with the margin to the second: keys, ``best``, ``best_score``, ``second_score``, ``margin``."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), F.asc(name))
    ranked = df.select(*keys, F.col(name).alias("best"), F.col(score).alias("best_score"), F.lead(score).over(w).alias("second_score"), F.row_number().over(w).alias("_r"))
    margin = F.greatest(F.lit(0.0), F.col("best_score") - F.coalesce("second_score", F.lit(0.0)))
    return ranked.filter("_r = 1").drop("_r").withColumn("margin", margin)


def select_by_evalue(df: DataFrame, e: str, q: float, order: list[str], bucket: int = 4096) -> DataFrame:
    """E-value step-up: the largest r whose r-th largest e-value reaches m / (q * r) selects the r first.

    Adds ``rank`` (ties by ``order``), ``m`` and ``selected``. ``q <= 0`` selects
    nothing and ``q`` is capped at 1. Ranks are made without a global sort in one
    task: rows are dealt by ranges of the e-value, ranked inside, and moved by
    the rows in the ranges above.
    """
    q = min(1.0, q)
    # Ranges of log2(e), so that any scale spreads: at most 2 * bucket + 1 of them.
    level = F.when(F.col(e) > 0, F.greatest(F.lit(-bucket), F.least(F.lit(bucket), F.floor(F.log2(e) * 16).cast("int")))).otherwise(F.lit(-bucket))
    dealt = df.withColumn("_level", level.cast("int"))
    # Values of 0 have one range, and may be most rows: it is cut by ranges of the first tie-breaker.
    if order and isinstance(df.schema[order[0]].dataType, NumericType):
        cuts = df.filter(F.col(e) <= 0).agg(F.percentile_approx(order[0], [i / 255 for i in range(256)], 10_000).alias("_cuts"))  # one row
        dealt = dealt.crossJoin(F.broadcast(cuts)).withColumn("_sub", F.when(F.col(e) <= 0, F.size(F.filter("_cuts", lambda x: x < F.col(order[0])))).otherwise(0)).drop("_cuts")
    else:
        dealt = dealt.withColumn("_sub", F.lit(0))
    counts = dealt.groupBy("_level", "_sub").agg(F.count(F.lit(1)).alias("_c"))
    above = counts.select("_level", "_sub", (F.sum("_c").over(W.orderBy(F.desc("_level"), "_sub").rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")).alias("_above"), F.sum("_c").over(W.partitionBy()).alias("m"))
    inner = W.partitionBy("_level", "_sub").orderBy(F.desc(e), *order)
    ranked = dealt.join(F.broadcast(above), ["_level", "_sub"]).withColumn("rank", (F.col("_above") + F.row_number().over(inner)).cast("long")).drop("_level", "_sub", "_above")
    if q <= 0:
        return ranked.withColumn("selected", F.lit(False))
    cut = ranked.agg(F.max(F.when(F.col(e) >= F.col("m") / (q * F.col("rank")), F.col("rank"))).alias("_cut"))
    return ranked.crossJoin(F.broadcast(cut)).withColumn("selected", F.coalesce(F.col("rank") <= F.col("_cut"), F.lit(False))).drop("_cut")  # one row
