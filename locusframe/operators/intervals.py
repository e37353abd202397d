"""Interval joins as equi-joins on buckets.

A range predicate alone would be a nested loop. Both sides are spread over the
fixed-width buckets that they touch, joined on key and bucket, and a pair is
kept only in its first shared bucket, so nothing has to be made distinct
afterwards. ``width`` should be near the usual interval length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def bins_of(df: DataFrame, start: str, end: str, width: int, name: str = "bin") -> DataFrame:
    """One row for every bin of ``width`` that [start, end] touches, the end included."""
    first, last = F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long")
    return df.withColumn(name, F.explode(F.sequence(first, F.greatest(first, last))))


def owned_by_bin(df: DataFrame, anchor: str, bin_col: str, width: int) -> DataFrame:
    """Rows whose anchor lies in [bin start, bin end)."""
    return df.filter(F.floor(F.col(anchor) / width).cast("long") == F.col(bin_col))


def _both(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], width: int) -> DataFrame:
    """Pairs of rows that share a bucket, each once. Columns of the right are prefixed ``r_``."""
    a = bins_of(left, l[0], l[1], width, "_b")
    renamed = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    b = bins_of(renamed, f"r_{r[0]}", f"r_{r[1]}", width, "_rb")
    same = [a[k] == b[f"r_{k}"] for k in keys] + [F.col("_b") == F.col("_rb")]
    first = F.greatest(F.floor(F.col(l[0]) / width), F.floor(F.col(f"r_{r[0]}") / width)).cast("long")
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return a.join(b, condition).filter(F.col("_b") == first).drop("_b", "_rb")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str] = ("start", "end"), r: tuple[str, str] = ("start", "end"), width: int = 10_000) -> DataFrame:
    """Pairs with ``left.end > right.start`` and ``left.start < right.end``."""
    return _both(left, right, keys, l, r, width).filter((F.col(l[1]) > F.col(f"r_{r[0]}")) & (F.col(l[0]) < F.col(f"r_{r[1]}")))


def containment_join(inner: DataFrame, outer: DataFrame, keys: list[str], i: tuple[str, str] = ("start", "end"), o: tuple[str, str] = ("start", "end"), width: int = 10_000) -> DataFrame:
    """Pairs where the outer interval spans the inner one: ``outer.start <= inner.start`` and ``outer.end >= inner.end``."""
    return _both(inner, outer, keys, i, o, width).filter((F.col(f"r_{o[0]}") <= F.col(i[0])) & (F.col(f"r_{o[1]}") >= F.col(i[1])))


def points_in_intervals(points: DataFrame, spans: DataFrame, keys: list[str], pos: str, s: tuple[str, str] = ("start", "end"), width: int = 10_000) -> DataFrame:
    """Pairs with ``start <= pos < end``. Each point is in one bucket."""
    spread = bins_of(spans.select(*[F.col(c).alias(f"r_{c}") for c in spans.columns]), f"r_{s[0]}", f"r_{s[1]}", width, "_rb")
    at = points.withColumn("_b", F.floor(F.col(pos) / width).cast("long"))
    condition = F.col("_b") == F.col("_rb")
    for k in keys:
        condition = condition & (at[k] == spread[f"r_{k}"])
    return at.join(spread, condition).filter((F.col(f"r_{s[0]}") <= F.col(pos)) & (F.col(pos) < F.col(f"r_{s[1]}"))).drop("_b", "_rb")


def in_spans(points: DataFrame, spans: DataFrame, keys: list[str], pos: str, s: tuple[str, str] = ("start", "end"), width: int = 10_000) -> DataFrame:
    """Points that lie in any span (a semi-join)."""
    spread = bins_of(spans.select(*[F.col(c).alias(f"r_{c}") for c in (*keys, *s)]), f"r_{s[0]}", f"r_{s[1]}", width, "_rb")
    at = points.withColumn("_b", F.floor(F.col(pos) / width).cast("long"))
    condition = (F.col("_b") == F.col("_rb")) & (F.col(f"r_{s[0]}") <= F.col(pos)) & (F.col(pos) < F.col(f"r_{s[1]}"))
    for k in keys:
        condition = condition & (at[k] == spread[f"r_{k}"])
    return at.join(spread, condition, "left_semi").drop("_b")


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], pos: str, rpos: str, within: int) -> DataFrame:
    """Pairs whose positions are at most ``within`` apart, as a band join on buckets of that width."""
    a = left.withColumn("_b", F.explode(F.sequence(F.floor(F.col(pos) / within).cast("long") - 1, F.floor(F.col(pos) / within).cast("long") + 1)))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_rb", F.floor(F.col(f"r_{rpos}") / within).cast("long"))
    condition = F.col("_b") == F.col("_rb")
    for k in keys:
        condition = condition & (a[k] == b[f"r_{k}"])
    return a.join(b, condition).withColumn("distance", F.abs(F.col(pos) - F.col(f"r_{rpos}"))).filter(F.col("distance") <= within).drop("_b", "_rb")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], pos: str, rpos: str, within: int, left_id: list[str], ties: list[str]) -> DataFrame:
    """The nearest right row of each left row, within a distance; ties by the columns named."""
    pairs = near_pairs(left, right, keys, pos, rpos, within)
    return pairs.withColumn("_r", F.row_number().over(W.partitionBy(*left_id).orderBy("distance", *ties))).filter("_r = 1").drop("_r")
