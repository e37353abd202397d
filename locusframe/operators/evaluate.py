"""Evaluation of calls against a truth, and of runs against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .greedy import match_one_to_one
from .intervals import in_spans


def first_reason(reasons: list[tuple[str, Column]], otherwise: str) -> Column:
    """The first reason, in order, whose condition holds."""
    out = None
    for name, condition in reasons:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def precision_recall(rows: DataFrame, group: str, truth: str, called: str) -> DataFrame:
    """Counts and ratios by group and for all (group ``ALL``); ratios of nothing are null."""
    counts = rows.groupBy(group).agg(F.count_if(F.col(truth) & F.col(called)).alias("tp"), F.count_if(~F.col(truth) & F.col(called)).alias("fp"), F.count_if(F.col(truth) & ~F.col(called)).alias("fn"))
    pooled = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn"))).select(F.lit("ALL").alias(group), "tp", "fp", "fn")
    ratio = lambda other: F.round(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col(other)).cast("double")), 9)
    return counts.unionByName(pooled).select(group, "tp", "fp", "fn", ratio("fp").alias("precision"), ratio("fn").alias("recall"))


def run_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What run b gained (+), lost (-), changed (~) or kept (=) of run a."""
    left, right = a.select(*keys, F.col(value).alias("_a")), b.select(*keys, F.col(value).alias("_b"))
    change = F.when(F.col("_a").isNull(), "+").when(F.col("_b").isNull(), "-").when(F.col("_a") != F.col("_b"), "~").otherwise("=")
    return left.join(right, keys, "full_outer").select(*keys, change.alias("change"))


def score_calls(calls: DataFrame, truth: DataFrame, confident: DataFrame, within: int = 100) -> DataFrame:
    """One row: true and false positives and misses, one-to-one within a distance in confident regions."""
    inside = [in_spans(x, confident, ["chrom"], "pos") for x in (calls, truth)]
    matched = match_one_to_one(inside[0], inside[1], ["chrom"], "pos", within)
    n = [x.agg(F.count(F.lit(1)).alias(name)) for x, name in ((inside[0], "calls"), (inside[1], "truths"), (matched, "tp"))]
    row = n[0].crossJoin(F.broadcast(n[1])).crossJoin(F.broadcast(n[2]))  # one row each
    return row.select("tp", (F.col("calls") - F.col("tp")).alias("fp"), (F.col("truths") - F.col("tp")).alias("fn")).withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})
