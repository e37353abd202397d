"""Aggregates beyond the built-ins: medians, overdispersion, decoy bounds, tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "upper_median") -> DataFrame:
    """The element at index n // 2 of the sorted values of each key; nulls do not count.

    Values are counted before they are ranked, so a key holds one row for each
    distinct value and partial counts are combined before the shuffle.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*keys)
    cum = counts.select(*keys, value, F.sum("_c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)).alias("_cum"), F.sum("_c").over(w).alias("_n"))
    return cum.filter(F.col("_cum") > F.floor(F.col("_n") / 2)).groupBy(*keys).agg(F.min(value).alias(name), F.first("_n").alias("n"))


def median_absolute_deviation(df: DataFrame, keys: list[str], value: str, name: str = "mad") -> DataFrame:
    """Upper median of the distances from the upper median."""
    centre = upper_median(df, keys, value, "_centre").select(*keys, "_centre")
    apart = df.join(centre, keys).withColumn("_apart", F.abs(F.col(value) - F.col("_centre")))
    return upper_median(apart, keys, "_apart", name).join(centre.withColumnRenamed("_centre", "centre"), keys)


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, name: str = "weighted_median") -> DataFrame:
    """The first value whose cumulative weight reaches half; weights of 0 or less are ignored."""
    sums = df.filter(F.col(weight) > 0).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    w = W.partitionBy(*keys)
    cum = sums.select(*keys, value, F.sum("_w").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)).alias("_cum"), F.sum("_w").over(w).alias("_total"))
    return cum.filter(2 * F.col("_cum") >= F.col("_total")).groupBy(*keys).agg(F.min(value).alias(name))


def weighted_rollup(df: DataFrame, keys: list[str], value: str, weight: str, label: str) -> DataFrame:
    """Weighted mean of a value, total weight, and the label of largest weight (smallest label on ties)."""
    parts = df.groupBy(*keys, label).agg(F.sum(F.col(value) * F.col(weight)).alias("_vw"), F.sum(weight).alias("_w"))
    return parts.groupBy(*keys).agg(F.try_divide(F.sum("_vw"), F.sum("_w")).alias("weighted_mean"), F.sum("_w").alias("weight"), F.min_by(label, F.struct(-F.col("_w"), F.col(label))).alias("top_label"))


def overdispersion(df: DataFrame, alt: str, depth: str, fallback: float = 0.02, least_depth: int = 4, least_sites: int = 20) -> DataFrame:
    """One row: the random-effects intra-class correlation of proportions (``rho``) and the sites kept.

    Sites of too little depth or with shares outside (0.15, 0.85) are left out;
    too few sites give the fallback. All sums are additive, so one pass of
    partial aggregates is enough.
    """
    x, n = F.col(alt).cast("double"), F.col(depth).cast("double")
    kept = df.filter((n >= least_depth) & (x >= 0) & (x <= n) & (x / n > 0.15) & (x / n < 0.85))
    s = kept.agg(F.count(F.lit(1)).alias("m"), F.sum(x).alias("sx"), F.sum(n).alias("sn"), F.sum(n * n).alias("snn"), F.sum(x * x / n).alias("sxxn"), F.sum(x * (n - x) / n).alias("within"))
    p = F.try_divide(F.col("sx"), F.col("sn"))
    between = F.col("sxxn") - F.col("sn") * p * p  # sum of n (x/n - p)^2
    n0 = F.try_divide(F.col("sn") - F.try_divide(F.col("snn"), F.col("sn")), F.col("m") - 1)
    msb, msw = F.try_divide(between, F.col("m") - 1), F.try_divide(F.col("within"), F.col("sn") - F.col("m"))
    denominator = msb + (n0 - 1) * msw
    rho = F.least(F.lit(0.5), F.greatest(F.lit(0.0), F.try_divide(msb - msw, denominator)))
    usable = (F.col("m") >= least_sites) & (p > 1e-6) & (p < 1 - 1e-6) & (denominator > 1e-9)
    return s.select(F.col("m").alias("sites"), F.when(usable, rho).otherwise(F.lit(fallback)).alias("rho"))


def decoy_checks(df: DataFrame, group: str, count: str, mean: str, pooled: Column, z: float = 1.645, least: int = 10) -> DataFrame:
    """Upper bound of the decoys' mean for each class, and the factor that e-values are divided by.

    A row is one locus with ``count`` decoys of average ``mean``. Classes with
    fewer than ``least`` loci take bound and factor of the pool of the rows for
    which ``pooled`` holds, listed as class ``ALL``.
    """
    has = F.col(count) > 0
    bound = [
        F.count(F.when(has, 1)).alias("loci"),
        F.coalesce(F.sum(F.when(has, F.col(count))), F.lit(0)).cast("long").alias("decoys"),
        F.sum(F.when(has, F.col(count) * F.col(mean))).alias("_s"),
        F.var_samp(F.when(has, F.col(mean))).alias("_v"),
    ]
    upper = F.when(F.col("loci") == 0, 0.0).when(F.col("loci") == 1, F.lit(float("inf"))).otherwise(F.col("mean") + z * F.sqrt(F.col("_v") / F.col("loci")))

    def finish(x: DataFrame) -> DataFrame:
        x = x.withColumn("mean", F.when(F.col("decoys") > 0, F.col("_s") / F.col("decoys")).otherwise(0.0)).withColumn("upper", upper)
        return x.withColumn("factor", F.when(F.col("loci") == 0, 1.0).otherwise(F.greatest(F.lit(1.0), F.col("upper")))).drop("_s", "_v")

    name = F.when(F.col(group).isNull() | (F.col(group) == ""), "NA").otherwise(F.col(group))
    each = finish(df.groupBy(name.alias("te_class")).agg(*bound))
    every = finish(df.filter(pooled).agg(*bound)).select(F.lit("ALL").alias("te_class"), "loci", "decoys", "mean", "upper", "factor")
    pool = every.select(F.col("upper").alias("_pu"), F.col("factor").alias("_pf"))  # one row
    few = F.col("loci") < least
    each = each.crossJoin(F.broadcast(pool)).withColumns({"upper": F.when(few, F.col("_pu")).otherwise(F.col("upper")), "factor": F.when(few, F.col("_pf")).otherwise(F.col("factor"))})
    return each.select("te_class", "loci", "decoys", "mean", "upper", "factor").unionByName(every)


def _tail_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, _ge, _n) of the distinct values: rows as large, and rows."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*keys)
    return counts.select(*keys, value, F.sum("_c").over(w.orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, 0)).alias("_ge"), F.sum("_c").over(w).alias("_n"))


def empirical_tail(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``tail_p``: (1 + rows of the key with a value as large) / (2 + rows of the key)."""
    return df.join(_tail_counts(df, keys, value), [*keys, value]).withColumn("tail_p", (1 + F.col("_ge")) / (2 + F.col("_n"))).drop("_ge", "_n")


def leave_one_out_null(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``null_p``: (1 + other rows as large) / (rows), -1 for a lone row."""
    tail = _tail_counts(df, keys, value)
    return df.join(tail, [*keys, value]).withColumn("null_p", F.when(F.col("_n") < 2, -1.0).otherwise(F.col("_ge") / F.col("_n"))).drop("_ge", "_n")


def true_median(df: DataFrame, keys: list[str], value: str, name: str = "true_median") -> DataFrame:
    """The median that averages the middle two."""
    return df.groupBy(*keys).agg(F.median(value).alias(name))


def log_sum_exp(df: DataFrame, keys: list[str], value: str, name: str = "log_total") -> DataFrame:
    """Stable logarithm of the summed exponentials of a column, by key; minus infinities add nothing."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_m"))
    rest = df.join(top, keys).groupBy(*keys).agg(F.first("_m").alias("_m"), F.sum(F.exp(F.col(value) - F.col("_m"))).alias("_s"))
    return rest.select(*keys, F.when(F.col("_m") == F.lit(float("-inf")), F.col("_m")).otherwise(F.col("_m") + F.log("_s")).alias(name))


def block_bootstrap(df: DataFrame, block: str, sums: list[str], draws: int, seed: int = 1) -> DataFrame:
    """Sums of resampled blocks for every draw.

    Each draw picks as many blocks as there are, with replacement: pick ``i`` of
    draw ``d`` is a hash of both. Blocks are pre-summed, so rows do not matter;
    picks are joined to blocks by number.
    """
    blocks = df.groupBy(block).agg(*(F.sum(c).alias(c) for c in sums))
    total = blocks.agg(F.count(F.lit(1)).alias("_n"))  # one row
    numbered = blocks.withColumn("_i", F.row_number().over(W.orderBy(block)) - 1)  # one row a block
    picks = total.select(F.col("_n"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    x = (F.col("draw") * 7919 + F.col("_k") * 104_729 + seed * 15_485_863) % 2_147_483_647
    for _ in range(3):
        x = (x * 48_271 + 11) % 2_147_483_647
    picked = picks.withColumn("_i", (x % F.col("_n")).cast("int"))
    return picked.join(numbered, "_i").groupBy("draw").agg(*(F.sum(c).alias(c) for c in sums))
