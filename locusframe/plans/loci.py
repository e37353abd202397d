"""Evidence that ties an insertion to its place, scored there and at shifted places (decoys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import prob, scalars as S
from ..functions.udfs import duplications, repeat_share_of
from ..session import workers
from ..sources.text import reference_windows
from . import mechanism as M

# Bases around a place, and the shifts: how many, how far apart, how far away.
AROUND, DECOYS, STEP, RANGE, REACH = 100, 100, 30, 1500, 200


def shifts(left: Column, right: Column) -> Column:
    """0, then -step, +step, -2 step, ... of the shifts that stay within the range, ``DECOYS`` at most."""
    low, high = F.greatest(F.lit(0), left - RANGE), right + RANGE
    width = F.greatest(F.lit(0), right - left)
    every = F.array(*(F.lit(d * k * STEP).cast("bigint") for k in range(1, 2 * DECOYS + 1) for d in (-1, 1)))
    inside = F.filter(every, lambda s: (left + s >= low) & (left + s + width <= high))
    return F.concat(F.array(F.lit(0).cast("bigint")), F.slice(inside, 1, DECOYS))


def locus_evidence(loci: DataFrame, blocks: DataFrame) -> DataFrame:
    """Mechanism scores of loci and of their shifted breakpoints, one row a locus.

    ``loci``: id, chrom, bp_left, bp_right, insert and the columns ``OBSERVED`` of a
    mechanism that do not depend on the place. ``blocks``: the reference in blocks.
    Adds those that do, the scores, decoy_count, decoy_mean_exp_linkage and
    decoy_tsd_hits. The reference is joined once a locus, in a window that holds
    every shift; only this bounded window goes to Python.
    """
    workers(loci.sparkSession)
    c = F.col
    lo, hi = F.least("bp_left", "bp_right"), F.greatest("bp_left", "bp_right")
    spans = loci.withColumns({"start": F.greatest(F.lit(0), lo - RANGE - REACH), "end": hi + RANGE + REACH})
    windows = reference_windows(spans.select("id", "chrom", "start", "end"), blocks).select("id", "start", "window")
    at = loci.join(windows, "id").withColumn("_shifts", F.when(c("bp_left") >= 0, shifts(c("bp_left"), c("bp_right"))).otherwise(F.array(F.lit(0).cast("bigint"))))
    at = at.withColumn("_places", duplications("window", "start", "bp_left", "bp_right", "insert", "_shifts"))
    fixed = [x for x in loci.columns if x not in ("tsd_len", "tsd_mismatches", "tsd_seq", "motif_log_odds", "a_share", "t_share", "repeat_share", "tsd_chance")]
    place = at.select(*fixed, "window", "start", F.explode("_places").alias("_p"))
    low, high = F.least("bp_left", "bp_right") + c("_p.shift"), F.greatest("bp_left", "bp_right") + c("_p.shift")
    first = F.greatest(F.lit(0), low - AROUND)
    part = F.substring("window", (first - c("start") + 1).cast("int"), (high + AROUND - first).cast("int"))
    place = place.withColumns({"_w": part, "_at": (low - first).cast("int")})
    motif = S.nick_motif(F.left(c("_w"), c("_at")), F.substring(c("_w"), c("_at") + 1, F.length("_w")))["log_odds"]
    place = place.withColumn("_share", S.base_shares("_w")).select(
        *fixed, c("_p.shift").alias("_shift"), c("_p.length").alias("tsd_len"), c("_p.mismatches").alias("tsd_mismatches"), c("_p.sequence").alias("tsd_seq"), c("_p.repeat_share").alias("repeat_share"),
        c("_p.chance").alias("tsd_chance"), c("_share.a").alias("a_share"), c("_share.t").alias("t_share"), F.when(c("te_class").isin(*M.NICKED) & (F.length("_w") > 0), motif).alias("motif_log_odds"),
    )
    modelled = M.with_duplication_model(place).withColumn("_linkage", M.linkage_term({x: c(x) for x in M.OBSERVED}, c("te_class"), c("tsd_model")))
    decoys = modelled.filter("_shift <> 0").groupBy("id").agg(F.count(F.lit(1)).alias("decoy_count"), F.avg(F.exp(F.least("_linkage", F.lit(700.0)))).alias("decoy_mean_exp_linkage"), F.count_if(c("tsd_len") > 0).alias("decoy_tsd_hits"))
    own = place.filter("_shift = 0").drop("_shift")
    trimmed = S.without_copy("insert", "tsd_seq", "tsd_mismatches")
    tail = S.tolerant_tail(S.oriented(trimmed, "strand"), "A", 3) if "strand" in loci.columns else S.tolerant_tail(F.upper(trimmed), "A", 3)
    own = own.withColumn("polya_len", F.when((c("tsd_len") > 0) & (trimmed != c("insert")) & (tail >= 6), F.greatest("polya_len", tail)).otherwise(c("polya_len")))
    return M.score_loci(own).join(decoys, "id", "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("decoy_count", "decoy_tsd_hits")} | {"decoy_mean_exp_linkage": F.coalesce("decoy_mean_exp_linkage", F.lit(0.0))})


def allele_error_rate(loci: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds ``error_rate`` of an allele's whole span (id, chrom, span_left, span_right): its composition and its repeats."""
    workers(loci.sparkSession)
    spans = loci.withColumns({"start": F.greatest(F.lit(0), F.col("span_left") - AROUND), "end": F.col("span_right") + AROUND})
    windows = reference_windows(spans.select("id", "chrom", "start", "end"), blocks).select("id", "start", "window")
    share = S.base_shares("window")
    repeat = repeat_share_of("window", F.col("span_left") - F.col("start"), F.col("span_right") - F.col("start"))
    return loci.join(windows, "id").withColumn("error_rate", prob.local_error_rate(share["a"], share["t"], repeat)).drop("start", "window")
