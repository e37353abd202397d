"""Whole-run selection of loci: collapse regions, decoy factors, loci, alleles, mean e-values, step-up, placement."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import greedy, islands, ranks, signal, stats
from ..session import settle
from .registry import query
from .views import EVENTS_SQL, events

# Fixed values of the decision rule.
LOCUS_GAP = 300
COLLAPSE_HALF = 50_000
COLLAPSE_REF_SPAN = 2
COLLAPSE_ROWS = 100
ALLELE_TOLERANCE = 0.3
MOST_EXPONENT = 700.0
PLACEMENT_WINDOW = 100
PLACEMENT_SHARE = 0.5
TE_COVERAGE = 0.5
TE_BASES = 100
NOT_TE = ("NA", "NonTE", "")
#: Width of the coordinate buckets that windows run in.
BUCKET = 5_000_000


def rate_rows(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``artifact`` and, as if nothing were collapsed, ``e``; the decoy checks)."""
    rows = ledger.withColumn("_class", F.when(F.col("te_annotation_class").isNull() | (F.col("te_annotation_class") == ""), "NA").otherwise(F.col("te_annotation_class")))
    checks = stats.decoy_checks(rows, "_class", "mech_decoy_count", "mech_decoy_mean_exp_linkage", ~F.col("_class").isin(*NOT_TE))
    factor = settle(checks.filter("te_class <> 'ALL'").select(F.col("te_class").alias("_class"), F.log("factor").alias("_lf")))
    rows = rows.join(F.broadcast(factor), "_class", "left").withColumn("_lf", F.coalesce("_lf", F.lit(0.0)))  # one row a class name
    own = F.col("mech_log_lr_vs_artifact")
    allele = F.when(F.col("allele_byseq_extra_carriers") > 0, own - F.col("mech_counts_term") + F.col("mech_counts_allele_byseq")).otherwise(own)
    return rows.withColumns({"artifact": own - F.col("_lf"), "e": F.exp(F.least(allele - F.col("_lf"), F.lit(MOST_EXPONENT)))}).drop("_lf", "_class"), checks


def rate_places(rows: DataFrame) -> DataFrame:
    """One row a position: ``n_rows``, sum ``_e`` and largest ``_m`` of the e-values, its first row ``_first`` (-adjusted, pos, row_id), and ``collapsed``.

    Collapse depends on the position alone, so rows are never windowed or joined with it.
    """
    counted = F.greatest(F.lit(0), F.col("ref_span_reads")) <= COLLAPSE_REF_SPAN
    places = rows.groupBy("tid", "chrom", "pos").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(counted, 1)).alias("_c"), F.sum("e").alias("_e"), F.max("e").alias("_m"), F.min(F.struct(-F.col("artifact"), F.col("row_id"))).alias("_best"), F.min("row_id").alias("_least")
    )
    near = signal.sum_near(settle(places), ["chrom"], "pos", COLLAPSE_HALF, "_c", "_near").withColumn("collapsed", F.col("_near") >= COLLAPSE_ROWS)
    kept = lambda zero, own: F.when(F.col("collapsed"), zero).otherwise(own)
    first = F.struct(kept(F.lit(math.inf), F.col("_best.col1")).alias("adjusted"), F.col("pos"), kept(F.col("_least"), F.col("_best.row_id")).alias("row_id"))
    return near.select("tid", "chrom", "pos", "n_rows", kept(F.lit(0.0), F.col("_e")).alias("_e"), kept(F.lit(0.0), F.col("_m")).alias("_m"), first.alias("_first"), "collapsed")


def merge_places(places: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds ``locus`` to the positions of the rows: islands, joined where consecutive ones are one allele."""
    keys = ["tid", "chrom"]
    places = islands.assign_islands(places, keys, "pos", LOCUS_GAP, bucket=BUCKET)
    carriers = rows.filter(F.col("allele_byseq_extra_carriers") > 0)
    # Loci that no span connects keep their number without a fold.
    if carriers.filter((F.col("bp_left") + F.col("allele_byseq_span_lo")).isNotNull()).isEmpty():
        return places.withColumnRenamed("island", "locus")
    places = settle(places)
    spans = carriers.join(places.select(*keys, "pos", "island"), [*keys, "pos"]).groupBy(*keys, "island").agg(
        F.min(F.col("bp_left") + F.col("allele_byseq_span_lo")).alias("lo"), F.max(F.col("bp_left") + F.col("allele_byseq_span_hi")).alias("hi"), F.median("allele_length").alias("size")
    )
    loci = places.select(*keys, "island").distinct().join(spans, [*keys, "island"], "left")
    merged = greedy.merge_alleles(loci, keys, "island", "lo", "hi", "size", ALLELE_TOLERANCE)
    return places.join(merged, [*keys, "island"]).withColumnRenamed("allele", "locus").drop("island")


def merge_loci(rows: DataFrame) -> DataFrame:
    """Adds ``locus`` to rows. Rows of one position are always in one locus, so only positions are windowed."""
    at = ["tid", "chrom", "pos"]
    return rows.join(merge_places(rows.select(*at).distinct(), rows), at)


def rank_loci(ledger: DataFrame, q: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row a locus with mean e-value, rank and whether it is selected; the positions with their locus; the rated rows)."""
    rows, _ = rate_rows(ledger)
    places = settle(merge_places(settle(rate_places(rows)), rows))
    sums = places.groupBy("tid", "chrom", "locus").agg(F.sum("n_rows").alias("n_rows"), F.sum("_e").alias("_e"), F.max("_m").alias("_m"), F.min("pos").alias("first_pos"), F.min("_first").alias("_first"))
    # A sum over rows at the cap overflows, a mean does not: halve through the largest.
    mean = F.when(F.col("_e") == F.lit(math.inf), F.col("_m")).otherwise(F.col("_e") / F.col("n_rows"))
    loci = sums.select("tid", "chrom", "locus", "n_rows", "first_pos", mean.alias("mean_e"), F.col("_first.pos").alias("rep_pos"), F.col("_first.row_id").alias("rep_row"))
    return ranks.select_by_evalue(settle(loci), "mean_e", q, ["tid", "chrom", "first_pos"]), places, rows


def select_loci(ledger: DataFrame, q: float) -> DataFrame:
    """One row a locus: mean e-value, rank, whether it is selected, its representative row, the call's kind and place.

    ``call`` is ``TE`` or ``STRUCTURAL`` for selected loci, else null;
    ``call_pos`` is -1 where the representative's own breakpoint stands.
    """
    loci, places, rows = rank_loci(ledger, q)
    loci, keys, at = settle(loci), ["tid", "chrom", "locus"], ["tid", "chrom", "pos"]
    # Only representatives of selected loci are looked up, and rows near wide ones.
    picked = loci.filter("selected").select(*keys, "rep_pos", "rep_row")
    lengths = F.sort_array("alt_measured_lengths")
    m = F.size(lengths)
    value = lambda i: F.get(lengths, i.cast("int")).cast("double")
    median = F.when(m > 0, (value(F.floor((m - 1) / 2)) + value(F.floor(m / 2))) / 2)
    te = (F.col("te_union_coverage") >= TE_COVERAGE) & (F.col("te_union_covered_bp") >= TE_BASES) & ~F.coalesce("te_dominant_class", F.lit("")).isin(*NOT_TE) & (median.isNull() | (median >= TE_BASES))
    need = PLACEMENT_SHARE * F.greatest(F.lit(1), F.col("alt_indel_reads"))
    # Rows are reduced to what is asked of them before they are joined.
    asked = ledger.select(F.col("tid").alias("_t"), F.col("chrom").alias("_c"), F.col("pos").alias("_p"), F.col("row_id").alias("_i"), "bp_left", "bp_right", need.alias("_need"), F.coalesce(te, F.lit(False)).alias("_te"))
    reps = settle(asked.join(picked, F.expr("_t = tid and _c = chrom and _p = rep_pos and _i <=> rep_row")).select(*keys, "bp_left", "bp_right", "_need", "_te").dropDuplicates(keys))
    wide = reps.filter("bp_left <> bp_right").select(*keys, F.col("bp_left").alias("_l"), F.col("bp_right").alias("_r"), "_need")
    around = places.select(*keys, "pos").join(wide, keys).filter(F.col("pos").between(F.col("_l") - PLACEMENT_WINDOW, F.col("_r") + PLACEMENT_WINDOW))
    near = rows.filter("bp_left = bp_right and bp_left >= 0").join(around, at).filter(F.col("alt_indel_reads") >= F.col("_need"))
    placed = near.groupBy(*keys).agg(F.min_by("bp_left", F.struct(-F.col("alt_indel_reads"), -F.col("artifact"), F.col("pos"), F.col("row_id"))).alias("call_pos"))
    calls = reps.select(*keys, F.when(F.col("_te"), "TE").otherwise("STRUCTURAL").alias("call")).join(placed, keys, "left")
    return loci.join(calls, keys, "left").select(*keys, "n_rows", "first_pos", "mean_e", "rank", "m", "selected", "rep_row", "call", F.coalesce("call_pos", F.lit(-1)).cast("long").alias("call_pos"))


def finalize(ledger: DataFrame, selected: DataFrame) -> DataFrame:
    """The TE calls in genome order, with ``lfdr`` = min(1, 1 / e)."""
    calls = selected.filter("call = 'TE'").select("rep_row", "mean_e", "call_pos", "tid", "first_pos")
    own = ledger.select("row_id", "chrom", "pos", "bp_left", "bp_right", "te_dominant_class", "te_dominant_family")
    joined = calls.join(own, calls["rep_row"] == own["row_id"])
    placed = F.when(F.col("call_pos") >= 0, F.col("call_pos")).otherwise(F.col("bp_left"))
    return joined.select("chrom", "tid", placed.alias("pos"), "bp_left", "bp_right", F.col("te_dominant_family").alias("family"), F.least(F.lit(1.0), F.try_divide(F.lit(1.0), F.col("mean_e"))).alias("lfdr")).orderBy("tid", "pos")


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger-shaped view of the events: types are contigs, seconds are positions."""
    e = events(spark, sf_dir)
    none = lambda t: F.lit(None).cast(t)
    return e.select(
        F.col("event_id").alias("row_id"), F.col("event_type").alias("chrom"), F.lit(0).alias("tid"), F.col("t").alias("pos"), F.col("t").alias("bp_left"), (F.col("t") + F.col("event_id") % 3).alias("bp_right"),
        F.when(F.col("user_id") % 5 == 0, "NonTE").otherwise(F.concat(F.lit("class"), (F.col("user_id") % 5).cast("string"))).alias("te_annotation_class"),
        (F.coalesce("value", F.lit(0.0)) / 25).alias("mech_log_lr_vs_artifact"), F.lit(0.0).alias("mech_counts_term"), F.lit(0.0).alias("mech_counts_allele_byseq"), none("int").alias("allele_length"),
        none("bigint").alias("allele_byseq_span_lo"), none("bigint").alias("allele_byseq_span_hi"), F.lit(0).alias("allele_byseq_extra_carriers"), (F.col("event_id") % 7).cast("int").alias("mech_decoy_count"),
        ((F.col("user_id") % 10) / 8).alias("mech_decoy_mean_exp_linkage"), (F.col("event_id") % 4).cast("int").alias("ref_span_reads"), (F.col("event_id") % 6).cast("int").alias("alt_indel_reads"),
        ((F.col("event_id") % 10) / 10).alias("te_union_coverage"), F.lit(300).alias("te_union_covered_bp"), F.lit("LINE").alias("te_dominant_class"), F.lit("L1").alias("te_dominant_family"), none("array<int>").alias("alt_measured_lengths"),
    )


_D = "count(*) FILTER (WHERE c > 0) AS k, sum(CASE WHEN c > 0 THEN c ELSE 0 END) AS n, sum(c * v) AS s, var_samp(CASE WHEN c > 0 THEN v END) AS var"


@query(f"""WITH {EVENTS_SQL}, l AS (SELECT event_id, event_type AS chrom, t, CASE WHEN user_id % 5 = 0 THEN 'NonTE' ELSE 'class' || (user_id % 5)::VARCHAR END AS cls, coalesce(value, 0) / 25 AS lr, (event_id % 7)::INT AS c, (user_id % 10) / 8.0::DOUBLE AS v, event_id % 4 AS ref FROM ev),
n AS (SELECT *, count(*) FILTER (WHERE ref <= 2) OVER (PARTITION BY chrom ORDER BY t RANGE BETWEEN 50000 PRECEDING AND 50000 FOLLOWING) >= 100 AS coll FROM l),
g AS (SELECT cls, {_D} FROM l GROUP BY 1 UNION ALL SELECT 'ALL', {_D} FROM l WHERE cls <> 'NonTE'),
u AS (SELECT cls, k, CASE WHEN k = 0 THEN 1.0 ELSE greatest(1.0, CASE WHEN k = 1 THEN 'inf'::DOUBLE ELSE s / n + 1.645 * sqrt(var / k) END) END AS f FROM g),
w AS (SELECT a.cls, CASE WHEN a.k < 10 THEN b.f ELSE a.f END AS f FROM u a, u b WHERE b.cls = 'ALL' AND a.cls <> 'ALL'),
e AS (SELECT n.*, CASE WHEN coll THEN 0.0 ELSE exp(least(lr - ln(f), 700.0)) END AS e, CASE WHEN coll THEN '-inf'::DOUBLE ELSE lr - ln(f) END AS adj FROM n JOIN w USING (cls)),
o AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY chrom ORDER BY t, event_id) <= 300 THEN 0 ELSE 1 END AS opens FROM e),
i AS (SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY t, event_id) AS locus FROM o), x AS (SELECT *, row_number() OVER (PARTITION BY chrom, locus ORDER BY adj DESC, t, event_id) AS r FROM i),
m AS (SELECT chrom, locus, count(*) AS n_rows, sum(e) / count(*) AS mean_e, min(t) AS first_pos, max(CASE WHEN r = 1 THEN event_id END) AS rep_row FROM x GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (ORDER BY round(mean_e, 9) DESC, chrom, first_pos) AS rank, count(*) OVER () AS mm FROM m), cut AS (SELECT max(CASE WHEN round(mean_e, 9) >= mm / (0.5 * rank) THEN rank END) AS cut FROM k)
SELECT chrom, locus::BIGINT AS locus, n_rows::BIGINT AS n_rows, first_pos, round(mean_e, 6) AS mean_e, rep_row, coalesce(rank <= cut, false) AS selected FROM k, cut""")
def locus_mean_evalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-run selection over the events' ledger at q = 0.5."""
    s, _, _ = rank_loci(event_ledger(spark, sf_dir), 0.5)
    return s.select("chrom", "locus", "n_rows", "first_pos", F.round("mean_e", 6).alias("mean_e"), "rep_row", "selected")


@query()
def selected_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with kind, place and lfdr after the selection at q = 1."""
    ledger = event_ledger(spark, sf_dir)
    return finalize(ledger, select_loci(ledger, 1.0))
