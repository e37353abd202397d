"""What an insert's library alignments say: subjects, families, coverage, margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import seq
from ..operators import islands, ranks

NEAR_TIE = 0.02


def normalise_hits(hits: DataFrame) -> DataFrame:
    """Tabular hits with 0-based half-open intervals, strand and identity as a share."""
    lo, hi = F.least("qstart", "qend") - 1, F.greatest("qstart", "qend")
    slo, shi = F.least("sstart", "send") - 1, F.greatest("sstart", "send")
    return hits.select(
        "query_id", "subject_id", (F.col("pident") / 100).alias("identity"), "length", "bitscore", "evalue", lo.cast("long").alias("qlo"), hi.cast("long").alias("qhi"), slo.cast("long").alias("slo"), shi.cast("long").alias("shi"),
        F.when(F.col("send") < F.col("sstart"), "-").otherwise("+").alias("strand"),
    )


def subjects(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One row for every query and subject, ranked by (evalue, -bits, -score, id). ``queries``: query_id, qlen.

    Identity is weighted by length, bit scores add, coverage is the union of
    the intervals, and the strand is that of the best hit.
    """
    h = normalise_hits(hits)
    sums = h.groupBy("query_id", "subject_id").agg(
        F.try_divide(F.sum(F.col("identity") * F.col("length")), F.sum("length")).alias("identity"), F.sum("length").alias("aligned"), F.sum("bitscore").alias("bitscore"), F.min("evalue").alias("evalue"),
        F.max_by("strand", F.struct("bitscore", -F.col("qlo"))).alias("strand"), F.min("qlo").alias("qlo"), F.max("qhi").alias("qhi"), F.min("slo").alias("slo"), F.max("shi").alias("shi"),
    )
    clipped = h.join(queries, "query_id").withColumn("hi", F.least("qhi", F.col("qlen").cast("long")))
    union = islands.union_length(clipped, ["query_id", "subject_id"], "qlo", "hi")
    out = sums.filter("aligned > 0").join(union, ["query_id", "subject_id"], "left").join(queries, "query_id")
    coverage = F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.col("qlen"))
    out = out.withColumn("coverage", coverage).withColumn("score", F.least(F.lit(1.0), F.col("identity")) * F.col("coverage"))
    order = W.partitionBy("query_id").orderBy("evalue", F.desc("bitscore"), F.desc("score"), "subject_id")
    return out.withColumn("rank", F.row_number().over(order)).withColumn("parts", seq.repeat_name_parts("subject_id"))


def te_coverage(hits: DataFrame, ranked: DataFrame, classes: DataFrame) -> DataFrame:
    """Union coverage of an insert by elements, and the family that covers most. ``classes``: subject_id, te_class."""
    te = ranked.join(classes.filter("te_class <> 'NonTE'"), "subject_id").select("query_id", "subject_id", "qlen", "bitscore", "te_class", F.coalesce(F.nullif(F.col("parts.family"), F.lit("NA")), F.lit("UNKNOWN")).alias("family"))
    spans = normalise_hits(hits).select("query_id", "subject_id", "qlo", "qhi").join(te, ["query_id", "subject_id"]).withColumn("hi", F.least("qhi", F.col("qlen").cast("long")))
    whole = islands.union_length(spans, ["query_id"], "qlo", "hi").withColumnRenamed("covered", "te_union_covered_bp")
    each = islands.union_length(spans, ["query_id", "family"], "qlo", "hi")
    best = te.groupBy("query_id", "family").agg(F.max("bitscore").alias("bits"), F.max_by("te_class", F.struct("bitscore", "subject_id")).alias("te_class"))
    top = ranks.first_per_group(each.join(best, ["query_id", "family"]), ["query_id"], [F.desc("covered"), F.desc("bits"), "family"])
    lengths = te.select("query_id", "qlen").distinct()
    return whole.join(lengths, "query_id").join(top.select("query_id", F.col("family").alias("te_dominant_family"), F.col("te_class").alias("te_dominant_class"), F.col("covered").alias("te_dominant_covered_bp")), "query_id").withColumn("te_union_coverage", F.col("te_union_covered_bp") / F.col("qlen")).drop("qlen")


def family_margin(ranked: DataFrame) -> DataFrame:
    """Best family by score with the margin to the next; a near tie abstains."""
    best = ranked.groupBy("query_id", F.col("parts.family").alias("family")).agg(F.max("score").alias("score"))
    return ranks.best_and_second(best, ["query_id"], "score", "family").withColumn("committed", F.col("second_score").isNull() | (F.col("margin") >= NEAR_TIE))
