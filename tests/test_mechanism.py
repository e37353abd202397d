"""Annotation and mechanism terms on literal rows."""

import math

from pyspark.sql import functions as F

from locusframe.plans import annotation as A, mechanism as M
from locusframe.sources.text import HITS


def test_subjects_coverage_and_margin(spark):
    hits = spark.createDataFrame(
        [
            ("q", "AluY#SINE/Alu", 90.0, 100, 1, 0, 1, 100, 1, 100, 1e-20, 150.0), ("q", "AluY#SINE/Alu", 80.0, 50, 1, 0, 81, 130, 200, 151, 1e-8, 60.0),
            ("q", "L1HS#LINE/L1", 95.0, 40, 1, 0, 161, 200, 1, 40, 1e-9, 70.0), ("q", "SAT#Satellite", 99.0, 200, 1, 0, 1, 200, 1, 200, 1e-30, 10.0),
        ],
        HITS,
    )
    queries = spark.createDataFrame([("q", 200)], "query_id string, qlen int")
    ranked = A.subjects(hits, queries)
    got = {r.subject_id: r for r in ranked.collect()}
    alu = got["AluY#SINE/Alu"]
    assert math.isclose(alu.identity, (90 * 100 + 80 * 50) / 15000) and alu.covered == 130 and alu.strand == "+" and (alu.slo, alu.shi) == (0, 200)
    assert [r["rank"] for r in sorted(got.values(), key=lambda r: r.evalue)] == [1, 2, 3]
    classes = spark.createDataFrame([("AluY#SINE/Alu", "SINE"), ("L1HS#LINE/L1", "LINE"), ("SAT#Satellite", "NonTE")], "subject_id string, te_class string")
    c = A.te_coverage(hits, ranked, classes).first()
    assert (c.te_union_covered_bp, c.te_dominant_family, c.te_dominant_class, c.te_dominant_covered_bp) == (170, "AluY", "SINE", 130)
    m = A.family_margin(ranked.filter("subject_id not like 'SAT%'")).first()
    assert m.best == "AluY" and m.committed and m.margin > 0.1


def test_duplication_models(spark):
    df = spark.createDataFrame([("DNA", "hAT-Charlie"), ("DNA", "P"), ("DNA", "Pogo"), ("LINE", "L1"), ("DNA", "TcMar-Tigger"), ("LTR", None)], "te_class string, superfamily string")
    got = {(r.te_class, r.superfamily): r.tsd_model for r in M.with_duplication_model(df).collect()}
    assert got["DNA", "hAT-Charlie"].modal == 8 and got["DNA", "P"].present == 0.90 and got["DNA", "Pogo"].spread == 0.6 and got["LINE", "L1"].mean == 15.0 and got["DNA", "TcMar-Tigger"].motif == "TA" and got["LTR", None].modal == 5
    total = M.with_duplication_model(df).select("te_class", "superfamily", F.explode(F.sequence(F.lit(0), F.lit(400))).alias("t")).join(M.with_duplication_model(df), ["te_class"]).select(M.log_p_length(F.col("tsd_model"), F.col("t")).alias("l"))
    assert all(r.l <= 0 for r in total.limit(500).collect())


def test_terms(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.cast("double").alias("x")).first().x
    assert math.isclose(val(M.chance_duplication(F.lit(4), F.lit(1), F.lit(0.0))), (1 + 12) / 256)
    assert math.isclose(val(M.chance_duplication(F.lit(4), F.lit(0), F.lit(0.5))), 0.5 / 256 + 0.5)
    tail = math.log(0.85 / 25) - 20 / 25 - (20 * math.log(0.3) + math.log(0.7))
    assert math.isclose(val(M.tail_term(F.lit(20), F.lit(0.3), 0.9)), math.log(0.9 * math.exp(tail) + 0.1), rel_tol=1e-9)
    assert val(M.tail_term(F.lit(0), F.lit(0.3), 0.9)) < 0
    assert val(M.ends_term(F.lit(0), F.lit(300), F.lit(300), F.lit(True), F.lit(True), 0.8)) == 0
    n = math.log(0.8 * 201 + 0.2)
    assert math.isclose(val(M.ends_term(F.lit(0), F.lit(100), F.lit(300), F.lit(True), F.lit(False), 0.8)), n + math.log(0.2), rel_tol=1e-9)
    model = F.lit(None).cast(M.MODEL)
    model = F.from_json(F.lit('{"present":0.95,"modal":2,"spread":0.2,"mean":0,"motif":"TA"}'), M.MODEL)
    with_motif = val(M.tsd_term(model, F.lit(2), F.lit(0), F.lit("TA"), F.lit(0.0), F.lit(-1.0)))
    without = val(M.tsd_term(model, F.lit(2), F.lit(0), F.lit("GC"), F.lit(0.0), F.lit(-1.0)))
    assert math.isclose(with_motif - without, math.log(0.9 * 16 + 0.1) - math.log(0.1), rel_tol=1e-6)
    assert val(M.tsd_term(model, F.lit(2), F.lit(0), F.lit("TA"), F.lit(0.0), F.lit(0.5))) < with_motif
