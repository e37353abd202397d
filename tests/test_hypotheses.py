"""Hypotheses and fragments on literal rows."""

from pyspark.sql import functions as F

from locusframe.plans import hypotheses as H, reads as R

from .test_plans import frame


def test_pairs_and_singles(spark):
    points = [(1, "L", p) for p in (100, 101, 102, 400)] + [(1, "R", p) for p in (110, 111, 900)] + [(2, "L", 50), (2, "L", 52)]
    c = H.side_clusters(spark.createDataFrame(points, "component int, side string, pos bigint"), spark.createDataFrame([(1, 105), (2, 51)], "component int, anchor bigint"))
    got = sorted((r.component, r.lo, r.hi, r.support, r["rank"]) for r in H.order_hypotheses(H.enumerate_pairs(c)).collect())
    assert got == [(1, 101, 111, 5, 1), (2, 52, 52, 2, 1)]


def test_fragments_and_concordance(spark):
    insert = "ACGTTGCAAGGCTTAACCGGATAT" * 3
    n = len(insert)
    rows = [("t", 0, 0, "c", 0, 60, f"300M{n}S", "G" * 300 + insert, None, 0), ("l", 0, 0, "c", 300, 60, f"{n}S300M", insert + "G" * 300, None, 0), ("x", 0, 0, "c", 0, 60, "300M30S", "G" * 300 + "T" * 30, None, 0), ("f", 0, 0, "c", 0, 60, f"250M{n}I50M", "G" * 250 + insert + "C" * 50, None, 0)]
    gated = frame(spark, rows).withColumn("ref_end", F.col("pos") + 300)
    f = H.clip_fragments(gated)
    assert sorted((r.qname, r.kind, r.pos, r.sequence == insert, r.anchor_len) for r in f.collect()) == [("f", "CIGAR", 250, True, 50), ("l", "LEAD", 300, True, 300), ("t", "TAIL", 300, True, 300), ("x", "TAIL", 300, False, 300)]
    inserts = spark.createDataFrame([(1, insert)], "id int, insert string")
    got = H.concordance(f.withColumn("id", F.lit(1)), inserts).first()
    assert (got.full_reads, got.lead_agree, got.tail_agree, got.concordant) == (1, 1, 1, True)
    clips = H.concordance(f.filter("kind <> 'CIGAR'").withColumn("id", F.lit(1)), inserts).first()
    assert (clips.full_reads, clips.lead_agree, clips.tail_agree, clips.concordant) == (0, 1, 1, False)  # clips alone have no insert to agree with
    assert R.worth_ledger(spark.createDataFrame([(0, 0), (1, 0)], "alt_reads int, ref_reads int")).count() == 1


def test_what_is_worth_assembling(spark):
    rows = [(1, 1, 0, 0, 0, 0, 0, 0), (2, 1, 0, 0, 2, 1, 1, 9), (3, 1, 0, 0, 1, 1, 1, 0), (4, 1, 0, 0, 3, 3, 0, 1), (5, 1, 0, 0, 3, 3, 0, 2), (6, 1, 0, 1, 1, 0, 0, 9), (7, 2, 0, 0, 0, 0, 0, 5)]
    t = spark.createDataFrame(rows, "id int, component int, alt_cigar int, alt_split int, alt_reads int, alt_left_clip int, alt_right_clip int, ref_reads int")
    assert sorted(r.id for r in R.worth_consensus(t, ["id"]).collect()) == [1, 2, 4, 6, 7]


def test_component_hypotheses_whole(spark):
    components = spark.createDataFrame([(1, "c", 1000, 990, 1010), (2, "c", 50_000, 50_000, 50_000)], "component int, chrom string, anchor bigint, seed_left bigint, seed_right bigint")
    candidates = spark.createDataFrame([(1, 1500, True), (1, 9000, False)], "component int, pos bigint, precise boolean")
    fragments = spark.createDataFrame([(1, "SPLIT", "L", 995), (1, "SPLIT", "R", 1012), (1, "CIGAR", None, 1650), (1, "CIGAR", None, 7000), (1, "LEAD", "L", 995)], "component int, kind string, side string, pos bigint")
    found = H.search_windows(components, candidates, fragments)
    spans = {r.component: (r.start, r.end) for r in found.collect()}
    assert spans == {1: (790, 1850), 2: (49_800, 50_200)}
    reads = frame(spark, [("i", 0, 0, "c", 700, 60, "300M60I300M", "A", None, 0), ("j", 0, 0, "c", 702, 60, "300M60I300M", "A", None, 0), ("l", 0, 0, "c", 1100, 60, "40S300M", "A", None, 0)])
    signals = R.local_signals(R.read_sites(reads), found.select(F.col("component").alias("id"), "chrom", "start", "end"))
    got = [(r.component, r.lo, r.hi, r.support, r.priority, r["rank"]) for r in H.breakpoint_hypotheses(found, signals, fragments).orderBy("component", "rank").collect()]
    assert got == [(1, 995, 1012, 2, 0, 1), (1, 1002, 1002, 2, 4, 2), (1, 1650, 1650, 1, 1, 3), (1, 995, 995, 1, 3, 4), (1, 1100, 1100, 1, 5, 5), (2, 50_000, 50_000, 1, 1 << 30, 1)]
    kept = H.diverse(H.breakpoint_hypotheses(found, signals, fragments).filter("component = 1"), 2).orderBy("choice").collect()
    assert [(r.lo, r.hi) for r in kept] == [(995, 1012), (1650, 1650)]


def test_splits_flanks_and_claims(spark):
    claims = spark.createDataFrame([("a", 1, 100, 300, False), ("a", 2, 400, 500, False), ("b", 1, 0, 50, True)], "read string, ord int, qstart int, qend int, reverse boolean")
    seen = spark.createDataFrame([("a", 101, 302, False), ("a", 400, 500, True)], "read string, qstart int, qend int, reverse boolean")
    assert {(r.read, r.ord): r.reliable for r in H.reliable_claims(claims, seen).collect()} == {("a", 1): True, ("a", 2): False, ("b", 1): True}
    rows = [("a", 0, "c", "c", 1000, 500, 1000, 0, 500, False, 150, 60, 3, True, False), ("a", 1, "c", "c", 1000, 1005, 1400, 700, 1100, False, 150, 60, 0, False, True), ("a", 2, "d", "c", 1000, 10, 90, 480, 560, False, 80, 60, 0, False, False)]
    records = spark.createDataFrame(rows, "read string, ord int, chrom string, component_chrom string, anchor int, ref_start int, ref_end int, qstart int, qend int, reverse boolean, anchor_len int, mapq int, nm int, primary boolean, large_indel boolean")
    got = H.flank_and_mate(records, 200).first()
    assert (got.flank.ord, got.mate.ord, got.implied) == (0, 1, 195)


def test_small_rules(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first().x
    assert [val(H.least_insertion(F.lit(a), F.lit(b))) for a, b in ((2, 2), (1, 0), (3, 4), (0, 0))] == [35, 50, 50, 50]
    assert val(H.is_local(F.lit(5000), F.lit(100), F.array(F.lit(4100)))) and not val(H.is_local(F.lit(5200), F.lit(100), F.array(F.lit(4100))))
    assert [val(H.weak_anchor(F.lit(a), F.lit(n))) for a, n in ((0, 9), (19, 0), (100, 12), (100, 13))] == [False, True, False, True]
    ins = spark.createDataFrame([("r", 1, 90, 0, False), ("r", 2, 80, 1, False), ("r", 3, 70, 2, False), ("r", 4, 60, 3, True), ("r", 5, 55, 4, True), ("r", 6, 51, 5, True)], "read string, pos int, length int, start int, local boolean")
    assert sorted(r.pos for r in H.choose_insertions(ins).collect()) == [1, 2, 4, 5]
    f = H.feasibility(spark.createDataFrame([(0, 2, 1, 1, 2, 0, 0), (0, 1, 1, 1, 2, 0, 0), (0, 0, 1, 0, 1, 0, 0), (1, 0, 0, 0, 1, 0, 0)], "full_context int, partial_context int, left_anchor int, right_anchor int, event_reads int, alt_split int, alt_cigar int")).collect()
    assert [(r.validator_qc[10:], r.gate_reason[7:]) for r in f] == [("PASS", ""), ("NO_PRECISE_OR_FULL_CONTEXT", "NO_PRECISE_OR_FULL_CONTEXT"), ("NO_BILATERAL_ANCHOR", "NO_BILATERAL_ANCHOR"), ("PASS", "NO_BILATERAL_ANCHOR")]
