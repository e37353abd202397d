"""Decisions, locus evidence and inserts on literal rows and against plain definitions."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from locusframe.functions import scalars as S, udfs as U
from locusframe.operators import greedy, ranks
from locusframe.plans import inserts as I, loci, models, policy as P, structure

SF = "/root/testdata/sf0.001"


def _plain_order(rows):
    """All orders by dominance, sums and kind, as a sort by pairwise comparison sees them."""

    def dominates(a, b):
        return all(x <= y for x, y in zip(a[:6], b[:6])) and a[:6] != b[:6]

    def first(i, j):
        if dominates(rows[i], rows[j]) != dominates(rows[j], rows[i]):
            return dominates(rows[i], rows[j])
        return (sum(rows[i][:6]), sum(rows[i][6:]), -i) < (sum(rows[j][:6]), sum(rows[j][6:]), -j)

    return {o for o in itertools.permutations(range(len(rows))) if all(first(a, b) for a, b in itertools.combinations(o, 2))}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=9, max_size=9), min_size=4, max_size=4))
def test_explanations_follow_every_pairwise_comparison(rows):
    order, alone = P.rank_explanations(rows)
    total = _plain_order(rows)
    assert not total or tuple(order) in total  # where comparisons cycle there is no such order
    best = rows[order[0]]
    assert alone == all(all(x <= y for x, y in zip(best[:6], rows[k][:6])) and best[:6] != rows[k][:6] for k in order[1:])


def test_decisions_are_consistent(spark):
    cases = models._observe(spark, SF, models._CASE)
    got = P.decide(cases).collect()
    assert len(got) == cases.count()
    for r in got:
        assert not (r.emit_te and r.emit_structural)
        if r.emit_te:
            assert r.best_explanation == "TE" and r.explanation_alone and r.robust_qc == "PASS_TE_LFDR" and r.has_insert and r.decision in ("TE_UNKNOWN", "TE_RESOLVED")
        if r.emit_structural:
            assert r.final_qc == "PASS_STRUCTURAL_INSERTION" and r.structural_log_evidence > 2 and r.artifact_posterior <= 0.65
        rows = P.rank_explanations
        assert math.isclose(r.te_posterior + r.non_te_posterior + r.artifact_posterior, 1, rel_tol=1e-9) and rows
    assert sum(r.emit_te for r in got) and sum(r.emit_structural for r in got)


def _plain_duplication(ref, pos, insert, least, most):
    """Longest exact copy of an insert's end before a place, or of its start behind it; the end wins ties."""
    best = (0, "")
    for n in range(least, most + 1):
        if n <= len(insert) and pos - n >= 0 and insert[-n:] == ref[pos - n : pos] and set(insert[-n:]) <= set("ACGT") and n > best[0]:
            best = (n, ref[pos - n : pos])
        if n <= len(insert) and pos + n <= len(ref) and insert[:n] == ref[pos : pos + n] and set(insert[:n]) <= set("ACGT") and n > best[0]:
            best = (n, ref[pos : pos + n])
    return best


def test_duplications_against_search():
    r = random.Random(2)
    hits = 0
    for _ in range(300):
        ref = "".join(r.choice("ACGT") for _ in range(400))
        pos = r.randrange(60, 340)
        insert = "".join(r.choice("ACGT") for _ in range(80))
        n = r.randrange(3, 30)
        insert = r.choice([insert + ref[pos - n : pos], ref[pos : pos + n] + insert, insert])
        kind, size, wrong, sequence, share = U.detect_duplication(ref, 0, pos, pos, insert, cap=0)
        want = _plain_duplication(ref, pos, insert, 3, 50)
        assert (size, sequence) == want and wrong == 0 and (kind == "NONE") == (want[0] == 0)
        hits += size > 3
    assert hits > 100
    ref = "ACGTTGCAAC" * 3 + "GGATCCTTAGCATTGACCATAG" + "TTGACCATAGCCGTAACGTCAT" * 2
    assert U.detect_duplication(ref, 0, 52, 52, "")[0] == "NONE"
    assert U.detect_duplication(ref, 0, 52, 42, "x")[:3] == ("DUP", 10, 0) or U.detect_duplication(ref, 0, 52, 42, "x")[0] in ("DUP", "UNCERTAIN")
    assert U.detect_duplication("ACGGTCATTACG" * 2 + "TTTTGCAGGCAT" * 2, 0, 12, 20, "x")[0] in ("DEL", "UNCERTAIN", "DUP")


def test_a_locus_and_its_decoys(spark):
    r = random.Random(5)
    ref = "".join(r.choice("ACGT") for _ in range(6000))
    ref = ref[:2985] + "C" + ref[2986:]  # the tail's last A is not part of the target site
    pos, tsd = 3000, ref[3000 - 14 : 3000]
    insert = "".join(r.choice("ACGT") for _ in range(279)) + "C" + "A" * 20 + tsd
    names = {n: None for n in ("tsd_len", "tsd_mismatches", "tsd_seq", "motif_log_odds", "a_share", "t_share", "repeat_share", "tsd_chance")}
    row = dict(te_class="SINE", superfamily="Alu", identity=0.93, aligned_len=280, element_start=0, element_end=280, element_length=280, polya_len=0, five_whole=True, three_whole=True, ltr_start=-1, ltr_end=-1, tir_identity=-1.0, helitron_start=-1, helitron_end=-1, n_alt=12, n_ref=10, insert_len=len(insert))
    schema = "id int, chrom string, bp_left bigint, bp_right bigint, insert string, strand string, te_class string, superfamily string, identity double, aligned_len int, element_start int, element_end int, element_length int, polya_len int, five_whole boolean, three_whole boolean, ltr_start int, ltr_end int, tir_identity double, helitron_start int, helitron_end int, n_alt int, n_ref int, insert_len int"
    table = spark.createDataFrame([(1, "c", pos, pos, insert, "+", *row.values()), (2, "c", pos + 900, pos + 900, insert, "+", *row.values()), (3, "gone", 5, 5, insert, "+", *row.values())], schema)
    from locusframe.sources.text import reference_blocks

    blocks = reference_blocks(spark.createDataFrame([("c", ref)], "name string, sequence string"))
    got = {x.id: x for x in loci.locus_evidence(table, blocks).collect()}
    assert got[1].tsd_len == 14 and got[1].tsd_seq == tsd and got[1].decoy_count == 100 and got[1].polya_len == 20  # the tail ends where its copy is taken off
    assert got[1].tsd_chance == pytest.approx(1 / 101) and got[2].tsd_len < 14 and got[1].log_vs_artifact > got[2].log_vs_artifact
    assert got[1].decoy_mean_exp_linkage < math.exp(got[1].log_vs_artifact) and got[3].tsd_len == 0 and set(names) <= set(got[1].asDict())


def test_structure_path(spark):
    row = ("ACGTACGTACGTACGTACGT" * 5 + "GATTACAGATTC" + "A" * 15, "PASS_INSERT_TE_ALIGNMENT", "Alu", "AluYa5", 0.95, 0.79, 0.1, 0.0, 0.2, 0.0, "TE_MODEL_IN_DISTRIBUTION", 0.4, "SINE", "+")
    names = "insert te_qc family subfamily identity coverage residual_share masked_share family_margin second_score model_label model_score te_class te_strand".split()
    df = spark.createDataFrame([row, (*row[:12], "DNA", "+"), ("", *row[1:])], names)
    got = structure.explain_sequence(df).collect()
    assert got[0].path == "0-100:TE_CORE:Alu/AluYa5,112-127:POLYA:POLY_A" and got[0].status == "RESOLVED" and got[0].poly_posterior > 0.99
    assert got[1].path == "0-100:TE_CORE:Alu/AluYa5" and got[1].poly_posterior == 0 and got[2].path == "NA"


def test_peaks_windows_and_texts(spark):
    peaks = spark.createDataFrame([("c", p, w) for p, w in ((100, 1.0), (190, 3.0), (280, 1.0), (500, 2.0))], "chrom string, p bigint, w double")
    assert sorted((r.pos, r.weight) for r in greedy.merge_peaks(peaks, ["chrom"], "p", "w").collect()) == [(168, 4.0), (280, 1.0), (500, 2.0)]
    windows = spark.createDataFrame([("c", 0, 100, 50, 2.0), ("c", 160, 300, 200, 1.0), ("c", 361, 400, 380, 5.0)], "chrom string, start bigint, end bigint, centre bigint, weight double")
    assert sorted((r.start, r.end, r.centre, r.weight) for r in greedy.merge_windows(windows, ["chrom"]).collect()) == [(0, 300, 100, 2.0), (361, 400, 380, 5.0)]
    texts = spark.createDataFrame([(1, "A" * n) for n in (5, 9, 7)] + [(2, "CC")], "k int, t string")
    assert sorted((r.k, len(r.t)) for r in ranks.longest_first(texts, ["k"], "t", 2).collect()) == [(1, 7), (1, 9), (2, 2)]
    assert sorted((r.k, len(r.t)) for r in ranks.longest_first(texts, ["k"], "t", 9, budget=6 * 81).collect()) == [(1, 9), (2, 2)]


def test_consensus_and_alignment(spark):
    same = spark.createDataFrame([(1, "acgt"), (1, "acgt"), (2, "t")], "e int, s string")
    assert sorted((r.e, r.consensus, r.reads) for r in I.event_consensus(same, ["e"], "s").collect()) == [(1, "ACGT", 2), (2, "T", 1)]
    with pytest.raises(Exception):
        I.event_consensus(spark.createDataFrame([(1, "a"), (1, "c")], "e int, s string"), ["e"], "s").collect()
    r = random.Random(7)
    element = "".join(r.choice("ACGT") for _ in range(300))
    library = spark.createDataFrame([("E1", element), ("E2", "".join(r.choice("ACGT") for _ in range(300)))], "name string, sequence string")
    changed = element[40:120] + "A" + element[121:240]
    back = element[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = spark.createDataFrame([(1, changed), (2, changed), (3, back[10:200]), (4, "ACGT" * 3)], "id int, insert string")
    got = {x.id: x for x in I.aligned_once(rows, "insert", lambda q: I.align_to_library(q, library)).collect()}
    assert got[1].subject == "E1" and got[1].strand == "+" and got[1].identity > 0.98 and got[2].subject == "E1" and got[3].strand == "-" and got[4].subject is None
    pairs = spark.createDataFrame([([(0, 10), (5, 20)], [False] * 8 + [True] * 4 + [False] * 8)], "i array<struct<start:int,end:int>>, m array<boolean>")
    assert pairs.select(I.informative_bases(F.col("i"), F.col("m")).alias("n")).first().n == 16


def test_scalars_without_a_query(spark):
    one = spark.range(1)
    val = lambda *c: tuple(one.select(*[x.alias(f"c{i}") for i, x in enumerate(c)]).first())
    assert val(S.without_copy(F.lit("ACGTGGGG"), F.lit("ACGA"), F.lit(1)), S.without_copy(F.lit("GG"), F.lit("GG"), F.lit(0)), S.is_internal(F.lit("MER41-int")), S.name_stem(F.lit("Gypsy-12_LTR"))) == ("GGGG", "GG", True, "Gypsy-12")
    hits = lambda *x: F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("start"), F.lit(b).alias("end")) for n, a, b in x))
    forms = val(*(S.insert_form(h, F.lit(5000)) for h in (hits(("L", 0, 400), ("L", 4600, 5000), ("L-int", 500, 4500)), hits(("L", 100, 4900)), hits(("L-int", 0, 900)), hits(("L", 0, 400)))))
    assert forms == ("full", "solo", "internal", "partial")
    assert np.isclose(val(S.base_shares(F.lit("AATTT"))["t"])[0], 0.6) and val(S.base_shares(F.lit("NN"))["a"]) == (0.30,)
