"""Domain plans, sources, sinks and streaming on literal rows."""

import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from locusframe.functions import seq
from locusframe.plans import reads as R, selection as S
from locusframe.sinks import report
from locusframe.sources import text
from locusframe.streaming import bins

READS = "qname string, flag int, tid int, chrom string, pos bigint, mapq int, c string, seq string, sa string, nm int"


def frame(spark, rows):
    return spark.createDataFrame(rows, READS).withColumn("cigar", seq.parse_cigar("c")).drop("c")


def locus_reads():
    """Eight reads with an insertion of 320 at 10,000, and three that span it untouched."""
    rows = []
    for i in range(8):
        s, e = 9000 + 3 * i, 11_000 - 3 * i
        rows.append((f"alt{i}", 0, 0, "c", s, 60, f"{10_000 - s}M320I{e - 10_000}M", "A" * (e - s + 320), None, 0))
    return rows + [(f"ref{i}", 0, 0, "c", 9000, 60, "2000M", "A" * 2000, None, 0) for i in range(3)]


@pytest.mark.parametrize(
    ("flag", "mapq", "length", "cigar", "sa", "nm", "want"),
    [
        (0x4, 60, 1000, "1000M", None, 0, False), (0x100, 60, 1000, "1000M", None, 0, False), (0, 60, 49, "49M", None, 0, False),
        (0, 20, 1000, "1000M", None, 0, False), (0, 21, 1000, "1000M", None, 0, True), (0, 0, 1000, "300M60I640M", None, 0, True),
        (0, 60, 1000, "150M60I150M60I150M", None, 0, False), (0, 60, 1000, "100S119M10D300M", None, 0, False), (0, 60, 1000, "100S120M10D300M", None, 0, True),
        (0, 60, 1000, "7H100S120M10D300M", None, 0, True), (0x800, 60, 1000, "300M", None, 61, False), (0x800, 60, 1000, "300M", None, 60, True), (0, 60, 1000, "300M60I300M", None, 500, True), (0, 0, 1000, "300M", "x,1,+,5M,1,1;", None, True),
    ],
)
def test_gate_decisions(spark, flag, mapq, length, cigar, sa, nm, want):
    got = R.gate(frame(spark, [("q", flag, 0, "c", 0, mapq, cigar, "A" * length, sa, nm)])).count()
    assert got == int(want)


def test_one_locus_end_to_end(spark):
    reads = frame(spark, locus_reads())
    assert tuple(R.gate_counters(reads).first()) == (11, 0, 11)
    gated = R.gate(reads)
    assert R.bins(gated, 100_000).select("bin").distinct().count() == 1
    sigs = R.signatures(gated)
    comps = R.components(sigs).collect()
    assert len(comps) == 1 and comps[0].anchor == 10_000 and comps[0].length == 320 and comps[0].cigar_reads == 8 and comps[0].strong
    t = R.tally(spark.createDataFrame([(1, "c", 10_000, 10_000), (2, "c", 10_400, 10_400)], "id int, chrom string, lo bigint, hi bigint"), sigs, gated)
    got = {r.id: (r.alt_reads, r.ref_reads) for r in t.collect()}
    assert got == {1: (8, 3), 2: (0, 11)}
    assert R.worth_ledger(t).count() == 2 and [r.id for r in R.worth_consensus(t, ["lo"]).collect()] == [1]


def test_signature_precedence(spark):
    rows = [
        ("ins", 0, 0, "c", 100, 60, "300M80I300M100S", "A", None, 0), ("unsure", 0, 0, "c", 100, 59, "300M80I300M100S", "A", None, 0),
        ("split", 0, 0, "c", 1000, 60, "500M600S", "A", "c,1511,+,700S400M,60,0;c,1501,-,700S400M,60,0;d,1501,+,900S200M,60,0;", 0), ("supp", 0x800, 0, "c", 1, 60, "400M90I400M", "A", None, 0),
    ]
    got = sorted((r.qname, r.source, r.pos, r.length) for r in R.signatures(frame(spark, rows)).collect())
    assert got == [("ins", "CIGAR", 400, 80), ("split", "SPLIT", 1500, 190), ("unsure", "CLIP", 700, 100)]


# Selection


LEDGER = {
    "row_id": "bigint", "chrom": "string", "tid": "int", "pos": "bigint", "bp_left": "bigint", "bp_right": "bigint", "te_annotation_class": "string", "mech_log_lr_vs_artifact": "double", "mech_counts_term": "double", "mech_counts_allele_byseq": "double",
    "allele_length": "int", "allele_byseq_span_lo": "bigint", "allele_byseq_span_hi": "bigint", "allele_byseq_extra_carriers": "int", "mech_decoy_count": "int", "mech_decoy_mean_exp_linkage": "double", "ref_span_reads": "int", "alt_indel_reads": "int",
    "te_union_coverage": "double", "te_union_covered_bp": "int", "te_dominant_class": "string", "te_dominant_family": "string", "alt_measured_lengths": "array<int>",
}


def ledger(spark, *rows):
    base = dict(chrom="c", tid=0, te_annotation_class="LINE", mech_log_lr_vs_artifact=0.0, mech_counts_term=0.0, mech_counts_allele_byseq=0.0, allele_length=300, allele_byseq_span_lo=0, allele_byseq_span_hi=0, allele_byseq_extra_carriers=0, mech_decoy_count=0, mech_decoy_mean_exp_linkage=0.0, ref_span_reads=9, alt_indel_reads=0, te_union_coverage=0.9, te_union_covered_bp=280, te_dominant_class="LINE", te_dominant_family="L1", alt_measured_lengths=None)
    full = [base | {"row_id": i, "bp_left": r["pos"], "bp_right": r["pos"]} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[k] for k in LEDGER) for r in full], ", ".join(f"{k} {t}" for k, t in LEDGER.items()))


def chosen(spark, q, *rows):
    return {r.rep_row: r for r in S.select_loci(ledger(spark, *rows), q).collect()}


def test_a_locus_is_tested_once_by_its_mean(spark):
    got = chosen(spark, 0.5, dict(pos=100, mech_log_lr_vs_artifact=math.log(8.0)), dict(pos=350, mech_log_lr_vs_artifact=math.log(2.0)), dict(pos=5000, mech_log_lr_vs_artifact=-5.0))
    assert set(got) == {0, 2} and math.isclose(got[0].mean_e, 5.0) and got[0].n_rows == 2
    assert got[0].selected and not got[2].selected and got[0].call == "TE" and got[2].call is None


def test_decoys_divide_and_collapse_zeroes(spark):
    noisy = [dict(pos=10_000 * i, te_annotation_class="SINE", mech_decoy_count=10, mech_decoy_mean_exp_linkage=3.0, mech_log_lr_vs_artifact=math.log(30.0)) for i in range(12)]
    assert all(math.isclose(r.mean_e, 10.0) for r in chosen(spark, 0.5, *noisy).values())
    dense = [dict(pos=1000 * i, ref_span_reads=1, mech_log_lr_vs_artifact=5.0) for i in range(102)]
    got = chosen(spark, 0.5, *dense, dict(pos=10_000_000, mech_log_lr_vs_artifact=9.0))
    assert sum(r.mean_e == 0 for r in got.values()) >= 2 and got[102].selected and all(r.m == 103 for r in got.values())


def test_alleles_join_and_huge_ratios_do_not_overflow(spark):
    extra = dict(allele_byseq_extra_carriers=2, mech_counts_term=1.0, mech_counts_allele_byseq=1.0 + math.log(4), allele_byseq_span_hi=600)
    got = chosen(spark, 0.9, dict(pos=0) | extra, dict(pos=500, allele_length=320) | extra, dict(pos=1000, allele_length=600) | extra)
    assert sorted((r.n_rows, round(r.mean_e, 6)) for r in got.values()) == [(1, 4.0), (2, 4.0)]
    top = chosen(spark, 0.5, *[dict(pos=i, mech_log_lr_vs_artifact=5000.0) for i in range(3)])
    assert math.isfinite(next(iter(top.values())).mean_e) or next(iter(top.values())).selected


def test_placement_and_measured_length(spark):
    rows = (dict(pos=1000, bp_left=900, bp_right=1100, mech_log_lr_vs_artifact=9.0, alt_indel_reads=4), dict(pos=1050, mech_log_lr_vs_artifact=3.0, alt_indel_reads=3), dict(pos=1090, mech_log_lr_vs_artifact=4.0, alt_indel_reads=1))
    assert chosen(spark, 1.0, *rows)[0].call_pos == 1050
    short = chosen(spark, 1.0, dict(pos=1, mech_log_lr_vs_artifact=9.0, alt_measured_lengths=[90, 110, 80]))
    assert short[0].call == "STRUCTURAL"
    led = ledger(spark, *rows)
    final = S.finalize(led, S.select_loci(led, 1.0)).collect()
    assert [(r.pos, r.family) for r in final] == [(1050, "L1")] and 0 < final[0].lfdr <= 1


def test_selection_survives_shift_and_repartition(spark):
    r = random.Random(4)
    rows = [dict(pos=r.randrange(4_000_000), mech_log_lr_vs_artifact=r.gauss(1, 4), te_annotation_class=r.choice(["LINE", "SINE"]), mech_decoy_count=r.randrange(5), mech_decoy_mean_exp_linkage=r.random() * 2) for _ in range(200)]
    led = ledger(spark, *rows)
    pick = lambda df: {(x.rep_row, round(x.mean_e, 9), x.selected) for x in S.select_loci(df, 0.3).collect()}
    want = pick(led)
    moved = led.withColumns({c: F.col(c) + 7_654_321 for c in ("pos", "bp_left", "bp_right")})
    assert pick(moved) == want and pick(led.repartition(7)) == want


# Sources and sinks


def test_sam_and_fasta(spark, tmp_path):
    sam = tmp_path / "x.sam"
    sam.write_text("@HD\tVN:1.6\n@SQ\tSN:b\tLN:9\n@SQ\tSN:a\tLN:9\nq1\t0\ta\t11\t60\t5M\t*\t0\t0\tACGTA\t*\tNM:i:2\tSA:Z:b,3,+,5M,1,0;\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\nq3\t256\ta\t1\t1\t1M\t*\t0\t0\t*\t*\nq4\t16\tb\t1\t9\t2M\t*\t0\t0\t*\t*\n")
    got = {r.qname: r for r in text.read_sam(spark, str(sam)).collect()}
    assert set(got) == {"q1", "q4"} and got["q1"].pos == 10 and got["q1"].tid == 1 and got["q1"].nm == 2 and got["q1"].sa == "b,3,+,5M,1,0;" and got["q4"].nm is None and got["q4"].tid == 0
    fa = tmp_path / "x.fa"
    fa.write_text(">one#SINE/Alu extra\nacgt\nAC\n>empty\n>two\nTTTT\n")
    lib = text.read_fasta(spark, str(fa))
    assert sorted(tuple(r) for r in lib.collect()) == [("one#SINE/Alu", "ACGTAC", "GTACGT"), ("two", "TTTT", "AAAA")]
    blocks = text.reference_blocks(lib, 2)
    ask = spark.createDataFrame([(1, "two", 1, 9), (2, "one#SINE/Alu", 2, 5), (3, "none", 0, 3), (4, "two", -5, 2)], "id int, chrom string, start bigint, end bigint")
    assert {r.id: r.window for r in text.reference_windows(ask, blocks, 2).collect()} == {1: "TTT", 2: "GTA", 3: "", 4: "TT"}


def test_tables(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("q\ts\t90.0\t10\t1\t0\t1\t10\t1\t10\t1e-5\t20\nbroken\nx\ts\t1\t1\t1\t1\t1\t1\t1\t1\t1\t1\n")
    known = spark.createDataFrame([("q",)], "query_id string")
    assert [r.subject_id for r in text.read_hits(spark, str(tmp_path / "h.tsv"), known).collect()] == ["s"]
    (tmp_path / "b.bed").write_text("# c\ntrack x\nc1\t5\t9\tname\n")
    assert [tuple(r) for r in text.read_bed(spark, str(tmp_path / "b.bed")).collect()] == [("c1", 5, 9)]
    with gzip.open(tmp_path / "v.vcf.gz", "wt") as f:
        f.write("##x\n#CHROM\nc1\t7\t.\tA\tAT\t9\tPASS\tSVTYPE=INS;FLAG\n")
    v = text.read_vcf(spark, str(tmp_path / "v.vcf.gz")).first()
    assert v.pos == 7 and v.info == {"SVTYPE": "INS", "FLAG": ""}
    (tmp_path / "l.tsv").write_text("chrom\tpos\tbp_left\tbp_right\tcandidate_retention_reason\tmech_log_lr_vs_artifact\nz\t5\t5\t5\tEVALUATED\t2.5\nz\t6\t6\t6\tSUMMARY\t1\na\t7\tbad\t7\tEVALUATED\t\n")
    led = sorted((r.row_id, r.chrom, r.tid, r.bp_left, r.mech_log_lr_vs_artifact, r.te_annotation_class) for r in text.read_ledger(spark, str(tmp_path / "l.tsv")).collect())
    assert [x[1:] for x in led] == [("z", 0, 5, 2.5, "NA"), ("a", 1, -1, 0.0, "NA")]
    (tmp_path / "r.txt").write_text("n\t3\n\n#chrom\tpos\nc\t4\n")
    assert [tuple(r) for r in text.read_report(spark, str(tmp_path / "r.txt")).collect()] == [("c", "4")]


CALLS = "chrom string, pos bigint, bp_left bigint, bp_right bigint, insert_seq string, insert_len int, te_name string, family string, subfamily string, family_committed boolean, strand string, te_consensus_start int, te_consensus_end int, lfdr double, lfdr_qc string, ebh_selected boolean, conformal_qc string, genotype string, gq int, af double, alt_struct_reads int, ref_span_reads int, final_qc string"


def test_vcf_round_trip(spark, tmp_path):
    calls = spark.createDataFrame(
        [("b", 9, 10, 14, "ACG", 3, "AluY", "Alu", "AluY", True, "+", 0, 280, 0.001, "OK", True, "NA", "0/1", 40, 0.5, 5, 5, "PASS"), ("a", 5, 100, 900, None, 320, None, None, None, False, "NA", -1, -1, None, "LFDR_NOT_EVALUATED", False, "NA", "./.", 0, 0.0, 1, 0, "X"), ("a", -1, -1, -1, "A", 1, "x", "x", "x", True, "+", 0, 1, 1.0, "OK", True, "NA", "0/1", 1, 0.1, 1, 1, "Q")],
        CALLS,
    )
    contigs = spark.createDataFrame([("a", 0, 1000), ("b", 1, 500)], "name string, rank int, length int")
    report.write_vcf(calls, contigs, spark.createDataFrame([("b", 12, "T")], "chrom string, pos bigint, base string"), str(tmp_path / "out"), "S1")
    back = text.read_vcf(spark, str(tmp_path / "out")).collect()
    assert [(r.chrom, r.pos, r.ref, r.alt, r["filter"]) for r in back] == [("a", 100, "N", "<INS>", "FAM_ABSTAIN;IMPRECISE;UNCALIB;ALTSEQ_MISSING"), ("b", 12, "T", "TACG", "PASS")]
    assert back[1].info["MEINFO"] == "AluY,1,280,+" and back[1].info["CIPOS"] == "-2,2" and back[0].info["SVLEN"] == "320" and "MEINFO" not in back[0].info
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines[0] == "##fileformat=VCFv4.2" and [x.split("\t")[5] for x in lines if not x.startswith("#")] == [".", "30.00"]


def test_csv_ledger_and_summary(spark, tmp_path):
    df = spark.createDataFrame([("c", 'say "hi",\r\nthere', 1)], "chrom string, note string, n int")
    report.write_csv(df, str(tmp_path / "csv"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').collect()] == [("c", 'say "hi", there', "1")]
    report.write_ledger(df.withColumn("insert_seq", F.lit("A")), str(tmp_path / "led"))
    assert "insert_seq" not in spark.read.csv(str(tmp_path / "led"), sep="\t", header=True).columns
    report.write_summary({"reads": 3}, df.select("chrom", "n"), str(tmp_path / "sum"))
    assert [tuple(r) for r in text.read_report(spark, str(tmp_path / "sum")).collect()] == [("c", "1")]


# Streaming


def test_streamed_loci_are_the_batch_loci(spark, tmp_path):
    r = random.Random(6)
    data = sorted((f"k{r.randrange(2)}", p) for p in (r.randrange(200_000) for _ in range(400)))
    data.sort(key=lambda x: x[1])
    schema = "k string, p bigint"
    for i in range(4):
        spark.createDataFrame(data[100 * i : 100 * i + 100], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    end = spark.createDataFrame([("end", 10_000_000)], schema)  # moves the watermark past all
    end.coalesce(1).write.parquet(str(tmp_path / "in/9"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    bins.write_ledger(bins.loci(stream, ["k"], "p", 300, 100_000), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).select("k", "first", "last", "n").collect() if x.k != "end"}
    batch = {tuple(x) for x in bins.loci(spark.createDataFrame(data, schema), ["k"], "p", 300, 0).select("k", "first", "last", "n").collect()}
    from locusframe.operators.islands import assign_islands

    plain = assign_islands(spark.createDataFrame(data, schema), ["k"], "p", 300).groupBy("k", "island").agg(F.min("p"), F.max("p"), F.count("*")).drop("island")
    assert got == batch == {tuple(x) for x in plain.collect()}


def test_bin_parts_add_up(spark):
    df = spark.createDataFrame([("a", 5, 25), ("a", 12, 13), ("a", 19, 20)], "k string, p bigint, e bigint")
    got = bins.bin_counts(df, ["k"], "p", "e", 10, 0).groupBy("bin").agg(F.sum("members"), F.sum("owned"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 1), (1, 3, 2), (2, 2, 0)]


def test_entry_runs_and_names_match():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) >= 60


def test_equal_alignments_stay_apart_where_reads_have_a_key(spark):
    alike = [("q", 0, 0, "c", 3000, 60, c, "A" * 4100, None, 0) for c in ("100S4000M", "60S4000M", "4000M")]
    reads = frame(spark, alike).withColumn("read", F.length("qname") + F.size("cigar") * 10 + F.col("cigar")[0]["len"]).withColumn("ref_end", seq.reference_end(F.col("pos"), F.col("cigar")))
    sites = R.read_sites(reads)
    windows = spark.createDataFrame([(1, "c", 2990, 3010)], "id int, chrom string, start bigint, end bigint")
    assert sorted(r.read for r in R.local_signals(sites, windows).collect()) == [81, 121]
    places = spark.createDataFrame([(1, "c", 3600, 3610)], "id int, chrom string, lo bigint, hi bigint")
    # Of eight windows two lie before the reads, one holds the two clips, five are crossed by all three.
    got = R.background_signal(places, sites, reads).first()
    assert (got.background_reads, got.background_hits) == (3 * 5 + 2, 2)


def test_selection_rates_positions_and_not_rows(spark, monkeypatch):
    seen, near, assign = [], S.signal.sum_near, S.islands.assign_islands
    monkeypatch.setattr(S.signal, "sum_near", lambda df, *a, **k: (seen.append(df.count()), near(df, *a, **k))[1])
    monkeypatch.setattr(S.islands, "assign_islands", lambda df, *a, **k: (seen.append(df.count()), assign(df, *a, **k))[1])
    apart = [dict(pos=p, mech_log_lr_vs_artifact=math.log(e)) for p, e in ((100, 2.0), (100, 6.0), (100, 6.0), (300, 6.0), (9000, 3.0))]
    dense = [dict(pos=5_000_000 + i // 4, ref_span_reads=1, mech_log_lr_vs_artifact=float(i % 4)) for i in range(104)]
    loci, _, _ = S.rank_loci(ledger(spark, *apart, *dense), 1.0)
    # The first of equal rows stands for its locus; where all is collapsed, so do rows by position and id.
    assert sorted((r.n_rows, round(r.mean_e, 9), r.first_pos, r.rep_row) for r in loci.collect()) == [(1, 3.0, 9000, 4), (4, 5.0, 100, 1), (104, 0.0, 5_000_000, 5)]
    assert seen == [29, 29]


def test_calls_settle_positions_and_not_rows(spark, monkeypatch):
    seen, settle = [], S.settle
    monkeypatch.setattr(S, "settle", lambda df: (seen.append(df.count()), settle(df))[1])
    wide, near, few = dict(pos=1000, bp_left=900, bp_right=1100, mech_log_lr_vs_artifact=9.0, alt_indel_reads=4), dict(pos=1050, mech_log_lr_vs_artifact=3.0, alt_indel_reads=3), dict(pos=1090, mech_log_lr_vs_artifact=4.0, alt_indel_reads=1)
    led = ledger(spark, *[near] * 10, *[wide] * 30, *[few] * 10, dict(pos=50_000, mech_log_lr_vs_artifact=-5.0))
    selected = S.select_loci(led, 1.0)
    assert sorted((r.n_rows, r.rep_row, r.selected, r.call, r.call_pos) for r in selected.collect()) == [(1, 50, False, None, -1), (50, 10, True, "TE", 1050)]
    assert [(r.pos, r.bp_left, r.bp_right) for r in S.finalize(led, selected).collect()] == [(1050, 900, 1100)]
    assert max(seen) == 4
    assert chosen(spark, 1.0, dict(pos=1, row_id=None, mech_log_lr_vs_artifact=9.0))[None].call == "TE"


def test_loci_window_positions_and_not_rows(spark, monkeypatch):
    seen, assign = [], S.islands.assign_islands
    monkeypatch.setattr(S.islands, "assign_islands", lambda df, *a, **k: (seen.append(df.count()), assign(df, *a, **k))[1])
    data = [(i, 0, "c", p, p, 0, None, None, None) for i, p in enumerate((5, 5, 5, 200, 900, 900))]
    rows = spark.createDataFrame(data, "row_id int, tid int, chrom string, pos bigint, bp_left bigint, allele_byseq_extra_carriers int, allele_byseq_span_lo bigint, allele_byseq_span_hi bigint, allele_length int")
    assert {r.row_id: r.locus for r in S.merge_loci(rows).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2} and seen == [3]
