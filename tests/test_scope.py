"""Regions, settings, contracts, chunks and outputs."""

import os

import pytest
from pyspark.sql import functions as F, types as T

from locusframe.plans import reads as R
from locusframe.sinks import outputs
from locusframe.sources import scope


def test_regions():
    assert scope.parse_region("chr1") == scope.Region("chr1") and scope.parse_region("HLA:A:5-9") == scope.Region("HLA:A", 4, 9)
    for bad in ("", "c:", "c:1", "c:0-5", "c:9-5", "c:a-b", ":1-2", f"c:1-{2**31}"):
        with pytest.raises(ValueError):
            scope.parse_region(bad)
    assert scope.normalise_region(scope.Region("", 5, 9)) is None and scope.normalise_region(scope.Region("c", -3, 0)) == scope.Region("c", 0, 0) and scope.normalise_region(scope.Region("c", 9, 4)) == scope.Region("c", 9, 10)


def test_scan_of_a_region_and_the_example(spark):
    reads, truth = scope.example_reads(spark)
    every, some = scope.scan(reads), scope.scan(reads, scope.parse_region("syn1:20001-30000"))
    assert every.count() == 200 and {r.qname for r in some.collect()} == {r.qname for r in every.filter("ref_end > 20000 and pos < 30000").collect()}
    assert scope.scan(reads, scope.Region("other")).count() == 0
    sigs = R.signatures(R.gate(reads)).filter("source = 'CIGAR'")
    assert sigs.count() > 20 and sigs.join(truth, "pos", "left_anti").count() == 0 and scope.example_reads(spark)[0].exceptAll(reads).count() == 0


def test_names_and_settings(spark):
    head = spark.createDataFrame([("@HD\tVN:1",), ("@RG\tID:a\tSM:s1",), ("@RG\tID:b\tSM:s1",)], "value string")
    assert scope.sample_name(head, "/x/y.bam") == "s1" and scope.sample_name(head.limit(1), "/x/y.z.bam") == "y.z"
    with pytest.warns(UserWarning):
        scope.sample_name(head.unionByName(spark.createDataFrame([("@RG\tID:c\tSM:s2",)], "value string")), "f")
    with pytest.warns(UserWarning):
        got = scope.settings({"a": 1, "b": 2, "c": True, "d": 0.5}, {"LOCUSFRAME_A": "7", "LOCUSFRAME_B": "x", "LOCUSFRAME_C": "no"}, {"d": 0.1, "a": None})
    assert got == {"a": 7, "b": 2, "c": False, "d": 0.1}


def test_contract_and_chunks(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert scope.check_contract(df, ["a"]).holds and scope.check_contract(df, ["a"]).extra == ("b",) and scope.check_contract(df, ["c"]).missing == ("c",)
    assert scope.check_contract(df, T.StructType().add("a", T.LongType())).wrong == ("a",)
    spans = spark.createDataFrame([("c", 500, 25_500), ("d", 5, 5)], "chrom string, start bigint, end bigint")
    chunks = scope.plan_chunks(spans, 9000, 1000)
    assert sorted((r.start, r.end) for r in chunks.collect()) == [(500, 9000), (9000, 18_000), (18_000, 25_500)]
    heavy = scope.split_heavy(chunks.withColumn("bytes", F.when(F.col("start") == 9000, 30).otherwise(10)), "bytes", 1000)
    parts = sorted((r.start, r.end) for r in heavy.collect())
    assert len(parts) == 11 and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[0][0] == 500 and parts[-1][1] == 25_500


def test_parts_merge(spark):
    a, b = (spark.createDataFrame([(n, 2, False)], "seen bigint, passed bigint, finalised boolean") for n in (3, 4))
    assert tuple(scope.merge_counters([a, b], ["seen", "passed"]).first()) == (7, 4)
    with pytest.raises(Exception):
        scope.merge_counters([a, b.withColumn("finalised", F.lit(True))], ["seen"]).collect()
    assert [(r.part, r.seen) for r in scope.append_parts([a, b]).orderBy("part").collect()] == [(0, 3), (1, 4)]


CALL = "chrom string, pos bigint, bp_left bigint, bp_right bigint, insert_seq string, insert_len int, te_name string, family string, subfamily string, family_committed boolean, strand string, te_consensus_start int, te_consensus_end int, lfdr double, lfdr_qc string, ebh_selected boolean, conformal_qc string, genotype string, gq int, af double, alt_struct_reads int, ref_span_reads int, final_qc string"


def test_all_outputs_are_written_even_if_empty(spark, tmp_path):
    calls = spark.createDataFrame([("c", 99, 100, 104, "ACGT", 4, "AluY", "Alu", "AluY", True, "+", 0, 4, 0.01, "OK", True, "PASS_X", "0/1", 30, 0.5, 5, 5, "PASS")], CALL)
    contigs = spark.createDataFrame([("c", 1000, 0)], "name string, length int, rank int")
    from locusframe.sources.text import reference_blocks

    blocks = reference_blocks(spark.createDataFrame([("c", "ACGT" * 100)], "name string, sequence string"), bits=8)
    anchors = outputs.anchor_bases(calls, blocks)
    assert [tuple(r) for r in anchors.collect()] == [("c", 102, "C")]
    for name, some in (("full", calls), ("empty", calls.limit(0))):
        paths = outputs.write_outputs(some, some.select("chrom", "pos", "insert_seq"), {"reads": 5}, contigs, anchors, str(tmp_path / name))
        assert len(paths) == 4 and all(any(f.startswith("part-") or f == "_SUCCESS" for f in os.listdir(p)) for p in paths.values())
    vcf = [r.value for r in spark.read.text(str(tmp_path / "full/calls_vcf")).collect()]
    assert sum(not x.startswith("#") for x in vcf) == 1 and "chrom" in spark.read.text(str(tmp_path / "full/scientific_txt")).filter("value like '#%'").first().value
    rows = spark.read.csv(str(tmp_path / "full/calls_csv"), header=True)
    assert rows.columns[:2] == ["call_set", "vcf_pos"] and rows.columns[-1] == "tid" and "insert_seq" not in rows.columns and rows.first().vcf_pos == "102"
    assert outputs.placed_after(["a", "b", "c"], "a", "c") == ["a", "c", "b"]


def test_dumps(spark):
    f = spark.createDataFrame([("a b", "ACGT" * 25), ("c", "AC")], "name string, s string")
    assert [r.value for r in outputs.fasta_lines(f, "name", "s").collect()] == [">a_b\n" + "ACGT" * 20 + "\n" + "ACGT" * 5, ">c\nAC"]
    p = outputs.perf_summary(spark.createDataFrame([("a", 1.0), ("b", 9.0), ("c", 2.0)], "chunk string, seconds double"), top=1).first()
    assert (p.chunks, p.total, p.median, p.slowest[0].name) == (3, 12.0, 2.0, "b")
