"""All outputs of a run, and the diagnostic dumps beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import report

#: Columns that come before and after a call's own in the CSV.
LEADING, TRAILING = ("call_set", "vcf_pos"), ("te_qc", "sequence_family_candidate", "sequence_subfamily_candidate", "sequence_family_commit_eligible", "window_start", "window_end", "tid")


def placed_after(names: list[str], anchor: str, name: str) -> list[str]:
    """Column names with one moved behind an anchor; at the end where there is no such anchor."""
    rest = [n for n in names if n != name]
    at = rest.index(anchor) + 1 if anchor in rest else len(rest)
    return [*rest[:at], name, *rest[at:]]


def csv_rows(calls: DataFrame, call_set: str = "final") -> DataFrame:
    """Calls as the CSV has them: the set and the reported position first, the seven trailing columns last (NA where missing)."""
    own = [c for c in calls.columns if c not in LEADING + TRAILING]
    missing = [F.lit("NA").alias(c) if c not in calls.columns else F.col(c) for c in TRAILING]
    return calls.select(F.lit(call_set).alias("call_set"), report.reported_position(F.col("bp_left"), F.col("bp_right"), F.col("pos")).alias("vcf_pos"), *own, *missing)


def write_outputs(calls: DataFrame, ledger: DataFrame, summary: dict[str, object], contigs: DataFrame, anchors: DataFrame, folder: str, sample: str = "SAMPLE", insert_seq: bool = False, support_qnames: bool = False) -> dict[str, str]:
    """The four outputs of a run, each written even if it is empty; their paths by name."""
    paths = {n: f"{folder}/{n}" for n in ("scientific_txt", "evidence_ledger_tsv", "calls_vcf", "calls_csv")}
    optional = [n for n, wanted in (("insert_seq", insert_seq), ("support_qnames", support_qnames)) if wanted]
    shown = [c for c in calls.columns if c not in ("insert_seq", "support_qnames") or c in optional]
    report.write_summary(summary, calls.select(*shown), paths["scientific_txt"])
    report.write_ledger(ledger, paths["evidence_ledger_tsv"], tuple(optional))
    report.write_vcf(calls, contigs, anchors, paths["calls_vcf"], sample)
    report.write_csv(csv_rows(calls.select(*shown)), paths["calls_csv"])
    return paths


def anchor_bases(calls: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chrom, pos, base) of the reference before every distinct reported position; N where the reference has none."""
    from ..sources.text import reference_windows

    at = calls.select("chrom", report.reported_position(F.col("bp_left"), F.col("bp_right"), F.col("pos")).alias("pos")).filter("pos > 0").distinct()
    wanted = at.select(F.struct("chrom", "pos").alias("id"), "chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))
    found = reference_windows(wanted, blocks)
    return found.select("id.chrom", "id.pos", F.coalesce(F.nullif(F.upper(F.left("window", F.lit(1))), F.lit("")), F.lit("N")).alias("base"))


def fasta_lines(fragments: DataFrame, name: str, text: str, width: int = 80) -> DataFrame:
    """One row a fragment: its header without blanks and its sequence in lines of ``width``."""
    wrapped = F.regexp_replace(F.regexp_replace(text, f"(.{{{width}}})", "$1\n"), "\n$", "")
    return fragments.select(F.concat(F.lit(">"), F.regexp_replace(name, r"\s", "_"), F.lit("\n"), wrapped).alias("value"))


def write_fasta(fragments: DataFrame, name: str, text: str, path: str) -> None:
    """Fragments as FASTA text, part files in any order."""
    fasta_lines(fragments, name, text).write.mode("overwrite").text(path)


def write_hits(hits: DataFrame, path: str) -> None:
    """Alignments of fragments as tab-separated text with a header."""
    hits.write.mode("overwrite").csv(path, sep="\t", header=True)


def perf_summary(stages: DataFrame, name: str = "chunk", seconds: str = "seconds", top: int = 5) -> DataFrame:
    """One row: chunks, total, median and the slowest (name, seconds) of a run's stages."""
    slowest = F.slice(F.sort_array(F.collect_list(F.struct(F.col(seconds).alias("seconds"), F.col(name).alias("name"))), asc=False), 1, top)
    return stages.agg(F.count(F.lit(1)).alias("chunks"), F.sum(seconds).alias("total"), F.median(seconds).alias("median"), slowest.alias("slowest"))  # one row a chunk
