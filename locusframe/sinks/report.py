"""Sinks for final calls: VCF text, CSV with scrubbed fields, ledgers and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WIDEST, QUAL_CAP = 200, 1000.0


def reported_position(left: Column, right: Column, pos: Column) -> Column:
    """1-based position of a call: the middle of a narrow interval, else its left end, else the position; -1 without any."""
    narrow = (left >= 0) & (left < right) & (right - left <= WIDEST)
    return F.when(narrow, F.greatest(F.lit(1), F.floor((left + right) / 2))).when(left >= 1, left).when(left == 0, F.lit(1)).when(pos >= 0, pos + 1).otherwise(F.lit(-1)).cast("long")


def quality(lfdr: Column, evaluated: Column) -> Column:
    """Phred of the false-discovery rate, capped; a point where it was not evaluated."""
    value = F.least(-10 * F.log10(F.greatest(lfdr, F.lit(1e-100))), F.lit(QUAL_CAP))
    return F.when(~evaluated | lfdr.isNull() | F.isnan(lfdr), F.lit(".")).otherwise(F.format_string("%.2f", value))


def filters(c: dict[str, Column]) -> Column:
    """The FILTER field in its fixed order, PASS where nothing applies."""
    flags = F.array_compact(F.array(
        F.when(~c["family_committed"], "FAM_ABSTAIN"), F.when((c["bp_left"] < 0) | (c["bp_right"] - c["bp_left"] > WIDEST), "IMPRECISE"),
        F.when(~c["ebh_selected"] & ~c["conformal_qc"].startswith("PASS_"), "UNCALIB"), F.when(F.coalesce(c["insert_seq"], F.lit("")) == "", "ALTSEQ_MISSING"),
    ))
    return F.when(F.size(flags) > 0, F.array_join(flags, ";")).otherwise("PASS")


def element_info(c: dict[str, Column]) -> Column:
    """NAME,START,END,POLARITY where all four are known, else null."""
    known = c["strand"].isin("+", "-") & c["family_committed"] & (c["te_consensus_start"] >= 0) & (c["te_consensus_start"] < c["te_consensus_end"])
    return F.when(known, F.concat_ws(",", F.coalesce(c["te_name"], F.lit("UNKNOWN")), (c["te_consensus_start"] + 1).cast("string"), c["te_consensus_end"].cast("string"), c["strand"]))


def vcf_lines(calls: DataFrame, contigs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(rank, pos, line) of the calls that have a coordinate. ``contigs``: name, rank; ``anchors``: chrom, pos, base (N where missing)."""
    c = {n: F.col(n) for n in calls.columns}
    placed = calls.withColumn("_pos", reported_position(c["bp_left"], c["bp_right"], c["pos"])).filter("_pos > 0")
    ranked = placed.join(F.broadcast(contigs.select(F.col("name").alias("chrom"), "rank")), "chrom", "left").join(anchors.select("chrom", F.col("pos").alias("_pos"), "base"), ["chrom", "_pos"], "left")
    base, insert = F.coalesce("base", F.lit("N")), F.coalesce("insert_seq", F.lit(""))
    alt = F.when(insert == "", F.lit("<INS>")).otherwise(F.concat(base, insert))
    length = F.when(insert == "", F.coalesce("insert_len", F.lit(0))).otherwise(F.length(insert))
    interval = F.when((c["bp_right"] > c["bp_left"]) & (c["bp_left"] >= 0), F.format_string("CIPOS=%d,%d", c["bp_left"] - F.col("_pos"), c["bp_right"] - F.col("_pos")))
    meinfo = element_info(c)
    info = F.array_join(F.array_compact(F.array(
        F.lit("SVTYPE=INS"), F.concat(F.lit("SVLEN="), length.cast("string")), interval, F.concat(F.lit("MEI="), F.coalesce(c["te_name"], F.lit("UNKNOWN"))), F.concat(F.lit("MEINFO="), meinfo),
        F.concat(F.lit("FAM="), F.coalesce(c["family"], F.lit("UNKNOWN"))), F.concat(F.lit("SUBFAM="), F.coalesce(c["subfamily"], F.lit("NA"))), F.concat(F.lit("FAMSTATUS="), F.when(c["family_committed"], "COMMITTED").otherwise("ABSTAINED")),
        F.when(c["ebh_selected"], "EBHSEL"), F.concat(F.lit("QC="), F.coalesce(c["final_qc"], F.lit("NA"))),
    )), ";")
    alt_n, ref_n = F.greatest(F.lit(0), c["alt_struct_reads"]), F.greatest(F.lit(0), c["ref_span_reads"])
    sample = F.concat_ws(":", c["genotype"], c["gq"].cast("string"), (alt_n + ref_n).cast("string"), F.concat_ws(",", ref_n.cast("string"), alt_n.cast("string")), F.format_string("%.4g", c["af"]))
    line = F.concat_ws("\t", "chrom", F.col("_pos").cast("string"), F.lit("."), base, alt, quality(c["lfdr"], c["lfdr_qc"] != "LFDR_NOT_EVALUATED"), filters(c), info, F.lit("GT:GQ:DP:AD:AF"), sample)
    return ranked.select(F.coalesce("rank", F.lit(1 << 30)).alias("rank"), F.col("_pos").alias("pos"), line.alias("line"))


def write_vcf(calls: DataFrame, contigs: DataFrame, anchors: DataFrame, path: str, sample: str) -> None:
    """A VCF as one file of text: final calls are few, so the ordered lines go through one task."""
    spark: SparkSession = calls.sparkSession
    head = ["##fileformat=VCFv4.2", "##source=locusframe"] + [f"##contig=<ID={r['name']},length={r['length']}>" for r in contigs.orderBy("rank").collect()]
    head += ['##ALT=<ID=INS,Description="Insertion whose bases are not assembled">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + sample]
    header = spark.createDataFrame([(-1, i, h) for i, h in enumerate(head)], "rank int, pos bigint, line string")
    header.unionByName(vcf_lines(calls, contigs, anchors)).orderBy("rank", "pos", "line").select("line").coalesce(1).write.mode("overwrite").text(path)


def scrub(value: Column) -> Column:
    """A field without line breaks."""
    return F.regexp_replace(value, r"[\r\n]+", " ")


def write_csv(calls: DataFrame, path: str) -> None:
    """Calls as CSV with minimal quoting, doubled quotes and no breaks inside fields."""
    text = [scrub(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in calls.dtypes]
    calls.select(*text).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def write_ledger(ledger: DataFrame, path: str, optional: tuple[str, ...] = ()) -> None:
    """Ledger rows as tab-separated text; sequence columns only where asked for. Parquet is the primary sink."""
    names = [n for n in ledger.columns if n not in ("insert_seq", "support_qnames") or n in optional]
    ledger.select(*names).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", quote="")


def write_summary(summary: dict[str, object], calls: DataFrame, path: str) -> None:
    """Summary lines, a blank line, then the calls under a ``#`` header, as one file."""
    spark = calls.sparkSession
    head = [f"{k}\t{v}" for k, v in summary.items()] + ["", "#" + "\t".join(calls.columns)]
    rows = calls.select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("o"), F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in calls.columns)).alias("value"))
    top = spark.createDataFrame([(0, i, h) for i, h in enumerate(head)], "part int, o bigint, value string")
    top.unionByName(rows).orderBy("part", "o").select("value").coalesce(1).write.mode("overwrite").text(path)
