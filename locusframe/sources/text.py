"""Text sources as DataFrames: SAM, FASTA, alignment tables, ledgers, BED, VCF and truth tables.

All are line- or record-splittable reads with a fixed schema, so no file is
read by one task and nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import seq
from ..plans.reads import SECONDARY, UNMAPPED


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Mapped primary and supplementary records of SAM text; positions from 0; ``tid`` by @SQ order."""
    lines = spark.read.text(path)
    sq = lines.filter("value like '@SQ\t%'").select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chrom"), F.monotonically_increasing_id().alias("_o"))
    from pyspark.sql import Window as W

    contigs = sq.select("chrom", (F.row_number().over(W.orderBy("_o")) - 1).alias("tid"))  # one row a contig
    f = F.split("value", "\t")
    tags = F.concat_ws("\t", F.slice(f, 12, 10_000))
    rows = lines.filter("value not like '@%'").select(
        f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("chrom"), (f[3].cast("long") - 1).alias("pos"), f[4].cast("int").alias("mapq"), seq.parse_cigar(f[5]).alias("cigar"),
        F.when(f[9] != "*", f[9]).otherwise("").alias("seq"), F.nullif(F.regexp_extract(tags, r"(?:^|\t)SA:Z:([^\t]*)", 1), F.lit("")).alias("sa"), F.expr("try_cast(nullif(regexp_extract(concat_ws('\t', slice(split(value, '\t'), 12, 10000)), '(?:^|\t)NM:i:(-?[0-9]+)', 1), '') as int)").alias("nm"),
    )
    kept = rows.filter(F.col("flag").bitwiseAND(SECONDARY | UNMAPPED) == 0)
    return kept.join(F.broadcast(contigs), "chrom", "left")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence (upper case), revcomp of every record; empty sequences are dropped."""
    records = spark.read.option("lineSep", "\n>").text(path)
    clean = F.regexp_replace("value", "^>", "")
    name = seq.header_token(F.substring_index(clean, "\n", 1))
    body = F.upper(F.regexp_replace(F.regexp_replace(clean, r"^[^\n]*\n?", ""), r"\s", ""))
    rows = records.select(name.alias("name"), body.alias("sequence")).filter("length(sequence) > 0")
    return rows.withColumn("revcomp", seq.reverse_complement("sequence"))


def reference_blocks(fasta: DataFrame, bits: int = 16) -> DataFrame:
    """A reference as (chrom, block, seq) rows of at most ``1 << bits`` bases."""
    size = 1 << bits
    count = F.ceil(F.length("sequence") / size).cast("int")
    return fasta.select(F.col("name").alias("chrom"), "sequence", F.explode(F.sequence(F.lit(0), count - 1)).alias("block")).select("chrom", "block", F.substring("sequence", F.col("block") * size + 1, F.lit(size)).alias("seq"))


def reference_windows(requests: DataFrame, blocks: DataFrame, bits: int = 16) -> DataFrame:
    """Adds ``window``: bases of [start, end), cut at the contig's end, empty off the contig. Requests have ``id``, ``chrom``, ``start``, ``end``."""
    size = 1 << bits
    start = F.greatest(F.col("start"), F.lit(0))
    wanted = requests.withColumn("_s", start).filter("end > _s").withColumn("block", F.explode(F.sequence(F.floor(F.col("_s") / size).cast("int"), F.floor((F.col("end") - 1) / size).cast("int"))))
    low = F.greatest(F.col("_s") - F.col("block").cast("long") * size, F.lit(0))
    high = F.least(F.col("end") - F.col("block").cast("long") * size, F.lit(size))
    part = F.substring("seq", (low + 1).cast("int"), (high - low).cast("int"))
    parts = wanted.join(blocks, ["chrom", "block"]).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", part.alias("p")))), lambda x: x["p"]), "").alias("window"))
    return requests.join(parts, "id", "left").withColumn("window", F.upper(F.coalesce("window", F.lit(""))))


HITS = "query_id string, subject_id string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"


def read_hits(spark: SparkSession, path: str, queries: DataFrame | None = None) -> DataFrame:
    """Tabular alignments; malformed rows and rows of unknown queries are dropped."""
    rows = spark.read.csv(path, sep="\t", schema=HITS, mode="DROPMALFORMED").filter("query_id is not null and bitscore is not null")
    return rows if queries is None else rows.join(queries.select("query_id").distinct(), "query_id", "left_semi")


#: Columns that a ledger may lack, with their types and defaults.
LEDGER_DEFAULTS = {
    "te_annotation_class": ("string", "NA"), "mech_log_lr_vs_artifact": ("double", 0.0), "mech_counts_term": ("double", 0.0), "mech_counts_allele_byseq": ("double", 0.0), "allele_length": ("int", 0),
    "allele_byseq_span_lo": ("bigint", 0), "allele_byseq_span_hi": ("bigint", 0), "allele_byseq_extra_carriers": ("int", 0), "mech_decoy_count": ("int", 0), "mech_decoy_mean_exp_linkage": ("double", 0.0),
    "ref_span_reads": ("int", 0), "alt_indel_reads": ("int", 0), "te_union_coverage": ("double", 0.0), "te_union_covered_bp": ("int", 0), "te_dominant_class": ("string", "NA"), "te_dominant_family": ("string", "NA"),
}


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Evaluated ledger rows with typed columns, defaults for missing ones, ``row_id`` by file order and ``tid`` by first appearance."""
    from pyspark.sql import Window as W

    raw = spark.read.csv(path, sep="\t", header=True).withColumn("row_id", F.monotonically_increasing_id())
    if "candidate_retention_reason" in raw.columns:
        raw = raw.filter("candidate_retention_reason = 'EVALUATED'")
    for name, (kind, default) in LEDGER_DEFAULTS.items():
        value = F.expr(f"try_cast(`{name}` as {kind})") if name in raw.columns else F.lit(None).cast(kind)
        raw = raw.withColumn(name, F.coalesce(value, F.lit(default).cast(kind)))
    for name in ("pos", "bp_left", "bp_right"):
        raw = raw.withColumn(name, F.coalesce(F.expr(f"try_cast(`{name}` as bigint)"), F.lit(-1)))
    lengths = F.transform(F.filter(F.split(F.coalesce("alt_measured_lengths", F.lit("")), ","), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("int")) if "alt_measured_lengths" in raw.columns else F.array().cast("array<int>")
    contigs = raw.groupBy("chrom").agg(F.min("row_id").alias("_f")).select("chrom", (F.row_number().over(W.orderBy("_f")) - 1).alias("tid"))  # one row a contig
    return raw.withColumn("alt_measured_lengths", lengths).drop("tid").join(F.broadcast(contigs), "chrom")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Intervals (chrom, start, end) of a BED file; comments and track lines are skipped."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter("value rlike '^[^#\\t]+\\t[0-9]+\\t[0-9]+'")
    return rows.select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos (1-based), ref, alt, filter and INFO as a map; gzip is read as it is."""
    f = F.split("value", "\t")
    info = F.map_from_entries(F.transform(F.split(f[7], ";"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(F.instr(x, "=") > 0, F.regexp_replace(x, "^[^=]*=", "")).otherwise("").alias("value"))))
    return spark.read.text(path).filter("value not like '#%' and value <> ''").select(f[0].alias("chrom"), f[1].cast("long").alias("pos"), f[3].alias("ref"), f[4].alias("alt"), f[6].alias("filter"), info.alias("info"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The table of a report whose summary comes first: columns by the ``#`` header line."""
    lines = spark.read.text(path).withColumn("_o", F.monotonically_increasing_id())  # in the order of the file
    header = lines.filter("value rlike '^#[^#]'").orderBy("_o").first()
    if header is None:
        return spark.createDataFrame([], "chrom string")
    names = header.value.lstrip("#").split("\t")
    f = F.split("value", "\t")
    rows = lines.filter((F.col("_o") > header["_o"]) & (F.size(f) == len(names)))
    return rows.select(*(f[i].alias(n) for i, n in enumerate(names)))
