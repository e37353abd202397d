"""Read operators as queries over reads made from the driver tables.

A read's CIGAR is put together from five numbers of its row; the SQL works on
the numbers and never sees the CIGAR.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import seq
from ..session import table
from . import hypotheses as H, reads as R
from .registry import query

_PARTS = {
    "k": "o_orderkey", "qname": "concat('r', CAST(o_orderkey % 4001 AS STRING))", "flag": "CAST(CASE o_orderkey % 11 WHEN 0 THEN 256 WHEN 1 THEN 4 WHEN 2 THEN 2048 WHEN 3 THEN 16 ELSE 0 END AS INT)", "chrom": "concat('c', CAST(o_custkey % 3 AS STRING))", "pos": "CAST((o_orderkey * 37 + o_custkey) % 60000 AS BIGINT)",
    "mapq": "CAST(CASE o_custkey % 4 WHEN 0 THEN 60 WHEN 1 THEN 20 WHEN 2 THEN 21 ELSE 60 END AS INT)", "lead": "CAST(CASE o_orderkey % 7 WHEN 0 THEN 120 WHEN 1 THEN 25 WHEN 2 THEN 5 ELSE 0 END AS INT)", "m1": "CAST(30 + (o_custkey * 11) % 400 AS INT)", "ins": "CAST(CASE o_orderkey % 6 WHEN 0 THEN 90 WHEN 1 THEN 50 WHEN 2 THEN 20 ELSE 0 END AS INT)",
    "m2": "CAST(10 + (o_orderkey * 7) % 300 AS INT)", "tail": "CAST(CASE o_custkey % 6 WHEN 0 THEN 150 WHEN 1 THEN 20 WHEN 2 THEN 19 ELSE 0 END AS INT)", "nm": "CAST(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_custkey * 3) % 120 END AS INT)",
}
_CIGAR = "concat(" + ", ".join(f"CASE WHEN {n} > 0 THEN concat(CAST({n} AS STRING), '{op}') ELSE '' END" for n, op in (("lead", "S"), ("m1", "M"), ("ins", "I"), ("m2", "M"), ("tail", "S"))) + ")"


def reads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads from orders: k, qname, flag, tid, chrom, pos, mapq, cigar, seq, sa, nm."""
    parts = table(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {n}" for n, e in _PARTS.items()))
    length = F.col("lead") + F.col("m1") + F.col("ins") + F.col("m2") + F.col("tail")
    return parts.select("k", "qname", "flag", F.substring("chrom", 2, 1).cast("int").alias("tid"), "chrom", "pos", "mapq", seq.parse_cigar(F.expr(_CIGAR)).alias("cigar"), F.expr("repeat('A', lead + m1 + ins + m2 + tail)").alias("seq"), F.lit(None).cast("string").alias("sa"), "nm", length.alias("n"))


_READS = "r AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _PARTS.items()) + " FROM orders)"
_KEPT = """g AS (SELECT *, m1 + m2 AS matched, CASE WHEN ins > 0 THEN greatest(m1, m2) ELSE m1 + m2 END AS longest_match, greatest(lead, tail) AS soft, CASE WHEN lead > 0 THEN CASE WHEN ins > 0 THEN m1 ELSE m1 + m2 END ELSE 0 END AS lead_flank,
  CASE WHEN tail > 0 THEN CASE WHEN ins > 0 THEN m2 ELSE m1 + m2 END ELSE 0 END AS tail_flank, pos + m1 + m2 AS ref_end, lead + m1 + ins + m2 + tail AS n FROM r),
h AS (SELECT *, (flag & 260) = 0 AND n >= 50 AND CASE WHEN (flag & 2048) <> 0 OR soft >= 100 OR ins >= 50
  THEN longest_match >= 200 AND (soft < 100 OR ins >= 50 OR ((lead < 100 OR lead_flank >= 120) AND (tail < 100 OR tail_flank >= 120))) AND (ins >= 50 OR nm IS NULL OR nm < 0 OR nm::DOUBLE / matched <= 0.20) ELSE mapq > 20 END AS kept FROM g)"""


@query(f"WITH {_READS}, {_KEPT} SELECT k, matched, longest_match, soft, ins AS insertion, lead_flank, tail_flank, ref_end, kept FROM h")
def read_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIGAR summaries, reference ends and the gate of every read."""
    reads = reads_of(spark, sf_dir).withColumn("s", R.cigar_summary(F.col("cigar")))
    c = F.col
    kept = R.passes_gate(c("flag"), c("mapq"), c("n"), c("sa"), c("nm"), c("s"))
    return reads.select("k", "s.matched", "s.longest_match", "s.soft", "s.insertion", "s.lead_flank", "s.tail_flank", seq.reference_end(c("pos"), c("cigar")).alias("ref_end"), kept.alias("kept"))


@query(f"WITH {_READS}, {_KEPT} SELECT count(*)::BIGINT AS seen, count(*) FILTER (WHERE (flag & 260) <> 0)::BIGINT AS at_source, count(*) FILTER (WHERE kept)::BIGINT AS passed FROM h")
def read_gate_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads seen, dropped at the source, and passed."""
    return R.gate_counters(reads_of(spark, sf_dir))


@query(f"WITH {_READS}, {_KEPT} SELECT k, unnest(range(pos // 10000, (pos + m1 + m2) // 10000 + 1))::BIGINT AS bin FROM h WHERE kept")
def read_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins that the gated reads touch, the end included."""
    return R.bins(R.gate(reads_of(spark, sf_dir))).select("k", "bin")


_SIGS = """s AS (SELECT k, qname, chrom, pos + m1 AS loc, ins::BIGINT AS length, 'CIGAR' AS source, NULL AS side FROM r WHERE (flag & 2048) = 0 AND mapq = 60 AND ins >= 50
UNION ALL SELECT k, qname, chrom, pos, lead, 'CLIP', 'L' FROM r WHERE (flag & 2048) = 0 AND NOT (mapq = 60 AND ins >= 50) AND lead >= 20 UNION ALL SELECT k, qname, chrom, pos + m1 + m2, tail, 'CLIP', 'R' FROM r WHERE (flag & 2048) = 0 AND NOT (mapq = 60 AND ins >= 50) AND tail >= 20)"""


@query(f"WITH {_READS}, {_SIGS} SELECT qname, chrom, loc AS pos, length, source, side FROM s")
def read_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertion signatures with their precedence: insertions of certain reads, else clips."""
    return R.signatures(reads_of(spark, sf_dir)).select("qname", "chrom", "pos", "length", "source", "side")


_WINDOWS = "SELECT concat('c', CAST(i % 3 AS STRING)) AS chrom, i AS id, (i * 211) % 60000 AS lo FROM range({n}) t(i)"
_SITES = """t AS (SELECT k, qname, chrom, mapq, 'L' AS kind, pos AS loc, lead AS length FROM r WHERE lead >= 20 UNION ALL SELECT k, qname, chrom, mapq, 'R', pos + m1 + m2, tail FROM r WHERE tail >= 20 UNION ALL SELECT k, qname, chrom, mapq, 'INS', pos + m1, ins FROM r WHERE ins > 0)"""


def _intervals(spark: SparkSession) -> DataFrame:
    return spark.range(900).selectExpr("id", "concat('c', CAST(id % 3 AS STRING)) AS chrom", "(id * 211) % 60000 AS lo")


@query(f"""WITH {_READS}, {_SITES}, w AS (SELECT i AS id, concat('c', CAST(i % 3 AS STRING)) AS chrom, (i * 211) % 60000 AS lo FROM range(900) x(i))
SELECT w.id, t.k, max(CASE WHEN kind = 'L' THEN loc END) AS left_clip_pos, max(CASE WHEN kind = 'R' THEN loc END) AS right_clip_pos, coalesce(max(CASE WHEN kind = 'INS' THEN length END), 0)::BIGINT AS longest_insertion,
  max(CASE WHEN kind = 'INS' AND length >= 50 THEN loc END) AS indel_pos FROM w JOIN t ON t.chrom = w.chrom AND t.loc BETWEEN w.lo AND w.lo + 120 GROUP BY 1, 2""")
def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each read says in each window: clips, its longest insertion and the long one nearest the centre."""
    reads = reads_of(spark, sf_dir)
    windows = _intervals(spark).select("id", "chrom", F.col("lo").alias("start"), (F.col("lo") + 120).alias("end"))
    sites = R.read_sites(reads.withColumn("read", F.col("k")))
    return R.local_signals(sites, windows).select("id", F.col("read").alias("k"), "left_clip_pos", "right_clip_pos", "longest_insertion", "indel_pos")


_TALLY = f"""WITH {_READS}, {_KEPT}, {_SIGS}, w AS (SELECT i AS id, concat('c', CAST(i % 3 AS STRING)) AS chrom, (i * 211) % 60000 AS lo, (i * 211) % 60000 + i % 40 AS hi FROM range(900) x(i)),
a AS (SELECT w.id, s.qname, s.source, s.side FROM w JOIN s ON s.chrom = w.chrom AND s.loc BETWEEN w.lo - 25 AND w.hi + 25), loud AS (SELECT DISTINCT w.id, s.qname FROM w JOIN s ON s.chrom = w.chrom AND s.loc BETWEEN w.lo - 75 AND w.hi + 75),
p AS (SELECT w.id, h.qname, h.mapq FROM w JOIN h ON h.chrom = w.chrom AND h.kept AND (h.flag & 2308) = 0 AND h.pos <= w.lo AND h.ref_end >= w.hi WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = w.id AND a.qname = h.qname) AND NOT EXISTS (SELECT 1 FROM loud WHERE loud.id = w.id AND loud.qname = h.qname)),
f AS (SELECT id, count(DISTINCT qname) AS alt_reads, count(DISTINCT CASE WHEN source = 'CIGAR' THEN qname END) AS alt_cigar, count(DISTINCT CASE WHEN source = 'CLIP' THEN qname END) AS alt_clip, count(DISTINCT CASE WHEN side = 'L' THEN qname END) AS alt_left_clip, count(DISTINCT CASE WHEN side = 'R' THEN qname END) AS alt_right_clip FROM a GROUP BY 1),
q AS (SELECT id, count(DISTINCT CASE WHEN mapq >= 20 THEN qname END) AS ref_reads FROM p GROUP BY 1),
t AS (SELECT w.id, w.chrom, w.id // 5 AS component, coalesce(alt_reads, 0)::BIGINT AS alt_reads, coalesce(alt_cigar, 0)::BIGINT AS alt_cigar, coalesce(alt_clip, 0)::BIGINT AS alt_clip, coalesce(alt_left_clip, 0)::BIGINT AS alt_left_clip, coalesce(alt_right_clip, 0)::BIGINT AS alt_right_clip, coalesce(ref_reads, 0)::BIGINT AS ref_reads FROM w LEFT JOIN f USING (id) LEFT JOIN q USING (id))"""


def _tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = reads_of(spark, sf_dir)
    return R.tally(_intervals(spark).withColumn("hi", F.expr("lo + id % 40")), R.signatures(reads), R.gate(reads))


@query(f"{_TALLY} SELECT id, alt_reads, alt_cigar, alt_clip, alt_left_clip, alt_right_clip, ref_reads FROM t")
def event_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct reads for and against each interval, by kind."""
    return _tally(spark, sf_dir).select("id", "alt_reads", "alt_cigar", "alt_clip", "alt_left_clip", "alt_right_clip", "ref_reads")


@query(f"""{_TALLY}, o AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY alt_reads DESC, id) AS place FROM t)
SELECT id, component FROM o WHERE place = 1 OR alt_cigar > 0 OR (alt_left_clip > 0 AND alt_right_clip > 0 AND alt_reads >= 2)
  OR ((alt_left_clip > 0) <> (alt_right_clip > 0) AND greatest(alt_left_clip, alt_right_clip) >= 3 AND alt_reads >= 3 AND alt_reads >= 2 * greatest(1, ref_reads))""")
def worth_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses worth assembling: one of each component, and those with precise, bilateral or unopposed clips."""
    counts = _tally(spark, sf_dir).withColumn("component", F.floor(F.col("id") / 5).cast("long"))
    return R.worth_consensus(counts, [F.desc("alt_reads"), "id"]).select("id", "component")


_ALLELE = f"""w AS (SELECT i AS id, concat('c', CAST(i % 3 AS STRING)) AS chrom, (i * 211) % 60000 AS lo, (i * 211) % 60000 + i % 40 AS hi, 40 + i % 60 AS allele_length FROM range(900) x(i))"""


@query(f"WITH {_READS}, {_ALLELE} SELECT DISTINCT w.id, r.qname FROM w JOIN r ON r.chrom = w.chrom AND (r.flag & 2304) = 0 AND r.mapq = 60 AND r.ins > 0 AND r.pos + r.m1 BETWEEN greatest(0, w.lo - 500) AND w.hi + 500 AND r.ins >= greatest(50, allele_length * (1 - 0.3)) AND r.ins <= allele_length * (1 + 0.3)")
def allele_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that carry an allele's length in reach of its interval."""
    h = _intervals(spark).withColumn("hi", F.expr("lo + id % 40")).withColumn("allele_length", F.expr("40 + id % 60"))
    return R.carriers(h, R.read_sites(reads_of(spark, sf_dir)))


@query(f"""WITH {_READS}, {_KEPT}, {_ALLELE}, b AS (SELECT *, hi - lo + 50 AS wd, unnest(range(-4, 4)) AS kk FROM w), v AS (SELECT id, chrom, kk, CASE WHEN kk < 0 THEN lo - 500 + kk * wd ELSE hi + 500 + kk * wd END AS s, wd FROM b), u AS (SELECT *, s + wd AS e FROM v WHERE s >= 0),
p AS (SELECT * FROM h WHERE (flag & 2304) = 0), i AS (SELECT u.id, u.kk, p.k, bool_or((p.lead >= 20 AND p.pos BETWEEN u.s AND u.e) OR (p.tail >= 20 AND p.ref_end BETWEEN u.s AND u.e) OR (p.ins >= 50 AND p.mapq = 60 AND p.pos + p.m1 BETWEEN u.s AND u.e)) AS hit, bool_or(p.mapq >= 20 AND p.pos <= u.s AND p.ref_end >= u.e) AS across
  FROM u JOIN p ON p.chrom = u.chrom AND p.pos <= u.e AND p.ref_end >= u.s GROUP BY 1, 2, 3)
SELECT id, count(*)::BIGINT AS background_reads, count(*) FILTER (WHERE hit)::BIGINT AS background_hits FROM i WHERE hit OR across GROUP BY 1""")
def background_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal where the insertion is not: four windows on each side."""
    reads = reads_of(spark, sf_dir).withColumns({"read": F.col("k"), "ref_end": seq.reference_end(F.col("pos"), F.col("cigar"))})
    return R.background_signal(_intervals(spark).withColumn("hi", F.expr("lo + id % 40")), R.read_sites(reads), reads)


@query(f"""WITH {_READS} SELECT k, CASE WHEN lead >= 20 THEN lead ELSE 0 END AS lead, CASE WHEN tail >= 20 THEN tail ELSE 0 END AS tail, CASE WHEN mapq = 60 AND ins >= 50 THEN ins ELSE 0 END AS inner_length, CASE WHEN mapq = 60 AND ins >= 50 THEN least(m1, m2) ELSE 0 END AS anchor FROM r WHERE lead >= 20 OR tail >= 20 OR (mapq = 60 AND ins >= 50)""")
def read_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips and insertions as fragments: their lengths, and the weaker anchor of an insertion."""
    reads = reads_of(spark, sf_dir).withColumn("ref_end", seq.reference_end(F.col("pos"), F.col("cigar"))).withColumn("qname", F.col("k").cast("string"))
    f = H.clip_fragments(reads).withColumn("n", F.length("sequence"))
    of = lambda kind, x, name: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(x))), F.lit(0)).alias(name)
    return f.groupBy(F.col("qname").cast("long").alias("k")).agg(of("LEAD", "n", "lead"), of("TAIL", "n", "tail"), of("CIGAR", "n", "inner_length"), of("CIGAR", "anchor_len", "anchor"))
