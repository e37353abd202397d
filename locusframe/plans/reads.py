"""Aligned reads: gate, bins, insertion signatures, components and evidence tallies, as column expressions and joins.

A read is a row (qname, flag, tid, chrom, pos, mapq, cigar, seq, sa, nm); the
CIGAR is an array of (len, op) as ``functions.seq.parse_cigar`` gives it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import seq
from ..operators import cluster, intervals

UNMAPPED, SECONDARY, SUPPLEMENTARY, REVERSE = 0x4, 0x100, 0x800, 0x10
# Fixed values of the gate and of the signals.
LEAST_READ, LONG_CLIP, LONG_INSERTION = 50, 100, 50
BACKGROUND_MAPQ, ANCHOR_MATCH, CLIP_FLANK, MOST_NM = 20, 200, 120, 0.20
CERTAIN_MAPQ, CLIP_SIGNAL = 60, 20
BIN = 10_000


def cigar_summary(cigar: Column) -> Column:
    """(matched, longest_match, soft, insertion, lead_clip, tail_clip, lead_flank, tail_flank) of a CIGAR; hard clips at the ends are skipped."""
    match = lambda x: x["op"].isin("M", "=", "X")
    inner = F.filter(cigar, lambda x, i: ~((x["op"] == "H") & ((i == 0) | (i == F.size(cigar) - 1))))
    longest = lambda op: F.coalesce(F.array_max(F.transform(F.filter(cigar, lambda x: x["op"] == op), lambda x: x["len"])), F.lit(0))
    first, last = F.get(inner, F.lit(0)), F.element_at(inner, -1)

    def flank(ops: Column) -> Column:
        step = lambda a, x: F.struct((a["open"] & match(x)).alias("open"), (a["n"] + F.when(a["open"] & match(x), x["len"]).otherwise(0)).alias("n"))
        return F.aggregate(ops, F.struct(F.lit(True).alias("open"), F.lit(0).alias("n")), step, lambda a: a["n"])

    lead, tail = first["op"] == "S", last["op"] == "S"
    some = F.size(inner) > 0
    return F.struct(
        F.coalesce(seq.cigar_total(cigar, "M=X"), F.lit(0)).alias("matched"),
        F.coalesce(seq.longest_match(cigar), F.lit(0)).alias("longest_match"),
        longest("S").alias("soft"),
        longest("I").alias("insertion"),
        F.when(some & lead, first["len"]).otherwise(0).alias("lead_clip"),
        F.when(some & tail, last["len"]).otherwise(0).alias("tail_clip"),
        F.when(some & lead, flank(F.slice(inner, 2, F.greatest(F.size(inner) - 1, F.lit(0))))).otherwise(0).alias("lead_flank"),
        F.when(some & tail, flank(F.reverse(F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0)))))).otherwise(0).alias("tail_flank"),
    )


def passes_gate(flag: Column, mapq: Column, length: Column, sa: Column, nm: Column, s: Column) -> Column:
    """Whether a read goes on, from its CIGAR summary. Reads without a signal need a good mapping; the others an anchor."""
    clip, insertion = s["soft"] >= LONG_CLIP, s["insertion"] >= LONG_INSERTION
    has_sa = sa.isNotNull() & (sa != "")
    signal = (flag.bitwiseAND(SUPPLEMENTARY) != 0) | has_sa | clip | insertion
    flanked = ((s["lead_clip"] < LONG_CLIP) | (s["lead_flank"] >= CLIP_FLANK)) & ((s["tail_clip"] < LONG_CLIP) | (s["tail_flank"] >= CLIP_FLANK))
    accurate = nm.isNull() | (nm < 0) | (s["matched"] == 0) | (nm / F.greatest(s["matched"], F.lit(1)) <= MOST_NM)
    good = (s["longest_match"] >= ANCHOR_MATCH) & (~clip | insertion | flanked) & (insertion | accurate)
    usable = (flag.bitwiseAND(UNMAPPED | SECONDARY) == 0) & (length >= LEAST_READ)
    return usable & F.when(signal, good).otherwise(mapq > BACKGROUND_MAPQ)


def gate(reads: DataFrame) -> DataFrame:
    """The reads that pass, with their reference end. Counters: ``observe`` the result of ``gate_counters``."""
    s = reads.withColumn("_s", cigar_summary(F.col("cigar")))
    kept = passes_gate(F.col("flag"), F.col("mapq"), F.length("seq"), F.col("sa"), F.col("nm"), F.col("_s"))
    return s.filter(kept).drop("_s").withColumn("ref_end", seq.reference_end(F.col("pos"), F.col("cigar")))


def gate_counters(reads: DataFrame) -> DataFrame:
    """One row: reads seen, dropped at the source, and passed."""
    s = cigar_summary(F.col("cigar"))
    kept = passes_gate(F.col("flag"), F.col("mapq"), F.length("seq"), F.col("sa"), F.col("nm"), s)
    return reads.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("flag").bitwiseAND(UNMAPPED | SECONDARY) != 0).alias("at_source"), F.count_if(kept).alias("passed"))


def bins(reads: DataFrame, width: int = BIN) -> DataFrame:
    """One row for every bin that a gated read touches; the end counts."""
    return intervals.bins_of(reads, "pos", "ref_end", width)


def _walk(cigar: Column, pos: Column) -> Column:
    """Insertions as (pos, len) along the reference."""
    step = lambda a, x: F.struct(
        (a["ref"] + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["len"]).otherwise(0)).alias("ref"),
        F.when(x["op"] == "I", F.concat(a["found"], F.array(F.struct(a["ref"].alias("pos"), x["len"].alias("len"))))).otherwise(a["found"]).alias("found"),
    )
    start = F.struct(pos.cast("long").alias("ref"), F.array().cast("array<struct<pos:bigint,len:int>>").alias("found"))
    return F.aggregate(cigar, start, step, lambda a: a["found"])


def _query_span(cigar: Column) -> tuple[Column, Column]:
    """Query start and end in read order of the alignment (leading clip, and clip plus aligned query)."""
    first = F.get(cigar, F.lit(0))
    lead = F.when(first["op"].isin("S", "H"), first["len"]).otherwise(0)
    return lead, lead + seq.cigar_total(cigar, "MI=X")


def signatures(reads: DataFrame) -> DataFrame:
    """Insertion signatures: long CIGAR insertions of certain reads, the best split, and clips where there is neither.

    Columns: qname, chrom, tid, pos, end, length, source, is_reverse, side (L or R for clips).
    """
    base = reads.filter(F.col("flag").bitwiseAND(SUPPLEMENTARY) == 0).withColumn("is_reverse", F.col("flag").bitwiseAND(REVERSE) != 0)
    found = F.filter(_walk(F.col("cigar"), F.col("pos")), lambda x: x["len"] >= LONG_INSERTION)
    base = base.withColumn("_ins", F.when((F.col("mapq") == CERTAIN_MAPQ) & F.col("cigar").isNotNull(), found).otherwise(F.array().cast("array<struct<pos:bigint,len:int>>")))

    q0, q1 = _query_span(F.col("cigar"))
    ref1 = seq.reference_end(F.col("pos"), F.col("cigar"))

    def split(x: Column) -> Column:
        cigar = seq.parse_cigar(x["cigar"])
        m0, m1 = _query_span(cigar)
        mate_end = x["pos"] + seq.cigar_total(cigar, "MDN=X")
        after = m0 >= q0
        query_gap = F.when(after, m0 - q1).otherwise(q0 - m1)
        ref_gap = F.greatest(F.lit(0), F.when(after, x["pos"] - ref1).otherwise(F.col("pos") - mate_end))
        same = (x["chrom"] == F.col("chrom")) & ((x["strand"] == "-") == F.col("is_reverse"))
        return F.struct(F.when(same, query_gap - ref_gap).otherwise(-1).cast("long").alias("length"), F.when(after, ref1).otherwise(mate_end).cast("long").alias("pos"))

    splits = F.filter(F.transform(seq.parse_sa("sa"), split), lambda x: x["length"] >= LONG_INSERTION)
    best = F.aggregate(splits, F.struct(F.lit(-1).cast("long").alias("length"), F.lit(-1).cast("long").alias("pos")), lambda a, x: F.when(x["length"] > a["length"], x).otherwise(a))
    base = base.withColumn("_split", F.when(F.col("sa").isNotNull() & F.col("cigar").isNotNull(), best))
    has_split = F.coalesce(F.col("_split.length") > 0, F.lit(False))

    s = cigar_summary(F.col("cigar"))
    no_side, none = F.lit(None).cast("string").alias("side"), F.array().cast("array<struct<pos:bigint,length:bigint,source:string,side:string>>")
    clip = lambda at, n, side: F.struct(at.cast("long").alias("pos"), n.cast("long").alias("length"), F.lit("CLIP").alias("source"), F.lit(side).alias("side"))
    clips = F.filter(F.array(clip(F.col("pos"), s["lead_clip"], "L"), clip(ref1, s["tail_clip"], "R")), lambda x: x["length"] >= CLIP_SIGNAL)
    ins = F.transform("_ins", lambda x: F.struct(x["pos"].alias("pos"), x["len"].cast("long").alias("length"), F.lit("CIGAR").alias("source"), no_side))
    own = F.concat(ins, F.when(has_split, F.array(F.struct(F.col("_split.pos").alias("pos"), F.col("_split.length").alias("length"), F.lit("SPLIT").alias("source"), no_side))).otherwise(none))
    every = F.when(F.size(own) > 0, own).otherwise(F.coalesce(clips, none))
    rows = base.select("qname", "chrom", "tid", "is_reverse", F.explode(every).alias("x"))
    return rows.select("qname", "chrom", "tid", F.col("x.pos").alias("pos"), (F.col("x.pos") + 1).alias("end"), F.col("x.length").alias("length"), F.col("x.source").alias("source"), "is_reverse", F.col("x.side").alias("side"))


#: Neighbours: closer than 250 where both come from CIGARs, else 500.
TIGHT, LOOSE = 250, 500


def components(sigs: DataFrame) -> DataFrame:
    """Signatures clustered densely, then the rest by connection; one row a cluster with its supports."""
    # Ids in the order of position, end, length and read, without a sort along a contig; equal signatures are told apart in their own small group.
    again = F.row_number().over(W.partitionBy("tid", "chrom", "pos", "end", "length", "qname", "source").orderBy("is_reverse"))
    padded = lambda x: F.lpad(F.col(x).cast("string"), 12, "0")
    points = sigs.withColumn("id", F.concat_ws("|", F.lpad(F.col("tid").cast("string"), 6, "0"), "chrom", padded("pos"), padded("end"), padded("length"), "qname", "source", again.cast("string")))
    limit = F.when((F.col("x.source") == "CIGAR") & (F.col("y.source") == "CIGAR"), TIGHT).otherwise(LOOSE)
    pairs = cluster.neighbour_pairs(points, ["tid", "chrom"], "pos", LOOSE, cluster.euclid(limit, "pos", "end", "length"))
    named = cluster.strong_weak_clusters(points, pairs)
    spans = cluster.project_clusters(points, named.select("id", "cluster"), ["tid", "chrom"], "pos", "length")
    count = lambda s: F.countDistinct(F.when(F.col("source") == s, F.col("qname"))).alias(s.lower() + "_reads")
    reads = points.join(named, "id").groupBy("tid", "chrom", "cluster").agg(count("CIGAR"), count("SPLIT"), count("CLIP"), F.countDistinct("qname").alias("reads"), F.first("strong").alias("strong"))
    return spans.join(reads, ["tid", "chrom", "cluster"])


def tally(hypotheses: DataFrame, sigs: DataFrame, reads: DataFrame, near: int = 25, quiet: int = 75, mapq: int = 20) -> DataFrame:
    """Evidence of each hypothesis (id, chrom, lo, hi): distinct reads for it by kind, and reads that span it untouched.

    A read speaks for the reference if one primary alignment contains the
    interval, it is not among the reads for the insertion, and it has no signal
    within ``quiet`` of the interval; low mapping qualities are counted apart.
    """
    h = hypotheses.select("id", "chrom", "lo", "hi")
    around = h.withColumns({"start": F.col("lo") - near, "end": F.col("hi") + near + 1})
    sided = sigs if "side" in sigs.columns else sigs.withColumn("side", F.lit(None).cast("string"))
    alt = intervals.points_in_intervals(sided.select("chrom", "pos", "qname", "source", "side"), around, ["chrom"], "pos").select(F.col("r_id").alias("id"), "qname", "source", "side")
    of = lambda condition, name: F.countDistinct(F.when(condition, F.col("qname"))).alias(name)
    kinds = alt.groupBy("id").agg(F.countDistinct("qname").alias("alt_reads"), *(of(F.col("source") == s, f"alt_{s.lower()}") for s in ("CIGAR", "SPLIT", "CLIP")), *(of((F.col("source") == "CLIP") & (F.col("side") == x), f"alt_{n}_clip") for x, n in (("L", "left"), ("R", "right"))))
    primary = reads.filter(F.col("flag").bitwiseAND(SUPPLEMENTARY | SECONDARY | UNMAPPED) == 0).select("chrom", "qname", "mapq", F.col("pos").alias("start"), F.col("ref_end").alias("end"))
    spans = intervals.containment_join(h.withColumnsRenamed({"lo": "start", "hi": "end"}), primary, ["chrom"]).select("id", F.col("r_qname").alias("qname"), F.col("r_mapq").alias("mapq"))
    loud = intervals.points_in_intervals(sigs.select("chrom", "pos", "qname"), h.withColumns({"start": F.col("lo") - quiet, "end": F.col("hi") + quiet + 1}), ["chrom"], "pos").select(F.col("r_id").alias("id"), "qname")
    clean = spans.join(alt.select("id", "qname"), ["id", "qname"], "left_anti").join(loud, ["id", "qname"], "left_anti")
    ref = clean.groupBy("id").agg(F.countDistinct(F.when(F.col("mapq") >= mapq, F.col("qname"))).alias("ref_reads"), F.countDistinct(F.when(F.col("mapq") < mapq, F.col("qname"))).alias("low_mapq_ref_reads"))
    counts = [*kinds.columns[1:], *ref.columns[1:]]
    return h.join(kinds, "id", "left").join(ref, "id", "left").select("id", "chrom", "lo", "hi", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


def worth_ledger(counts: DataFrame) -> DataFrame:
    """Hypotheses with any evidence."""
    return counts.filter("alt_reads > 0 or ref_reads > 0")


def keep_for_expensive(first: Column) -> Column:
    """Whether a hypothesis is worth assembling: the first of its component always; any split or insertion; clips on
    both sides with two reads; or clips on one side, three of them, three reads and twice the reference's."""
    c = F.col
    left, right = c("alt_left_clip"), c("alt_right_clip")
    precise = (c("alt_split") > 0) | (c("alt_cigar") > 0)
    bilateral = (left > 0) & (right > 0) & (c("alt_reads") >= 2)
    one_sided = ((left > 0) != (right > 0)) & (F.greatest(left, right) >= 3) & (c("alt_reads") >= 3) & (c("alt_reads") >= 2 * F.greatest(F.lit(1), c("ref_reads")))
    return first | precise | bilateral | one_sided


def worth_consensus(counts: DataFrame, order: list[str], component: str | None = None) -> DataFrame:
    """Hypotheses worth assembling; the first in order is the first of each component (of each contig where there is no such column)."""
    key = component or ("component" if "component" in counts.columns else "chrom")
    first = F.row_number().over(W.partitionBy(key).orderBy(*order)) == 1
    return counts.withColumn("_keep", keep_for_expensive(first)).filter("_keep").drop("_keep")


# Windows around an event


def read_key(reads: DataFrame) -> Column:
    """What tells reads apart: their column ``read`` where they have one, else a hash of name, flag and place, which equal alignments share."""
    return F.col("read") if "read" in reads.columns else F.xxhash64("qname", "flag", "chrom", "pos")


def read_sites(reads: DataFrame) -> DataFrame:
    """Every signal of every read: read (its ``read_key``), qname, tid, chrom, mapq, flag, kind (L, R, INS or SPLIT), pos, length.

    Clips of 20 bases, insertions of any length, and the places of splits that
    imply an insertion of 50 on the same contig and strand.
    """
    s, pos = cigar_summary(F.col("cigar")), F.col("pos")
    ref1 = seq.reference_end(pos, F.col("cigar"))
    q0, q1 = _query_span(F.col("cigar"))
    reverse = F.col("flag").bitwiseAND(REVERSE) != 0
    site = lambda kind, at, n: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("pos"), n.cast("long").alias("length"))

    def split(x: Column) -> Column:
        cigar = seq.parse_cigar(x["cigar"])
        m0, m1 = _query_span(cigar)
        mate_end, after = x["pos"] + seq.cigar_total(cigar, "MDN=X"), m0 >= q0
        length = F.when(after, m0 - q1).otherwise(q0 - m1) - F.greatest(F.lit(0), F.when(after, x["pos"] - ref1).otherwise(pos - mate_end))
        same = (x["chrom"] == F.col("chrom")) & ((x["strand"] == "-") == reverse)
        return site("SPLIT", F.when(after, ref1).otherwise(mate_end), F.when(same, length).otherwise(-1))

    none = F.array().cast("array<struct<kind:string,pos:bigint,length:bigint>>")
    clips = F.filter(F.array(site("L", pos, s["lead_clip"]), site("R", ref1, s["tail_clip"])), lambda x: x["length"] >= CLIP_SIGNAL)
    insertions = F.transform(_walk(F.col("cigar"), pos), lambda x: site("INS", x["pos"], x["len"]))
    splits = F.array_distinct(F.filter(F.transform(seq.parse_sa("sa"), split), lambda x: x["length"] >= LONG_INSERTION))
    every = F.concat(clips, insertions, F.coalesce(splits, none))
    rows = reads.filter(F.col("cigar").isNotNull()).select(read_key(reads).alias("read"), "qname", "tid", "chrom", "mapq", "flag", F.explode(every).alias("x"))
    return rows.select("read", "qname", "tid", "chrom", "mapq", "flag", "x.kind", "x.pos", "x.length")


def local_signals(sites: DataFrame, windows: DataFrame) -> DataFrame:
    """What each read says in each window (id, chrom, start, end; both ends included).

    left_clip_pos, right_clip_pos, split_left and split_right (first and last
    split), longest_insertion (of any length), and indel_pos: of the insertions
    of 50 or more the one nearest the window's centre, the first of equals.
    """
    spans = windows.select("id", "chrom", "start", (F.col("end") + 1).alias("end"))
    inside = intervals.points_in_intervals(sites, spans, ["chrom"], "pos")
    centre = F.col("r_start") + F.floor((F.col("r_end") - 1 - F.col("r_start")) / 2)
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    long = F.when((F.col("kind") == "INS") & (F.col("length") >= LONG_INSERTION), F.struct(F.abs(F.col("pos") - centre).alias("d"), F.col("pos").alias("pos")))
    return inside.groupBy(F.col("r_id").alias("id"), "read", "qname", "mapq", "flag").agg(
        F.max(of("L", F.col("pos"))).alias("left_clip_pos"), F.max(of("R", F.col("pos"))).alias("right_clip_pos"), F.min(of("SPLIT", F.col("pos"))).alias("split_left"), F.max(of("SPLIT", F.col("pos"))).alias("split_right"),
        F.coalesce(F.max(of("INS", F.col("length"))), F.lit(0)).alias("longest_insertion"), F.min(long)["pos"].alias("indel_pos"),
    )


# Events at a hypothesis beyond its own window

# Windows for clips near candidates, for carriers of an allele, and of the background.
CANDIDATE_REACH, CANDIDATE_SLACK, CARRIER_REACH, CARRIER_TOLERANCE, BACKGROUND, ALLELE_REACH, PIECE, PIECE_GAP = 75, 25, 500, 0.3, 4, 500, 20, 100


def candidate_clips(hypotheses: DataFrame, candidates: DataFrame, sites: DataFrame) -> DataFrame:
    """(id, side, qname) of clips within 25 of a breakpoint candidate (component, pos) that lies within 75 of the hypothesis (id, component, chrom, lo, hi)."""
    near = hypotheses.join(candidates.select("component", F.col("pos").alias("candidate")), "component").filter(F.greatest(F.lit(0), F.col("lo") - F.col("candidate"), F.col("candidate") - F.col("hi")) <= CANDIDATE_REACH)
    windows = near.select("id", "chrom", (F.col("candidate") - CANDIDATE_SLACK).alias("start"), (F.col("candidate") + CANDIDATE_SLACK + 1).alias("end")).distinct()
    found = intervals.points_in_intervals(sites.filter("kind in ('L', 'R')"), windows, ["chrom"], "pos")
    return found.select(F.col("r_id").alias("id"), F.col("kind").alias("side"), "qname").distinct()


def supplement_clips(own: DataFrame, nearby: DataFrame) -> DataFrame:
    """Clips near candidates join a hypothesis's own (id, kind, qname) only where it has a split or insertion and they come from both sides."""
    precise = own.filter("kind in ('SPLIT', 'INS')").select("id").distinct()
    both = nearby.groupBy("id").agg(F.countDistinct("side").alias("_n")).filter("_n = 2").select("id")
    more = nearby.join(precise, "id", "left_semi").join(both, "id", "left_semi").select("id", F.col("side").alias("kind"), "qname")
    return own.select("id", "kind", "qname").unionByName(more).distinct()


def carriers(hypotheses: DataFrame, sites: DataFrame, reach: int = CARRIER_REACH) -> DataFrame:
    """(id, qname) of certain primary reads with an insertion of the allele's length (``allele_length``, within 30 percent) in reach of a hypothesis (id, chrom, lo, hi)."""
    windows = hypotheses.select("id", "chrom", "allele_length", F.greatest(F.lit(0), F.col("lo") - reach).alias("start"), (F.col("hi") + reach + 1).alias("end"))
    certain = sites.filter((F.col("kind") == "INS") & (F.col("mapq") == CERTAIN_MAPQ) & (F.col("flag").bitwiseAND(SUPPLEMENTARY | SECONDARY) == 0))
    found = intervals.points_in_intervals(certain, windows, ["chrom"], "pos")
    low = F.greatest(F.lit(LONG_INSERTION), F.col("r_allele_length") * (1 - CARRIER_TOLERANCE))
    return found.filter((F.col("length") >= low) & (F.col("length") <= F.col("r_allele_length") * (1 + CARRIER_TOLERANCE))).select(F.col("r_id").alias("id"), "qname").distinct()


def background_windows(hypotheses: DataFrame, width: Column) -> DataFrame:
    """(id, chrom, k, start, end) of four windows of a width on each side beyond the reach of an allele; those before the contig's start are left out."""
    k = F.explode(F.sequence(F.lit(-BACKGROUND), F.lit(BACKGROUND - 1))).alias("k")
    w = F.greatest(F.lit(1), width)
    rows = hypotheses.select("id", "chrom", "lo", "hi", w.alias("_w"), k)
    start = F.when(F.col("k") < 0, F.col("lo") - ALLELE_REACH + F.col("k") * F.col("_w")).otherwise(F.col("hi") + ALLELE_REACH + F.col("k") * F.col("_w"))
    return rows.select("id", "chrom", "k", start.alias("start"), (start + F.col("_w")).alias("end")).filter("start >= 0")


def background_signal(hypotheses: DataFrame, sites: DataFrame, reads: DataFrame, slack: int = 25, mapq: int = 20) -> DataFrame:
    """(id, background_reads, background_hits): read windows where the insertion is not, and those that show a signal all the same."""
    windows = background_windows(hypotheses, F.col("hi") - F.col("lo") + 2 * slack).withColumn("wid", F.struct("id", "k"))
    primary = reads.filter(F.col("flag").bitwiseAND(SUPPLEMENTARY | SECONDARY) == 0)
    plain = sites.filter(F.col("flag").bitwiseAND(SUPPLEMENTARY | SECONDARY) == 0).filter((F.col("kind") != "INS") | ((F.col("length") >= LONG_INSERTION) & (F.col("mapq") == CERTAIN_MAPQ)))
    hits = intervals.points_in_intervals(plain, windows.select("wid", "chrom", "start", (F.col("end") + 1).alias("end")), ["chrom"], "pos").select(F.col("r_wid").alias("wid"), "read").distinct()
    spans = primary.select("chrom", read_key(primary).alias("read"), "mapq", F.col("pos").alias("start"), F.col("ref_end").alias("end"))
    across = intervals.containment_join(windows.select("wid", "chrom", "start", "end"), spans.filter(F.col("mapq") >= mapq), ["chrom"]).select("wid", F.col("r_read").alias("read")).distinct()
    either = hits.withColumn("hit", F.lit(1)).unionByName(across.join(hits, ["wid", "read"], "left_anti").withColumn("hit", F.lit(0)))
    return either.groupBy("wid.id").agg(F.count(F.lit(1)).alias("background_reads"), F.sum("hit").alias("background_hits"))


def allele_pieces(sites: DataFrame) -> DataFrame:
    """(read, qname, chrom, pos, length, pieces): a read's insertions of 20 bases, those within 100 of one another as one event."""
    from ..operators import islands

    pieces = sites.filter((F.col("kind") == "INS") & (F.col("length") >= PIECE)).select("read", "qname", "chrom", "pos", "length")
    marked = islands.assign_islands(pieces, ["read", "qname", "chrom"], "pos", PIECE_GAP, ["length"])
    return marked.groupBy("read", "qname", "chrom", "island").agg(F.min("pos").alias("pos"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("pieces")).drop("island")
