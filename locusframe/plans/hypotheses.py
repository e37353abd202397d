"""Breakpoint hypotheses of a component, and what its reads' fragments say, as joins and windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import seq
from ..functions.scalars import gap_to_point, interval_iou, outside_length
from ..operators import islands, ranks

# Cluster gap, clusters a side, furthest pair, and weights by priority.
GAP, SIDES, FURTHEST = 75, 6, 250
WEIGHTS = {0: 8, 1: 8, 2: 7, 3: 1, 4: 6, 5: 1}


def side_clusters(points: DataFrame, anchors: DataFrame) -> DataFrame:
    """The best few clusters of each side. ``points``: component, side (L or R), pos; ``anchors``: component, anchor."""
    found = islands.islands_of_breakpoints(points, ["component", "side"], "pos", GAP).join(anchors, "component")
    return ranks.top_k(found, ["component", "side"], [F.desc("support"), F.abs(F.col("centre") - F.col("anchor")), "centre"], SIDES)


def enumerate_pairs(clusters: DataFrame) -> DataFrame:
    """Hypotheses (component, lo, hi, support, priority): pairs of sides at most ``FURTHEST`` apart, or single clusters where a side is missing."""
    left = clusters.filter("side = 'L'").select("component", "anchor", F.col("centre").alias("l"), F.col("support").alias("ls"))
    right = clusters.filter("side = 'R'").select("component", F.col("centre").alias("r"), F.col("support").alias("rs"))
    pairs = left.join(right, "component").filter(F.abs(F.col("l") - F.col("r")) <= FURTHEST)
    both = pairs.select("component", "anchor", F.least("l", "r").alias("lo"), F.greatest("l", "r").alias("hi"), (F.col("ls") + F.col("rs")).alias("support"), F.lit(0).alias("priority"))
    sides = clusters.groupBy("component").agg(F.countDistinct("side").alias("_n")).filter("_n = 1").select("component")
    one = clusters.join(sides, "component").select("component", "anchor", F.col("centre").alias("lo"), F.col("centre").alias("hi"), "support", F.lit(4).alias("priority"))
    return both.unionByName(one)


def order_hypotheses(found: DataFrame, most: int | None = None) -> DataFrame:
    """First of each (lo, hi) by priority, then ranked by weighted support, distance to the anchor, and position."""
    first = ranks.first_per_group(found, ["component", "lo", "hi"], ["priority", F.desc("support")])
    weight = F.lit(1)
    for priority, w in WEIGHTS.items():
        weight = F.when(F.col("priority") == priority, w).otherwise(weight)
    centre = F.floor((F.col("lo") + F.col("hi")) / 2)
    w = W.partitionBy("component").orderBy(F.desc(F.col("support") * weight), F.abs(centre - F.col("anchor")), F.desc("support"), "priority", "lo", "hi")
    ranked = first.withColumn("rank", F.row_number().over(w))
    return ranked if most is None else ranked.filter(F.col("rank") <= most)


def clip_fragments(reads: DataFrame, least: int = 20, least_insertion_: int = 50) -> DataFrame:
    """Leading and trailing clips, and the insertions of certain reads, of gated reads: qname, kind (LEAD, TAIL, CIGAR), ord, pos, sequence, anchor_len, nm."""
    from .reads import CERTAIN_MAPQ, cigar_summary

    c = F.col
    base = reads.withColumn("_s", cigar_summary(c("cigar"))).withColumn("_i", insertions_of(c("cigar"), c("pos")))
    part = lambda kind, at, text, anchor: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("pos"), text.alias("sequence"), anchor.cast("int").alias("anchor_len"))
    lead = F.when(c("_s.lead_clip") >= least, part("LEAD", c("pos"), F.left(c("seq"), c("_s.lead_clip")), c("_s.lead_flank")))
    tail = F.when(c("_s.tail_clip") >= least, part("TAIL", c("ref_end"), F.right(c("seq"), c("_s.tail_clip")), c("_s.tail_flank")))
    long = F.filter("_i", lambda x: (x["len"] >= least_insertion_) & (c("mapq") == CERTAIN_MAPQ))
    inner = F.transform(long, lambda x: part("CIGAR", x["ref"], F.substring(c("seq"), x["query"] + 1, x["len"]), F.least(x["before"], x["after"])))
    every = F.concat(F.array_compact(F.array(lead, tail)), F.coalesce(inner, F.array().cast("array<struct<kind:string,pos:bigint,sequence:string,anchor_len:int>>")))
    rows = base.select("qname", "chrom", "nm", F.posexplode(every).alias("ord", "f"))
    return rows.select("qname", "chrom", "f.kind", "ord", "f.pos", "f.sequence", "f.anchor_len", F.coalesce("nm", F.lit(-1)).alias("nm")).filter("length(sequence) > 0")


def insertions_of(cigar: Column, pos: Column) -> Column:
    """Insertions of a CIGAR as (ref, query, len, before, after): where they lie, and the matches that run up to them and from them."""
    kind = "array<struct<ref:bigint,query:int,len:int,before:int,after:int>>"

    def step(a: Column, x: Column) -> Column:
        match = x["op"].isin("M", "=", "X")
        grown = F.transform(a["found"], lambda f, i: F.struct(f["ref"].alias("ref"), f["query"].alias("query"), f["len"].alias("len"), f["before"].alias("before"), (f["after"] + F.when(match & a["open"] & (i == F.size(a["found"]) - 1), x["len"]).otherwise(0)).alias("after")))
        fresh = F.concat(a["found"], F.array(F.struct(a["ref"].alias("ref"), a["query"].alias("query"), x["len"].alias("len"), a["run"].alias("before"), F.lit(0).alias("after"))))
        return F.struct(
            (a["ref"] + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["len"]).otherwise(0)).alias("ref"), (a["query"] + F.when(x["op"].isin("M", "I", "S", "=", "X"), x["len"]).otherwise(0)).alias("query"),
            F.when(match, a["run"] + x["len"]).otherwise(0).alias("run"), F.when(x["op"] == "I", True).otherwise(a["open"] & match).alias("open"), F.when(x["op"] == "I", fresh).otherwise(grown).cast(kind).alias("found"),
        )

    start = F.struct(pos.cast("bigint").alias("ref"), F.lit(0).alias("query"), F.lit(0).alias("run"), F.lit(False).alias("open"), F.array().cast(kind).alias("found"))
    return F.aggregate(cigar, start, step, lambda a: a["found"])


def concordance(fragments: DataFrame, inserts: DataFrame, window: int = 300, least_length: int = 50, least: float = 0.85) -> DataFrame:
    """What an event's fragments say of its insert, by id: full_reads, lead_agree, tail_agree, best identities, concordant and qc.

    ``fragments``: id, qname, kind (LEAD, TAIL, CIGAR or SPLIT), sequence, and
    ``anchor_len`` and ``nm`` where known; ``inserts``: id, insert. A full read
    carries 50 bases of the insert in its CIGAR or a split. A leading clip is the
    insert's start, a trailing one its end: both are compared over up to 300
    bases, 50 at least. Low-complexity clips and poorly anchored ones do not
    count. It passes with a full read and clips of both sides or two of one.
    """
    c = F.col
    for name in ("anchor_len", "nm"):
        if name not in fragments.columns:
            fragments = fragments.withColumn(name, F.lit(-1))
    joined = fragments.join(inserts, "id").withColumns({"sequence": F.upper("sequence"), "insert": F.upper("insert")}).filter(F.length("insert") >= least_length)
    n = F.least(F.lit(window), F.length("sequence"), F.length("insert"))
    clip = c("kind").isin("LEAD", "TAIL")
    part = F.when(c("kind") == "LEAD", F.left(c("insert"), n)).otherwise(F.right(c("insert"), n))
    joined = joined.withColumn("_full", ~clip & (F.length("sequence") >= least_length))
    usable = clip & (n >= least_length) & ~seq.low_complexity("sequence") & ~weak_anchor(c("anchor_len"), c("nm"))
    joined = joined.withColumn("_identity", F.when(usable, 1 - F.levenshtein(F.left(c("sequence"), n), part) / n))
    good = c("_identity") + 1e-9 >= least
    reads = lambda condition, name: F.countDistinct(F.when(condition, c("qname"))).alias(name)
    best = lambda kind, name: F.coalesce(F.max(F.when(good & (c("kind") == kind), c("_identity"))), F.lit(0.0)).alias(name)
    out = joined.groupBy("id").agg(reads(c("_full"), "full_reads"), reads(good & (c("kind") == "LEAD"), "lead_agree"), reads(good & (c("kind") == "TAIL"), "tail_agree"), best("LEAD", "best_lead"), best("TAIL", "best_tail"))
    passed = (c("full_reads") >= 1) & (((c("lead_agree") >= 1) & (c("tail_agree") >= 1)) | (F.greatest("lead_agree", "tail_agree") >= 2))
    return out.withColumns({"concordant": passed, "qc": F.when(passed, "PASS_CLIP_INSERT_CONCORDANCE").otherwise("NO_CLIP_INSERT_CONCORDANCE")})


def weak_anchor(anchor_len: Column, nm: Column, least: int = 20, most: float = 0.12) -> Column:
    """Whether the aligned side of a clip is too short or too wrong to trust; an anchor of 0 or less was not measured."""
    return (anchor_len > 0) & ((anchor_len < least) | ((nm >= 0) & (nm / F.greatest(F.lit(1), anchor_len) > most)))


# Everything a component's evidence proposes

# Reach of the search, and of fragments that may widen it.
SEARCH, LINK, SINGLES = 200, 1000, 2
#: Buckets of positions by priority: pairs of sides, and single places.
PAIRED = {0: ("fragment_split_left", "fragment_split_right"), 2: ("raw_split_left", "raw_split_right"), 3: ("fragment_clip_left", "fragment_clip_right"), 5: ("raw_clip_left", "raw_clip_right")}
SINGLE = {1: "fragment_indel", 4: "raw_indel"}
FALLBACK = 1 << 30


def search_windows(components: DataFrame, candidates: DataFrame, fragments: DataFrame) -> DataFrame:
    """Components with the interval to search: their seeds and what precise evidence widens it to.

    ``components``: component, chrom, anchor, seed_left, seed_right; ``candidates``:
    component, pos, precise; ``fragments``: component, kind, pos. Precise
    candidates always widen it, insertions and splits of fragments within 1,000 of the seeds.
    """
    c = F.col
    low, high = F.least("seed_left", "seed_right"), F.greatest("seed_left", "seed_right")
    base = components.withColumns({"_lo": low, "_hi": high})
    wide = candidates.filter("precise and pos >= 0").select("component", "pos")
    linked = fragments.filter("kind in ('CIGAR', 'SPLIT') and pos >= 0").join(base.select("component", "_lo", "_hi"), "component").filter(F.greatest(F.lit(0), c("_lo") - c("pos"), c("pos") - c("_hi")) <= LINK).select("component", "pos")
    reach = wide.unionByName(linked).groupBy("component").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    start = F.greatest(F.lit(0), c("_lo") - SEARCH)
    rows = base.join(reach, "component", "left").withColumn("start", start)
    rows = rows.withColumn("end", F.greatest(c("start") + 1, c("_hi") + SEARCH))
    return rows.withColumns({"start": F.greatest(F.lit(0), F.least(c("start"), F.coalesce(c("_first") - SEARCH, c("start")))), "end": F.greatest(c("end"), F.coalesce(c("_last") + SEARCH, c("end")))}).drop("_lo", "_hi", "_first", "_last")


def breakpoint_positions(components: DataFrame, signals: DataFrame, fragments: DataFrame) -> DataFrame:
    """(component, bucket, pos) of all that lies in the search windows. ``signals``: ``reads.local_signals`` by component (id).

    A read has one split vote: of its first and last split the one nearer the
    anchor, the first of equals. ``fragments``: component, kind, side (L, R or null), pos.
    """
    c = F.col
    inside = components.select("component", "anchor", "start", "end")
    raw = signals.withColumnRenamed("id", "component").join(inside, "component")
    nearer = F.abs(c("split_left") - c("anchor")) <= F.abs(c("split_right") - c("anchor"))
    votes = F.array(
        F.struct(F.lit("raw_split_left").alias("bucket"), F.when(nearer, c("split_left")).alias("pos")), F.struct(F.lit("raw_split_right").alias("bucket"), F.when(~nearer, c("split_right")).alias("pos")),
        F.struct(F.lit("raw_clip_left").alias("bucket"), c("left_clip_pos").alias("pos")), F.struct(F.lit("raw_clip_right").alias("bucket"), c("right_clip_pos").alias("pos")), F.struct(F.lit("raw_indel").alias("bucket"), c("indel_pos").alias("pos")),
    )
    raw = raw.select("component", "start", "end", F.inline(votes))
    named = F.when(c("kind") == "CIGAR", "fragment_indel").when(c("kind") == "LEAD", "fragment_clip_left").when(c("kind") == "TAIL", "fragment_clip_right").when((c("kind") == "SPLIT") & (c("side") == "L"), "fragment_split_left").when((c("kind") == "SPLIT") & (c("side") == "R"), "fragment_split_right")
    own = fragments.join(inside, "component").select("component", "start", "end", named.alias("bucket"), "pos")
    return raw.unionByName(own).filter("bucket is not null and pos between start and end").select("component", "bucket", "pos")


def breakpoint_hypotheses(components: DataFrame, signals: DataFrame, fragments: DataFrame) -> DataFrame:
    """Every hypothesis of every component, ranked: component, lo, hi, centre, support, priority, rank; never none.

    Ten buckets of positions are clustered; six batches, strongest evidence
    first, pair their sides or take single places, and of equal intervals the
    first counts. A component without any gets its anchor at the lowest priority.
    """
    c = F.col
    positions = breakpoint_positions(components, signals, fragments)
    found = islands.islands_of_breakpoints(positions, ["component", "bucket"], "pos", GAP).join(components.select("component", "anchor"), "component")
    found = found.withColumn("_r", F.row_number().over(W.partitionBy("component", "bucket").orderBy(F.desc("support"), F.abs(c("centre") - c("anchor")), "centre"))).filter(f"_r <= {SIDES}")
    numbered = {name: (priority, side) for priority, (left, right) in PAIRED.items() for name, side in ((left, 0), (right, 1))} | {name: (priority, 2) for priority, name in SINGLE.items()}
    table = F.create_map(*(F.lit(x) for name, (priority, side) in numbered.items() for x in (name, priority * 3 + side)))
    found = found.withColumn("_p", F.element_at(table, c("bucket"))).withColumns({"priority": F.floor(c("_p") / 3).cast("int"), "side": c("_p") % 3})
    one = lambda df, second: df.select("component", "anchor", c("centre").alias("lo"), c("centre").alias("hi"), c("centre"), c("support"), "priority", c("_r").alias("_i"), F.lit(second).alias("_j"))
    left = found.filter("side = 0").select("component", "anchor", "priority", c("centre").alias("l"), c("support").alias("ls"), c("_r").alias("_i"))
    right = found.filter("side = 1").select("component", "priority", c("centre").alias("r"), c("support").alias("rs"), c("_r").alias("_j"))
    pairs = left.join(right, ["component", "priority"]).filter(F.abs(c("l") - c("r")) <= FURTHEST)
    pairs = pairs.select("component", "anchor", F.least("l", "r").alias("lo"), F.greatest("l", "r").alias("hi"), F.floor((c("l") + c("r")) / 2).alias("centre"), (c("ls") + c("rs")).alias("support"), "priority", "_i", "_j")
    sides = found.filter("side < 2").groupBy("component", "priority").agg(F.countDistinct("side").alias("_n")).filter("_n = 1").select("component", "priority")
    alone = found.filter("side < 2").join(sides, ["component", "priority"], "left_semi")
    every = pairs.unionByName(one(alone, 0)).unionByName(one(found.filter(f"side = 2 and _r <= {SINGLES}"), 0))
    first = ranks.first_per_group(every, ["component", "lo", "hi"], ["priority", "_i", "_j"])
    anchor = F.greatest(F.lit(0), c("anchor"))
    bare = components.join(first.select("component").distinct(), "component", "left_anti").select("component", "anchor", *(anchor.alias(n) for n in ("lo", "hi", "centre")), F.lit(1).cast("bigint").alias("support"), F.lit(FALLBACK).alias("priority"))
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), c("priority")), F.lit(1))
    every = first.select("component", "anchor", "lo", "hi", "centre", "support", "priority").unionByName(bare).withColumn("score", c("support") * weight)
    w = W.partitionBy("component").orderBy(F.desc("score"), F.abs(c("centre") - c("anchor")), F.desc("support"), "priority", "lo", "hi")
    return every.withColumn("rank", F.row_number().over(w))


# Fixed values of the diverse choice: one locus, near the anchor, the score that is rescued, and the distance of a rescued single read.
SAME, NEAR_ANCHOR, RESCUE_SCORE, RESCUE_APART = 30, 100, 8, 500


def diverse(hypotheses: DataFrame, most: int) -> DataFrame:
    """The best ``most`` hypotheses of a component that are not variants of one another, in order of choice (``choice``).

    If none is near the anchor, the best that scores replaces the last or is
    added; one precise single read far from all others may come on top. All are
    kept where there are no more than ``most``. A component has a bounded number of hypotheses.
    """
    schema, names = hypotheses.schema.simpleString()[7:-1] + ",choice:int", [*hypotheses.columns, "choice"]

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("rank").to_dict("records")
        taken = list(rows) if most == 0 or len(rows) <= most else []
        if not taken:
            for row in rows:
                if len(taken) < most and not any(abs(row["lo"] - t["lo"]) <= SAME and abs(row["hi"] - t["hi"]) <= SAME for t in taken):
                    taken.append(row)
            left = lambda: [r for r in rows if not any(r["lo"] == t["lo"] and r["hi"] == t["hi"] for t in taken)]
            away = lambda r: abs(r["centre"] - r["anchor"])
            near = any(away(t) <= NEAR_ANCHOR for t in taken)
            scoring = [r for r in left() if r["score"] >= RESCUE_SCORE]
            if not near and scoring:
                best = min(scoring, key=lambda r: (away(r), -r["score"], -r["support"], r["priority"], r["lo"], r["hi"]))
                if len(taken) < most:
                    taken.append(best)
                else:
                    taken[-1] = best
            if near or scoring:
                single = [r for r in left() if r["priority"] in (0, 1) and r["lo"] == r["hi"] and r["support"] <= 1 and all(abs(r["centre"] - t["centre"]) >= RESCUE_APART for t in taken)]
                if single:
                    taken.append(min(single, key=lambda r: (away(r), r["priority"], r["centre"])))
        return pd.DataFrame([{**t, "choice": i} for i, t in enumerate(taken, 1)], columns=names)

    return hypotheses.groupBy("component").applyInPandas(choose, schema)


def feasibility(inputs: DataFrame) -> DataFrame:
    """Adds ``validator_qc`` and ``gate_reason``: whether reads can place a consensus at all.

    Columns: full_context, partial_context, left_anchor, right_anchor, event_reads, alt_split, alt_cigar.
    """
    c = F.col
    both = (c("left_anchor") > 0) & (c("right_anchor") > 0)
    precise = (c("full_context") > 0) | (c("alt_split") + c("alt_cigar") > 0)
    partial = both & (c("partial_context") >= 2) & (c("event_reads") >= 2)
    placed = precise | partial
    return inputs.withColumns({
        "validator_qc": F.when(~both & ~precise, "VALIDATOR_NO_BILATERAL_ANCHOR").when(~placed, "VALIDATOR_NO_PRECISE_OR_FULL_CONTEXT").otherwise("VALIDATOR_PASS"),
        "gate_reason": F.when(~both, "PRESEG_NO_BILATERAL_ANCHOR").when(~placed, "PRESEG_NO_PRECISE_OR_FULL_CONTEXT").otherwise(""),
    })


def least_insertion(split_indel_reads: Column, clip_reads: Column, usual: int = 50, short: int = 35, least_reads: int = 2) -> Column:
    """Shortest insertion that is taken: shorter where splits and insertions are as many as the clips."""
    strong = (split_indel_reads > 0) & (split_indel_reads >= clip_reads) & (split_indel_reads >= max(1, least_reads))
    return F.when(strong, min(usual, max(10, short))).otherwise(usual)


def choose_insertions(insertions: DataFrame, most: int = 4, longest: int = 2) -> DataFrame:
    """A read's insertions that become fragments: the two longest wherever they are, then those near the component, four in all.

    ``insertions``: read, pos, length, start, local (within 1,000 of the anchor or a candidate).
    """
    order = W.partitionBy("read").orderBy(F.desc("length"), "pos", "start")
    ranked = insertions.dropDuplicates(["read", "pos", "length", "start"]).withColumn("_r", F.row_number().over(order))
    kept = ranked.filter((F.col("_r") <= longest) | F.col("local"))
    return kept.withColumn("_k", F.row_number().over(W.partitionBy("read").orderBy("_r"))).filter(F.col("_k") <= most).drop("_r", "_k")


def is_local(pos: Column, anchor: Column, candidates: Column, reach: int = 1000) -> Column:
    """Whether an insertion lies within reach of the anchor or of any candidate of an array."""
    near = lambda x: (x >= 0) & (F.abs(pos - x) <= reach)
    return (pos >= 0) & (near(anchor) | F.exists(candidates, near))


def reliable_claims(claims: DataFrame, observed: DataFrame) -> DataFrame:
    """SA claims (read, ord, qstart, qend, reverse) with ``reliable``: none observed for the read, or the best overlap of its
    observed supplementary alignments (read, qstart, qend, reverse) on the strand reaches 0.9 with both ends within 5."""
    seen = observed.select("read").distinct().withColumn("_seen", F.lit(True))
    o = observed.select("read", F.col("qstart").alias("_q0"), F.col("qend").alias("_q1"), F.col("reverse").alias("_rev"))
    pairs = claims.select("read", "ord", "qstart", "qend", "reverse").join(o, "read").filter("reverse = _rev").withColumn("_iou", interval_iou("qstart", "qend", "_q0", "_q1"))
    best = pairs.filter("_iou > 0").groupBy("read", "ord").agg(F.max(F.struct("_iou", -F.abs(F.col("qstart") - F.col("_q0")), -F.abs(F.col("qend") - F.col("_q1")))).alias("_b"))
    good = (F.col("_b._iou") >= 0.9) & (F.col("_b").getField("col2") >= -5) & (F.col("_b").getField("col3") >= -5)
    out = claims.join(seen, "read", "left").join(best, ["read", "ord"], "left")
    return out.withColumn("reliable", F.when(F.col("_seen").isNull(), True).otherwise(F.coalesce(good, F.lit(False)))).drop("_seen", "_b")


def flank_and_mate(records: DataFrame, radius: int, least: int = 50) -> DataFrame:
    """Per read the best flank and its mate: (read, flank, mate, implied). ``records``: read, ord, chrom, component_chrom, anchor,
    ref_start, ref_end, qstart, qend, reverse, anchor_len, mapq, nm, primary, large_indel.

    The flank is near the anchor, with most anchored bases less its errors (a large
    indel counts five); the mate brings most query that the flank lacks, ``least``
    at least; ``implied`` is the insertion that the two imply, -1 across contigs or strands.
    """
    c = F.col
    fields = ["ord", "chrom", "ref_start", "ref_end", "qstart", "qend", "reverse", "anchor_len", "nm", "primary"]
    score = c("anchor_len") - F.greatest(F.lit(0), c("nm")) - F.when(c("large_indel"), 5).otherwise(0)
    away = gap_to_point("ref_start", "ref_end", "anchor")
    near = records.filter(c("chrom") == c("component_chrom")).withColumns({"_s": score, "_d": away}).filter(c("_d") <= radius)
    order = W.partitionBy("read").orderBy(F.desc("_s"), F.desc("anchor_len"), F.desc("mapq"), "nm", F.desc("primary"), "ref_start", "_d", "ord")
    flank = near.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("read", F.struct(*fields).alias("flank"))
    pairs = records.select("read", F.struct(*fields).alias("mate")).join(flank, "read").filter("mate.ord <> flank.ord")
    pairs = pairs.withColumn("_new", outside_length("mate.qstart", "mate.qend", "flank.qstart", "flank.qend"))
    best = pairs.withColumn("_r", F.row_number().over(W.partitionBy("read").orderBy(F.desc("_new"), "mate.ord"))).filter(f"_r = 1 and _new >= {least}")
    a, b = c("flank"), c("mate")
    first = b["qstart"] >= a["qstart"]
    gap = F.when(first, b["qstart"] - a["qend"] - F.greatest(F.lit(0), b["ref_start"] - a["ref_end"])).otherwise(a["qstart"] - b["qend"] - F.greatest(F.lit(0), a["ref_start"] - b["ref_end"]))
    same = (a["chrom"] == b["chrom"]) & (a["reverse"] == b["reverse"])
    return best.withColumn("implied", F.when(same, gap).otherwise(-1)).select("read", "flank", "mate", "implied")
