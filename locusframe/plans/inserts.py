"""Consensus of an event's reads, the library alignment of inserts, and what of it is informative."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import seq
from ..functions.udfs import semiglobal_identity
from ..operators import kmers, ranks
from ..session import workers


def event_consensus(strings: DataFrame, keys: list[str], text: str, consensus: Callable[[list[str]], str] | None = None, most: int = 48, budget: int | None = None) -> DataFrame:
    """(keys, consensus, reads) of the strings of each event, the longest first and no more than fit.

    Partial-order consensus is an adapter's work and comes in as a function of the
    sorted strings. Without one only equal strings have a consensus; others are
    an error, since no choice among them is one.
    """
    kept = ranks.longest_first(strings, keys, text, most, budget)
    if consensus is None:
        agreed = kept.groupBy(*keys).agg(F.count_distinct(text).alias("_n"), F.first(text).alias("consensus"), F.count(F.lit(1)).alias("reads"))
        return agreed.withColumn("consensus", F.when(F.col("_n") > 1, F.raise_error(F.lit("differing strings need a consensus function"))).otherwise(F.upper("consensus"))).drop("_n")
    schema = strings.select(*keys).schema.simpleString()[7:-1] + ",consensus:string,reads:bigint"
    names = [*keys, "consensus", "reads"]

    def build(group: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(group[text], key=lambda x: (-len(x), x))
        return pd.DataFrame([[*(group.iloc[0][k] for k in keys), consensus(texts).upper(), len(texts)]], columns=names)

    return kept.groupBy(*keys).applyInPandas(build, schema)


def side_consensus(clips: DataFrame, keys: list[str], text: str, consensus: Callable[[list[str]], str], longest: int = 3000) -> DataFrame:
    """(keys, kind, consensus, reads) of the clips of each junction (LEAD or TAIL), each cut to what is nearest the junction."""
    near = F.when(F.col("kind") == "LEAD", F.right(F.col(text), F.lit(longest))).otherwise(F.left(F.col(text), F.lit(longest)))
    return event_consensus(clips.withColumn(text, near), [*keys, "kind"], text, consensus)


def best_flank_pair(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The pair of flank placements of each event: query order kept, then by the worse identity, the mean, the breakpoint
    distances, the lengths and the starts. Columns of both sides: identity, delta, align_len, query_start, query_end, ref_start.
    Each side has a bounded number of placements."""
    a, b = left.select(*keys, F.struct(*[c for c in left.columns if c not in keys]).alias("l")), right.select(*keys, F.struct(*[c for c in right.columns if c not in keys]).alias("r"))
    l, r = F.col("l"), F.col("r")
    pairs = a.join(b, keys).filter(l["query_end"] + 1 <= r["query_start"])
    order = F.struct(-F.least(l["identity"], r["identity"]), -(l["identity"] + r["identity"]) / 2, l["delta"] + r["delta"], -(l["align_len"] + r["align_len"]), l["ref_start"], r["ref_start"])
    return pairs.groupBy(*keys).agg(F.min_by(F.struct("l", "r"), order).alias("_p")).select(*keys, F.col("_p.l").alias("left"), F.col("_p.r").alias("right"))


def aligned_once(inserts: DataFrame, text: str, align: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Inserts joined to the alignment of their distinct texts: equal inserts are aligned once. ``align`` takes (query) and returns its hits with it."""
    distinct = inserts.select(F.upper(text).alias("query")).filter("query <> ''").distinct()
    return inserts.withColumn("query", F.upper(text)).join(align(distinct), "query", "left")


def align_to_library(queries: DataFrame, library: DataFrame, k: int = 11, band: int = 16, least: int = 3, most: int = 100) -> DataFrame:
    """Hits of queries (query) in a library (name, sequence): query, subject, strand, qlo, qhi, slo, shi, seeds, identity.

    Shared k-mers are binned by diagonal; the best bins of ``least`` seeds or more
    are verified by a semiglobal edit identity of the stretch between the first and
    last seed. K-mers in more than ``most`` places of the library seed nothing.
    This is not the reference aligner's search and does not promise its hits.
    """
    workers(queries.sparkSession)
    both = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.upper("sequence").alias("s")), F.struct(F.lit("-").alias("strand"), seq.reverse_complement(F.upper("sequence")).alias("s"))))
    subjects = library.select(F.col("name").alias("subject"), both.alias("x")).select("subject", "x.strand", "x.s")
    named = subjects.withColumn("sid", F.struct("subject", "strand"))
    places = kmers.explode_windows(named, "sid", "s", k).filter(F.col("kmer").rlike("^[ACGT]+$"))
    rare = places.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("kmer"))).filter(F.col("_n") <= most).drop("_n")
    asked = kmers.explode_windows(queries, "query", "query", k).select(F.col("id").alias("query"), F.col("at").alias("q"), "kmer")
    pairs = asked.join(rare.select("id", F.col("at").alias("t"), "kmer"), "kmer")
    bins = pairs.groupBy("query", "id", F.floor((F.col("t") - F.col("q")) / band).alias("d")).agg(F.count(F.lit(1)).alias("seeds"), F.min("q").alias("qlo"), (F.max("q") + k).alias("qhi"), F.min("t").alias("slo"), (F.max("t") + k).alias("shi"))
    best = ranks.top_k(bins.filter(F.col("seeds") >= least), ["query", "id"], [F.desc("seeds"), "d"], 1)
    texts = best.join(named.select(F.col("sid").alias("id"), "s"), "id")
    part = lambda text, lo, hi: F.substring(text, F.col(lo) + 1, F.col(hi) - F.col(lo))
    scored = texts.withColumn("identity", semiglobal_identity(part(F.col("query"), "qlo", "qhi"), part(F.col("s"), "slo", "shi")))
    return scored.select("query", "id.subject", "id.strand", "qlo", "qhi", "slo", "shi", "seeds", "identity")


def informative_bases(intervals: Column, mask: Column) -> Column:
    """Bases that intervals (start, end) cover together and that a mask (true where a simple repeat) leaves, each counted once."""
    n = F.size(mask)
    clipped = F.array_sort(F.transform(intervals, lambda x: F.struct(F.greatest(F.lit(0), x["start"]).cast("int").alias("a"), F.least(n, x["end"]).cast("int").alias("b"))))

    def step(acc: Column, x: Column) -> Column:
        start = F.greatest(x["a"], acc["reach"])
        fresh = F.when(x["b"] > start, F.size(F.filter(F.slice(mask, start + 1, F.greatest(x["b"] - start, F.lit(0))), lambda m: ~m))).otherwise(0)
        return F.struct((acc["total"] + fresh).alias("total"), F.greatest(acc["reach"], x["b"]).alias("reach"))

    return F.aggregate(clipped, F.struct(F.lit(0).alias("total"), F.lit(0).alias("reach")), step, lambda a: a["total"])


def combine_sides(main: Column, first: Column, last: Column) -> Column:
    """(qc, family, subfamily, identity, aligned, covered, coverage) of an insert from its own alignment, or else from its two assembled ends.

    Structs of (named, qc, family, subfamily, identity, aligned, covered, length);
    ``named``: whether an element is named. Two ends of one family are one element
    seen from both: identity weighs by aligned bases, which add. Else the longer
    end's family counts alone.
    """
    one, two = F.coalesce(first["named"], F.lit(False)), F.coalesce(last["named"], F.lit(False))
    front = one & (~two | (first["aligned"] >= last["aligned"]))
    best = lambda name: F.when(front, first[name]).otherwise(last[name])
    agree = one & two & (first["family"] == last["family"])
    total = first["aligned"] + last["aligned"]
    share = lambda covered, length: F.when(length > 0, covered / length).otherwise(0.0)
    row = lambda qc, family, subfamily, identity, aligned, covered, coverage: F.struct(qc.alias("qc"), family.alias("family"), subfamily.alias("subfamily"), identity.alias("identity"), aligned.alias("aligned"), covered.alias("covered"), coverage.alias("coverage"))
    own = row(main["qc"], main["family"], main["subfamily"], main["identity"], main["aligned"], main["covered"], share(main["covered"], main["length"]))
    weighed = F.when(total > 0, (first["identity"] * first["aligned"] + last["identity"] * last["aligned"]) / total).otherwise(best("identity"))
    both = row(F.lit("PASS_INSERT_TE_ALIGNMENT_CLIP_SIDES"), best("family"), best("subfamily"), weighed, total, first["covered"] + last["covered"], share(first["covered"] + last["covered"], first["length"] + last["length"]))
    alone = row(F.lit("PASS_INSERT_TE_ALIGNMENT_CLIP_SIDES_FAMILY_ONLY"), best("family"), F.lit("UNKNOWN"), best("identity"), best("aligned"), best("covered"), share(best("covered"), best("length")))
    return F.when(F.coalesce(main["named"], F.lit(False)) | ~(one | two), own).when(agree, both).otherwise(alone)
