"""What a run reads and how it is set up: regions, sample names, contigs, settings, contracts and chunks."""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import seq


@dataclass(frozen=True)
class Region:
    """A contig's interval, half open; without a contig everything, without an end (-1) to the contig's end."""

    chrom: str = ""
    start: int = 0
    end: int = -1


def parse_region(text: str) -> Region:
    """``chrom`` or ``chrom:first-last`` with positions from 1, both ends included. A malformed one raises and is never widened."""
    if not text:
        raise ValueError("empty region")
    chrom, colon, span = text.rpartition(":")
    if not colon:
        return Region(text)
    found = re.fullmatch(r"\s*([+-]?[0-9]+)\s*-\s*([+-]?[0-9]+)\s*", span)
    if not chrom or not found:
        raise ValueError(f"invalid region: {text}")
    first, last = int(found[1]), int(found[2])
    if first <= 0 or last < first or last > 2**31 - 1:
        raise ValueError(f"invalid region: {text}")
    return Region(chrom, first - 1, last)


def normalise_region(region: Region | None) -> Region | None:
    """A region that holds together: none without a contig, no negative start, no empty interval."""
    if region is None or not region.chrom:
        return None
    start = max(0, region.start)
    return replace(region, start=start, end=start + 1 if 0 < region.end <= start else region.end)


def in_region(region: Region | None, chrom: str = "chrom", start: str = "pos", end: Column | str = "ref_end") -> Column:
    """Whether a record overlaps a region; true for every record without one. A filter on contig and start reaches the scan."""
    region = normalise_region(region)
    if region is None:
        return F.lit(True)
    last = F.col(end) if isinstance(end, str) else end
    inside = (F.col(chrom) == region.chrom) & (last > region.start)
    return inside if region.end < 0 else inside & (F.col(start) < region.end)


def scan(reads: DataFrame, region: Region | None = None) -> DataFrame:
    """Mapped, not secondary records that overlap a region, with their reference end. Counters come from ``reads.gate_counters``."""
    kept = reads.filter(F.col("flag").bitwiseAND(0x104) == 0).withColumn("ref_end", seq.reference_end(F.col("pos"), F.col("cigar")))
    return kept.filter(in_region(region))


def sample_name(header: DataFrame, path: str) -> str:
    """The first distinct SM of a header's @RG lines (``value``), with a warning if they differ, else the file's stem."""
    sm = F.regexp_extract("value", r"\tSM:([^\t]*)", 1)
    names = [r[0] for r in header.filter("value like '@RG\t%'").select(F.trim(sm).alias("n")).filter("n <> ''").distinct().orderBy("n").collect()]  # one row a sample
    if len(names) > 1:
        warnings.warn(f"read groups name several samples {names}; {names[0]!r} is used", stacklevel=2)
    if names:
        return names[0]
    stem = re.split(r"[/\\]", path.rstrip("/"))[-1]
    return stem.rsplit(".", 1)[0] or "SAMPLE"


def settings(defaults: Mapping[str, object], environment: Mapping[str, str], flags: Mapping[str, object], prefix: str = "LOCUSFRAME_") -> dict[str, object]:
    """Defaults, then environment variables, then flags. A variable that does not parse as its default's type is warned of and ignored."""
    out = dict(defaults)
    for name, default in defaults.items():
        raw = environment.get(prefix + name.upper())
        if raw is None:
            continue
        try:
            out[name] = raw.strip().lower() in ("1", "true", "yes", "on") if isinstance(default, bool) else type(default)(raw)
        except (TypeError, ValueError):
            warnings.warn(f"{prefix}{name.upper()}={raw!r} is not a {type(default).__name__} and is ignored", stacklevel=2)
    return out | {k: v for k, v in flags.items() if v is not None}


@dataclass(frozen=True)
class Contract:
    """Columns that a table lacks, and those beyond the contract."""

    missing: tuple[str, ...]
    extra: tuple[str, ...]
    wrong: tuple[str, ...] = ()

    @property
    def holds(self) -> bool:
        """Extra columns are fine, missing and wrongly typed ones are not."""
        return not self.missing and not self.wrong


def check_contract(df: DataFrame, required: T.StructType | list[str]) -> Contract:
    """A table's columns against a contract: names, or a schema whose types count too."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = {f.name: f.dataType.simpleString() for f in required.fields} if isinstance(required, T.StructType) else dict.fromkeys(required)
    wrong = tuple(sorted(n for n, kind in want.items() if kind and n in have and have[n] != kind))
    return Contract(tuple(sorted(set(want) - set(have))), tuple(sorted(set(have) - set(want))), wrong)


def plan_chunks(spans: DataFrame, chunk: int, bin_size: int) -> DataFrame:
    """Spans (chrom, start, end) cut at multiples of whole bins: chrom, chunk, start, end."""
    step = -(-max(1, chunk) // bin_size) * bin_size
    first, last = F.floor(F.col("start") / step), F.floor((F.col("end") - 1) / step)
    cut = spans.filter("end > start").select("chrom", "start", "end", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("_k"))
    return cut.select("chrom", F.col("_k").alias("chunk"), F.greatest("start", F.col("_k") * step).alias("start"), F.least("end", (F.col("_k") + 1) * step).alias("end"))


def split_heavy(chunks: DataFrame, estimate: str, bin_size: int, factor: float = 2.0, most: int = 32) -> DataFrame:
    """Chunks whose estimate is over ``factor`` medians in (estimate / median) squared pieces at bin boundaries; ``piece`` numbers them."""
    ordered = chunks.filter(F.col(estimate) > 0).agg(F.sort_array(F.collect_list(estimate)).alias("_e"))  # one row a chunk
    median = F.get("_e", F.floor(F.size("_e") / 2).cast("int"))
    rows = chunks.crossJoin(F.broadcast(ordered.select(median.alias("_m"))))
    bins = F.floor((F.col("end") - 1) / bin_size) - F.floor(F.col("start") / bin_size) + 1
    pieces = F.when((F.col(estimate) > factor * F.col("_m")) & (bins > 1), F.least(F.lit(most), bins, F.ceil((F.col(estimate) / F.col("_m")) * (F.col(estimate) / F.col("_m"))))).otherwise(1).cast("long")
    low = F.floor(F.col("start") / bin_size)
    rows = rows.withColumns({"_n": pieces, "_b": bins, "_low": low}).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    edge = lambda k: (F.col("_low") + F.floor(k * F.col("_b") / F.col("_n"))) * bin_size
    return rows.withColumns({"start": F.greatest("start", edge(F.col("piece"))), "end": F.least("end", edge(F.col("piece") + 1))}).drop("_m", "_n", "_b", "_low")


def merge_counters(parts: list[DataFrame], counters: list[str], finalised: str = "finalised") -> DataFrame:
    """One row of summed counters of scans that follow one another; a finalised part is an error."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    checked = F.when(F.col(finalised), F.raise_error(F.lit("only scans that are not finalised can be merged"))).otherwise(F.lit(0))
    return rows.withColumn("_ok", checked.cast("long")).agg(*((F.sum(c) + F.sum("_ok")).alias(c) for c in counters))


def append_parts(parts: list[DataFrame]) -> DataFrame:
    """A bag of rows in the order of the parts: ``part`` numbers them."""
    out = None
    for i, part in enumerate(parts):
        rows = part.withColumn("part", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out


def example_reads(spark: SparkSession, reads: int = 200, contig: int = 120_000, insert: int = 320, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Deterministic reads over one synthetic contig with an insertion at every tenth of it, and the truth (chrom, pos, length).

    A read is whole or carries the insertion that it spans, by a hash of its number.
    """
    truth = spark.range(1, 10).select(F.lit("syn1").alias("chrom"), (F.col("id") * (contig // 10)).alias("pos"), F.lit(insert).alias("length"))
    rows = spark.range(reads).select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(contig - 8000)).alias("pos"))
    site = (F.floor((F.col("pos") + 4000) / (contig // 10)) * (contig // 10)).cast("long")
    spans = (site - F.col("pos") >= 500) & (F.col("pos") + 8000 - site >= 500) & (site > 0) & (F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(2)) == 0)
    cigar = F.when(spans, F.format_string(f"%dM{insert}I%dM", site - F.col("pos"), F.col("pos") + 8000 - site)).otherwise("8000M")
    out = rows.select(F.format_string("syn%05d", "id").alias("qname"), F.lit(0).alias("flag"), F.lit(0).alias("tid"), F.lit("syn1").alias("chrom"), "pos", F.lit(60).alias("mapq"), seq.parse_cigar(cigar).alias("cigar"), F.repeat(F.lit("A"), F.when(spans, 8000 + insert).otherwise(8000)).alias("seq"), F.lit(None).cast("string").alias("sa"), F.lit(0).alias("nm"))
    return out, truth
