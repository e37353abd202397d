"""Sequence and text columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def reverse_complement(s: Column | str) -> Column:
    """Reverse complement of an upper-case sequence; anything but A, C, G, T becomes N."""
    return F.translate(F.reverse(F.regexp_replace(_c(s), "[^ACGT]", "N")), "ACGT", "TGCA")


def header_token(s: Column | str) -> Column:
    """First token of a header line."""
    return F.split(F.trim(_c(s)), r"\s+").getItem(0)


def windows(s: Column | str, k: int) -> Column:
    """All substrings of length ``k``; an empty array for shorter texts."""
    s = _c(s)
    starts = F.sequence(F.lit(1), F.length(s) - k + 1)
    return F.when(F.length(s) >= k, F.transform(starts, lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmers(s: Column | str, k: int) -> Column:
    """Substrings of length ``k`` made of A, C, G and T only."""
    return F.filter(windows(s, k), lambda x: x.rlike("^[ACGT]+$"))


def canonical(kmer: Column | str) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(_c(kmer), reverse_complement(kmer))


def kmer_key(kmer: Column | str) -> Column:
    """Two bits a base, as a number."""
    return F.conv(F.translate(_c(kmer), "ACGT", "0123"), 4, 10).cast("long")


def count_of(s: Column | str, letter: str) -> Column:
    """Occurrences of one character."""
    s = _c(s)
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def letter_fraction(s: Column | str, letters: str, among: str = "ACGT") -> Column:
    """Share of some letters among others; null when there is none of them."""
    part = sum((count_of(s, x) for x in letters[1:]), count_of(s, letters[0]))
    whole = sum((count_of(s, x) for x in among[1:]), count_of(s, among[0]))
    return F.try_divide(part.cast("double"), whole.cast("double"))


def entropy(s: Column | str, letters: str = "ACGT") -> Column:
    """Shannon entropy in bits over the given letters; 0 when there is none of them."""
    counts = [count_of(s, x).cast("double") for x in letters]
    total = sum(counts[1:], counts[0])
    terms = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in counts]
    return F.when(total > 0, sum(terms[1:], terms[0])).otherwise(0.0)


def longest_run(s: Column | str) -> Column:
    """Length of the longest run of one character."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(_c(s), F.lit(r"((.)\2*)"), F.lit(1)), F.length)), F.lit(0))


def terminal_run(s: Column | str, letter: str = "A") -> Column:
    """Length of the run of one letter at the end."""
    return F.length(F.regexp_extract(_c(s), f"{letter}*$", 0))


def kmer_uniqueness(s: Column | str, k: int) -> Column:
    """Distinct over all valid k-mers; null without any."""
    k_ = kmers(s, k)
    return F.try_divide(F.size(F.array_distinct(k_)).cast("double"), F.size(k_).cast("double"))


def edit_identity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(_c(a)), F.length(_c(b)))
    return F.when(longest > 0, 1 - F.levenshtein(_c(a), _c(b)) / longest).otherwise(1.0)


def edit_identity_at_least(a: Column, b: Column, share: float) -> Column:
    """The identity where it reaches ``share``, else null; the distance is cut off at its bound."""
    longest = F.greatest(F.length(a), F.length(b))
    distance = F.levenshtein(a, b)
    identity = 1 - distance / longest
    return F.when((longest > 0) & (distance <= F.floor(longest * (1 - share) + 1e-9)), identity)


def low_complexity(s: Column | str, k: int = 5, longest: int = 80) -> Column:
    """AT-rich, with a run of ``longest`` equal letters, of low entropy, or of few distinct k-mers; texts without a k-mer have none."""
    s = _c(s)
    at = F.coalesce(letter_fraction(s, "AT"), F.lit(0.0))
    unique = F.coalesce(kmer_uniqueness(s, k), F.lit(0.0))
    return (F.length(s) > 0) & ((at >= 0.90) | (longest_run(s) >= longest) | (entropy(s) < 1.25) | (unique < 0.35))


def repeat_name_parts(name: Column | str) -> Column:
    """(name, family, superfamily) of ``name#Class/Super``, ``Super:Family`` and bare names."""
    n = header_token(name)
    left, right = F.substring_index(n, "#", 1), F.when(F.instr(n, "#") > 0, F.substring_index(n, "#", -1))
    family = F.when(F.instr(left, ":") > 0, F.substring_index(left, ":", -1)).otherwise(left)
    upper = F.when(right.isNotNull() & (F.instr(right, "/") > 0), F.substring_index(right, "/", -1)).when(right.isNotNull(), right).when(F.instr(left, ":") > 0, F.substring_index(left, ":", 1)).otherwise(left)
    return F.struct(left.alias("name"), family.alias("family"), upper.alias("superfamily"))


def parse_cigar(c: Column | str) -> Column:
    """Array of (len, op), or null when the whole is not a CIGAR."""
    c = _c(c)
    ops = F.regexp_extract_all(c, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    parsed = F.transform(ops, lambda x: F.struct(F.regexp_extract(x, r"^\d+", 0).cast("int").alias("len"), F.substring(x, -1, 1).alias("op")))
    return F.when(c.rlike(r"^(\d+[MIDNSHP=X])+$"), parsed)


def cigar_total(cigar: Column, ops: str) -> Column:
    """Sum of the lengths of some operations of a parsed CIGAR."""
    return F.aggregate(F.filter(cigar, lambda x: F.lit(ops).contains(x["op"])), F.lit(0), lambda a, x: a + x["len"])


def reference_end(pos: Column, cigar: Column) -> Column:
    """Position after the last aligned base; ``pos`` without a CIGAR."""
    return pos + F.coalesce(cigar_total(cigar, "MDN=X"), F.lit(0))


def longest_match(cigar: Column) -> Column:
    """Longest run of matching operations that nothing interrupts."""
    step = lambda a, x: F.struct(
        F.when(F.lit("M=X").contains(x["op"]), a["run"] + x["len"]).otherwise(F.lit(0)).alias("run"),
        F.greatest(a["best"], F.when(F.lit("M=X").contains(x["op"]), a["run"] + x["len"]).otherwise(F.lit(0))).alias("best"),
    )
    return F.aggregate(cigar, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), step, lambda a: a["best"])


def parse_sa(tag: Column | str) -> Column:
    """Supplementary alignments of an SA tag: (chrom, pos, strand, cigar, mapq, nm); malformed ones are dropped one by one."""
    parts = F.filter(F.split(_c(tag), ";"), lambda x: x.rlike(r"^[^,]+,\d+,[+-],(\d+[MIDNSHP=X])+,\d+,\d+$"))

    def fields(x: Column) -> Column:
        f = F.split(x, ",")
        return F.struct(f[0].alias("chrom"), (f[1].cast("long") - 1).alias("pos"), f[2].alias("strand"), f[3].alias("cigar"), f[4].cast("int").alias("mapq"), f[5].cast("int").alias("nm"))

    return F.transform(parts, fields)
