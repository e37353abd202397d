"""Small functions of intervals, tokens, numbers and sequence ends, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from . import seq


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


# Intervals, half open


def overlap_length(a0, a1, b0, b1) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0), F.least(_c(a1), _c(b1)) - F.greatest(_c(a0), _c(b0)))


def outside_length(a0, a1, b0, b1) -> Column:
    """Length of the first interval that the second does not cover."""
    return F.greatest(F.lit(0), F.greatest(F.lit(0), _c(a1) - _c(a0)) - overlap_length(a0, a1, b0, b1))


def interval_iou(a0, a1, b0, b1) -> Column:
    """Shared length by the hull of both; 0 for an empty hull."""
    hull = F.greatest(_c(a1), _c(b1)) - F.least(_c(a0), _c(b0))
    return F.when(hull > 0, overlap_length(a0, a1, b0, b1) / hull).otherwise(0.0)


def gap_to_point(start, end, point) -> Column:
    """Distance from an interval, given in either order and both ends included, to a point."""
    lo, hi = F.least(_c(start), _c(end)), F.greatest(_c(start), _c(end))
    return F.greatest(F.lit(0), lo - _c(point), _c(point) - hi)


# Tokens, divided by |


def has_token(tokens, token) -> Column:
    """Whether a whole token is among them; an empty one never is."""
    return (_c(token) != "") & F.array_contains(F.split(_c(tokens), "[|]"), _c(token))


def append_token(tokens, token) -> Column:
    """Tokens with one more, unless it is there or empty."""
    return F.when((_c(token) == "") | has_token(tokens, token), _c(tokens)).when(_c(tokens) == "", _c(token)).otherwise(F.concat_ws("|", _c(tokens), _c(token)))


# Numbers


def strict_int(text) -> Column:
    """The whole text as a decimal number with an optional sign, else null."""
    t = _c(text)
    return F.when(t.rlike(r"\A[+-]?[0-9]+\z"), t.try_cast("bigint"))


def kmer_sizes(csv, fallback: int) -> Column:
    """Sizes from 7 to 31 of a comma-separated list and the fallback, distinct and in order; 13 where there is none."""
    parsed = F.transform(F.split(_c(csv), ","), lambda x: strict_int(F.trim(x)).cast("int"))
    wanted = F.filter(parsed, lambda x: x.between(7, 31))
    if 7 <= fallback <= 31:
        wanted = F.concat(wanted, F.array(F.lit(fallback)))
    return F.when(F.size(wanted) == 0, F.array(F.lit(13))).otherwise(F.array_sort(F.array_distinct(wanted)))


def most_edits(left_length, right_length, identity) -> Column:
    """Edits that an identity allows over the longer of two lengths."""
    longer = F.greatest(_c(left_length), _c(right_length))
    kept = F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(identity)))
    return F.when(longer <= 0, 0).otherwise(F.greatest(F.lit(0), F.floor((1 - kept) * longer + 1e-9))).cast("int")


def rounded_share(length, share) -> Column:
    """A share of a length to the nearest whole, halves up; 0 for what is not finite."""
    n, s = _c(length), _c(share)
    finite = ~F.isnan(s) & (F.abs(s) != F.lit(math.inf))
    return F.when((n <= 0) | ~finite, 0).otherwise(F.floor(n * F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)) + 0.5)).cast("int")


# Fixed values of the 64-bit FNV-1a hash.
_FNV_HIGH, _FNV_LOW, _FNV_PRIME_LOW, _FNV_PRIME_SHIFT = 0xCBF29CE4, 0x84222325, 0x1B3, 256
_WORD = 0xFFFFFFFF


def fnv1a(text) -> Column:
    """FNV-1a over the UTF-8 bytes, as 16 hexadecimal digits. The product is taken in two halves, which no bigint overflows."""
    raw = F.hex(F.encode(_c(text), "UTF-8"))
    places = F.when(F.length(raw) > 0, F.sequence(F.lit(1), F.length(raw) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))

    def step(h: Column, at: Column) -> Column:
        low = h["l"].bitwiseXOR(F.conv(F.substring(raw, at, F.lit(2)), 16, 10).cast("bigint"))
        product = low * _FNV_PRIME_LOW
        high = (h["h"] * _FNV_PRIME_LOW + low * _FNV_PRIME_SHIFT + F.shiftright(product, 32)).bitwiseAND(F.lit(_WORD))
        return F.struct(high.alias("h"), product.bitwiseAND(F.lit(_WORD)).alias("l"))

    start = F.struct(F.lit(_FNV_HIGH).cast("bigint").alias("h"), F.lit(_FNV_LOW).cast("bigint").alias("l"))
    return F.aggregate(places, start, step, lambda h: F.concat(F.lpad(F.lower(F.hex(h["h"])), 8, "0"), F.lpad(F.lower(F.hex(h["l"])), 8, "0")))


# Sequence ends


def final_run(text, letter) -> Column:
    """Length of the run of one letter that ends a text."""
    t = _c(text)
    return F.length(t) - F.length(F.rtrim(t, _c(letter)) if not isinstance(letter, str) else F.regexp_replace(t, f"{letter}+\\z", ""))


def final_at_run(text) -> Column:
    """Length of the run of A, or of T, that ends a text."""
    return F.greatest(final_run(text, "A"), final_run(text, "T"))


def tolerant_tail(text, letter: str, resume: int = 6) -> Column:
    """Length of the tail of one letter, in which a single other letter counts where ``resume`` of the tail's follow it leftwards."""
    return F.length(F.regexp_extract(F.reverse(_c(text)), rf"\A({letter}+(?:[^{letter}]{letter}{{{resume},}})*)", 1))


def end_reached(position, target, length, slack: int = 30, share: float = 0.03) -> Column:
    """Whether a position lies within a tolerance of an element's end."""
    p, n = _c(position), _c(length)
    return F.when((p < 0) | (n <= 0), False).otherwise(F.abs(_c(target) - p) <= F.greatest(F.lit(float(slack)), share * n))


def pattern_matches(text, pattern: str) -> Column:
    """Places at which a text agrees with a pattern in which R is A or G."""
    t, out = _c(text), F.lit(0)
    for i, want in enumerate(pattern, 1):
        out = out + F.when(F.substring(t, i, 1).isin(*("AG" if want == "R" else want)), 1).otherwise(0)
    return out


def place_identity(a, b) -> Column:
    """Share of places at which two texts of one length agree; 0 for other ones."""
    a, b = _c(a), _c(b)
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.lit(0), lambda n, i: n + F.when(F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)), 1).otherwise(0))
    return F.when((F.length(a) == 0) | (F.length(a) != F.length(b)), 0.0).otherwise(same / F.length(a))


def entropy_share(text, start, end) -> Column:
    """Entropy of the A, C, G, T of a slice by ln 4; shares are of the whole slice. 0 for an empty one."""
    t = _c(text)
    lo = F.greatest(F.lit(0), F.least(_c(start), F.length(t)))
    n = F.greatest(lo, F.least(_c(end), F.length(t))) - lo
    part = F.substring(t, (lo + 1).cast("int"), n.cast("int"))
    total = F.lit(0.0)
    for letter in "ACGT":
        p = (n - F.length(F.replace(part, F.lit(letter), F.lit("")))) / n
        total = total - F.when(p > 0, p * F.log(p)).otherwise(0.0)
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / math.log(4.0))))


# The nicked strand's consensus with the nick after its fourth base, and its model.
NICK, NICK_MATCH, NICK_MISMATCH = "TTTTAA", 0.85, 0.05


def nick_windows(left, right) -> Column:
    """(plus, minus) windows of six bases that could hold the nicked motif; null where a flank has fewer than four."""
    l, r = F.upper(_c(left)), F.upper(_c(right))
    long_enough = (F.length(l) >= 4) & (F.length(r) >= 4)
    plus, minus = F.concat(F.right(l, F.lit(4)), F.left(r, F.lit(2))), seq.reverse_complement(F.concat(F.right(l, F.lit(2)), F.left(r, F.lit(4))))
    return F.when(long_enough, F.struct(plus.alias("plus"), minus.alias("minus")))


def nick_log_odds(window) -> Column:
    """Log odds of six bases under the degenerate motif against uniform ones."""
    agree = pattern_matches(window, NICK)
    return agree * math.log(NICK_MATCH / 0.25) + (len(NICK) - agree) * math.log(NICK_MISMATCH / 0.25)


def nick_motif(left, right) -> Column:
    """(log_odds, strand) of the better strand, plus on ties; null where it was not evaluated."""
    w = nick_windows(left, right)
    plus, minus = nick_log_odds(w["plus"]), nick_log_odds(w["minus"])
    return F.when(w.isNotNull(), F.struct(F.greatest(plus, minus).alias("log_odds"), F.when(minus > plus, "-").otherwise("+").alias("strand")))


def is_internal(name) -> Column:
    """Whether a library entry is the internal part of an element."""
    return F.trim(_c(name)).rlike(r"(?i)(?:[-_](?:int|i)|_internal)$")


def name_stem(name) -> Column:
    """A library name without the suffix of an internal or terminal part."""
    return F.regexp_replace(F.regexp_replace(F.trim(_c(name)), r"(?i)(?:[-_](?:int|i)|_internal)$", ""), r"(?i)[-_]ltr$", "")


def insert_form(hits: Column, length) -> Column:
    """full, solo, internal or partial from an array of (name, start, end) hits of one family; NA without hits."""
    n = _c(length)
    internal, outer = F.filter(hits, lambda h: is_internal(h["name"])), F.filter(hits, lambda h: ~is_internal(h["name"]))
    at_left, at_right = F.exists(outer, lambda h: h["start"] <= 50), F.exists(outer, lambda h: h["end"] >= n - 50)
    whole = F.exists(outer, lambda h: (h["end"] - h["start"]) >= 0.80 * n)
    return F.when((n <= 0) | (F.size(hits) <= 0), "NA").when(at_left & at_right & (F.size(internal) > 0), "full").when((F.size(internal) == 0) & whole, "solo").when((F.size(internal) > 0) & (F.size(outer) == 0), "internal").otherwise("partial")


def oriented(insert, strand) -> Column:
    """An insert in its element's orientation, upper case."""
    s = F.upper(F.coalesce(_c(insert), F.lit("")))
    return F.when(_c(strand) == "-", seq.reverse_complement(s)).otherwise(s)


def without_copy(insert, copy, mismatches) -> Column:
    """An insert without the second copy of its target site, which stands at its end, or else at its start."""
    s, c = _c(insert), F.upper(F.coalesce(_c(copy), F.lit("")))
    n = F.length(c)
    wrong = lambda part: F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + F.when(F.substring(part, i, F.lit(1)) != F.substring(c, i, F.lit(1)), 1).otherwise(0))
    most = F.greatest(F.lit(0), _c(mismatches))
    return F.when((n == 0) | (F.length(s) <= n), s).when(wrong(F.upper(F.right(s, n))) <= most, F.left(s, F.length(s) - n)).when(wrong(F.upper(F.left(s, n))) <= most, F.substring(s, n + 1, F.length(s))).otherwise(s)


def base_shares(window) -> Column:
    """(a, t) shares of A and T among the A, C, G, T of a window; 0.30 each without any."""
    w = F.upper(F.coalesce(_c(window), F.lit("")))
    count = lambda x: F.length(w) - F.length(F.replace(w, F.lit(x), F.lit("")))
    total = count("A") + count("C") + count("G") + count("T")
    share = lambda x: F.when(total == 0, 0.30).otherwise(count(x) / total)
    return F.struct(share("A").alias("a"), share("T").alias("t"))
