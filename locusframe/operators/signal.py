"""Histograms, smoothing, peaks and position posteriors along a coordinate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..session import workers

#: Un-normalised 5-tap kernel. Fixed values.
TAPS = (0.25, 0.6, 1.0, 0.6, 0.25)


def histogram(df: DataFrame, keys: list[str], pos: str, width: int, weight: str | None = None) -> DataFrame:
    """Dense histogram: every cell between the first and the last of a key, empty ones included."""
    cell = F.floor(F.col(pos) / width).cast("long")
    counts = df.groupBy(*keys, cell.alias("cell")).agg(F.sum(F.col(weight) if weight else F.lit(1.0)).cast("double").alias("mass"))
    span = counts.groupBy(*keys).agg(F.min("cell").alias("_a"), F.max("cell").alias("_b"))
    return span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("cell")).join(counts, [*keys, "cell"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))


def smooth(df: DataFrame, keys: list[str], cell: str = "cell", mass: str = "mass") -> DataFrame:
    """Adds ``smoothed``: the 5-tap kernel over the cells of each key."""
    w = W.partitionBy(*keys).orderBy(cell)
    at = lambda k: F.lag(mass, k, 0.0).over(w) if k > 0 else F.lead(mass, -k, 0.0).over(w) if k else F.col(mass)
    terms = [t * at(k) for t, k in zip(TAPS, (2, 1, 0, -1, -2), strict=True)]
    return df.withColumn("smoothed", sum(terms[1:], terms[0]))


def peaks(df: DataFrame, keys: list[str], floor: float, cell: str = "cell", value: str = "smoothed") -> DataFrame:
    """Cells no lower than both neighbours and at least ``floor``; every cell of a plateau counts."""
    w = W.partitionBy(*keys).orderBy(cell)
    ok = (F.col(value) >= F.col("_l")) & (F.col(value) >= F.col("_r")) & (F.col(value) >= floor)
    return df.withColumns({"_l": F.lag(value, 1, 0.0).over(w), "_r": F.lead(value, 1, 0.0).over(w)}).filter(ok).drop("_l", "_r")


def expand_peaks(df: DataFrame, keys: list[str], peaks_: DataFrame, cell: str = "cell", value: str = "smoothed", share: float = 0.5, least: float = 0.5, reach: int = 15) -> DataFrame:
    """Window of each peak: it grows while cells hold at least max(least, share of the peak), ``reach`` cells each way."""
    w = W.partitionBy(*keys).orderBy(cell)
    around = df.withColumns({"_left": F.reverse(F.collect_list(value).over(w.rowsBetween(-reach, -1))), "_right": F.collect_list(value).over(w.rowsBetween(1, reach))})
    need = F.greatest(F.lit(least), share * F.col(value))

    def run(side: str):
        step = lambda a, x: F.struct((a["open"] & (x >= need)).alias("open"), (a["n"] + F.when(a["open"] & (x >= need), 1).otherwise(0)).alias("n"))
        return F.aggregate(side, F.struct(F.lit(True).alias("open"), F.lit(0).alias("n")), step, lambda a: a["n"])

    chosen = around.join(peaks_.select(*keys, cell), [*keys, cell], "left_semi")
    return chosen.select(*keys, cell, value, (F.col(cell) - run("_left")).alias("first_cell"), (F.col(cell) + run("_right")).alias("last_cell"))


def range_count(df: DataFrame, keys: list[str], pos: str, half: int, counted, name: str = "near") -> DataFrame:
    """Adds the number of counted rows within ``half`` of each row. Rows of one position are counted first."""
    places = df.groupBy(*keys, F.col(pos).alias("_p")).agg(F.count(F.when(counted, 1)).alias("_c"))
    counts = sum_near(places, keys, "_p", half, "_c", name).select(*keys, "_p", name)
    joined = df.withColumn("_p", F.col(pos)).join(counts, [*keys, "_p"], "left")
    return joined.drop("_p").withColumn(name, F.coalesce(name, F.lit(0)))


def sum_near(df: DataFrame, keys: list[str], pos: str, half: int, weight: str, name: str = "near") -> DataFrame:
    """Adds the sum of a whole ``weight`` over the rows within ``half`` of each row, as a difference of running sums.

    A frame with two moving ends is added up anew for every row. Here each
    frame begins with its bucket, so every row is added once. Buckets are wide
    against ``half``, and rows near an edge are in the next one too.
    """
    width = max(1, 8 * half)
    bucket = lambda x: F.floor(x / width).cast("long")
    spread = df.withColumn("_b", F.explode_outer(F.sequence(bucket(F.col(pos) - half), bucket(F.col(pos) + half))))
    w = W.partitionBy(*keys, "_b")
    upto = F.sum(weight).over(w.orderBy(pos).rangeBetween(W.unboundedPreceding, half))
    if isinstance(df.schema[pos].dataType, T.IntegralType):
        near = upto - F.coalesce(F.sum(weight).over(w.orderBy(pos).rangeBetween(W.unboundedPreceding, -half - 1)), F.lit(0))
    else:  # no position is the next one below
        near = upto + F.sum(weight).over(w.orderBy(F.desc(pos)).rangeBetween(W.unboundedPreceding, half)) - F.sum(weight).over(w)
    return spread.withColumn(name, near).filter(F.col("_b").eqNullSafe(bucket(F.col(pos)))).drop("_b")


def position_posterior(signals: DataFrame, keys: list[str], pos: str, sigma: str, pad: int = 20, longest: int = 2000, mass: float = 0.9, entropy: bool = True) -> DataFrame:
    """Posterior of a position from kernels around signals.

    Each signal is a Gaussian of its own ``sigma``; the mixture over a grid of
    whole positions (``pad`` beyond the signals, ``longest`` at most) is
    normalised. Returns keys, ``n_signals``, ``mode``, ``ci_lo``, ``ci_hi`` and,
    where asked for, ``entropy`` relative to a flat posterior; fewer than two
    signals give zeros.

    Equal signals are counted first. The grid is never made into rows: a key's
    signals go to Python as one row, where the bounds are found by bisection.
    """
    workers(signals.sparkSession)
    equal = signals.groupBy(*keys, F.col(pos).cast("long").alias("_p"), F.col(sigma).cast("double").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    one = F.when(F.col("_p").isNotNull() & F.col("_s").isNotNull(), F.struct("_p", "_s", "_n"))
    lists = equal.groupBy(*keys).agg(F.sum("_n").alias("n_signals"), F.min("_p").alias("_a"), F.max("_p").alias("_b"), F.collect_list(one).alias("_x"))
    several = lists.filter("n_signals >= 2 and _a is not null and size(_x) > 0").dropna(subset=keys)
    names = [*keys, "n_signals", "mode", "ci_lo", "ci_hi", *(["entropy"] if entropy else [])]

    def run(batches):
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            x = column["_x"]
            p, s, n = (np.asarray(v) for v in x.flatten().flatten())
            starts = np.asarray(x.offsets) - x.offsets[0].as_py()
            first, last = np.asarray(column["_a"]) - pad, np.asarray(column["_b"]) + pad
            found = posteriors(starts, p, s, n.astype(np.float64), first, np.minimum(last, first + longest), (1 - mass) / 2, entropy)
            yield pa.RecordBatch.from_arrays([*(column[k] for k in (*keys, "n_signals")), *map(pa.array, found)], names)

    schema = T.StructType([*several.select(*keys, "n_signals").schema.fields, *(T.StructField(c, T.DoubleType() if c == "entropy" else T.LongType()) for c in names[len(keys) + 1 :])])
    zero = lists.filter("n_signals < 2").select(*keys, "n_signals", *(F.lit(0.0 if c == "entropy" else 0).cast(schema[c].dataType).alias(c) for c in names[len(keys) + 1 :]))
    return several.mapInArrow(run, schema).unionByName(zero)


#: Signals of a key from which its whole grid is laid out. A kernel is 0 beyond so many sigmas.
DENSE, VANISHED = 64, 39


def posteriors(starts, p, s, n, lo, hi, tail: float, entropy: bool) -> tuple:
    """Mode, bounds and, where asked for, entropy of every key: its signals (place, sigma, number) from ``starts``, its grid from ``lo`` to ``hi``.

    Places are whole, so kernels and their running sums are tabled by offset.
    """
    sizes = np.diff(starts)
    mode, ci_lo, ci_hi, flat = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
    wide = np.ones(len(sizes), bool) if entropy else sizes > DENSE
    for g in np.flatnonzero(wide):
        own = slice(starts[g], starts[g + 1])
        h = _grid(p[own], s[own], n[own], lo[g], hi[g])
        q = h / h.sum()
        cum = np.cumsum(q)
        at = q[q > 0]
        mode[g] = lo[g] + np.argmax(np.rint(q * 1e12))
        ci_lo[g], ci_hi[g] = (lo[g] + min(np.searchsorted(cum, v), len(q) - 1) for v in (tail, 1 - tail))
        flat[g] = -(at * np.log(at)).sum() / np.log(len(q)) if len(q) > 1 else np.nan
    if not wide.all():
        few = np.flatnonzero(~wide)
        keep = np.repeat(~wide, sizes)
        mode[few], ci_lo[few], ci_hi[few] = _few(sizes[few], p[keep], s[keep], n[keep], lo[few], hi[few], tail)
    return (mode, ci_lo, ci_hi, flat) if entropy else (mode, ci_lo, ci_hi)


def _grid(p, s, n, lo, hi):
    """The mixture at every place from ``lo`` to ``hi``."""
    h = np.zeros(hi - lo + 1)
    for sigma in np.unique(s):
        reach = int(min(np.ceil(VANISHED * sigma), max(p.max() - lo, hi - lo)))
        own = (s == sigma) & (p <= hi + reach)
        counts = np.bincount(p[own] - lo + reach, n[own], len(h) + 2 * reach)
        z = np.arange(-reach, reach + 1) / sigma
        kernel = np.exp(-z * z / 2) / sigma
        at = np.flatnonzero(counts)
        if len(at) * 8 > len(h):
            h += np.convolve(counts, kernel, "valid")
            continue
        for i in at:  # counts[i] lies at place i - reach of the grid
            a, b = max(0, i - 2 * reach), min(len(h), i + 1)
            h[a:b] += counts[i] * kernel[a - i + 2 * reach : b - i + 2 * reach]
    return h


def _few(sizes, p, s, n, lo, hi, tail: float):
    """Mode and bounds of keys with few signals, all keys at once."""
    starts = np.concatenate(([0], np.cumsum(sizes)))
    of = np.repeat(np.arange(len(sizes)), sizes)
    sigmas, which = np.unique(s, return_inverse=True)
    reach = np.minimum(np.ceil(VANISHED * sigmas), max((hi - lo).max(), (p - lo[of]).max())).astype(np.int64)
    tables, zeros, at = [], [], 0
    for sigma, r in zip(sigmas, reach, strict=True):
        z = np.arange(-r, r + 1) / sigma
        tables.append(np.concatenate(([0.0], np.exp(-z * z / 2) / sigma)))
        zeros.append(at + r + 1)
        at += 2 * r + 2
    kernel, summed = np.concatenate(tables), np.concatenate([np.cumsum(t) for t in tables])
    zero, far = np.array(zeros)[which], reach[which]
    before = summed[zero + np.clip(lo[of] - 1 - p, -far - 1, far)]
    heads = starts[:-1]

    def mass(x):
        return np.add.reduceat(n * (summed[zero + np.clip(x[of] - p, -far - 1, far)] - before), heads)

    whole = mass(hi)

    def first(share):
        a, b = lo.copy(), hi.copy()
        while (a < b).any():
            middle = (a + b) // 2
            enough = mass(middle) / whole >= share
            a, b = np.where(enough | (a >= b), a, middle + 1), np.where(enough, middle, b)
        return a

    # At the mode the mixture reaches the highest kernel alone, so one of the kernels gives its share of that:
    # the mode lies near its centre. The factor leaves room for ties after rounding.
    weight = n / s
    top = np.maximum.reduceat(np.where(p <= hi[of], weight, 0.0), heads)
    ratio = sizes[of] * weight / top[of] * (1 + 1e-6)
    radius = np.where(ratio >= 1, np.floor(s * np.sqrt(2 * np.log(np.maximum(ratio, 1))) + 1e-9), -1).astype(np.int64)
    left, right = np.maximum(lo[of], p - radius), np.minimum(hi[of], p + radius)
    counts = np.maximum(right - left + 1, 0)
    x = np.repeat(left, counts) + _inside(counts)
    key = np.repeat(of, counts)
    terms = sizes[key]
    j = np.repeat(heads[key], terms) + _inside(terms)
    heights = np.add.reduceat(n[j] * kernel[zero[j] + np.clip(np.repeat(x, terms) - p[j], -far[j] - 1, far[j])], np.concatenate(([0], np.cumsum(terms)[:-1])))
    level = np.rint(heights / whole[key] * 1e12)
    edges = np.concatenate(([0], np.cumsum(np.add.reduceat(counts, heads))[:-1]))
    best = np.maximum.reduceat(level, edges)
    mode = np.minimum.reduceat(np.where(level == best[key], x, np.iinfo(np.int64).max), edges)
    return mode, first(tail), first(1 - tail)


def _inside(counts):
    """0, 1, ... within each of the runs of these lengths."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def shift_controls(df: DataFrame, pos: str, low: str, high: str, step: int, most: int) -> DataFrame:
    """Control positions at -step, +step, -2 step, ... inside [low, high], ``most`` at most: adds ``k`` and ``control``."""
    offsets = F.array(*(F.lit(s * k * step) for k in range(1, most + 1) for s in (-1, 1)))
    inside = F.filter(F.transform(offsets, lambda o: F.col(pos) + o), lambda c: (c >= F.col(low)) & (c <= F.col(high)))
    return df.select("*", F.posexplode(F.slice(inside, 1, most)).alias("k", "control"))
