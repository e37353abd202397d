"""Arrow UDFs for what the built-ins cannot say: masks, banded searches, target-site duplications."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.upper().encode("ascii", "replace"), np.uint8)


def tandem_mask(s: str, longest: int = 12, least: int = 0, copies: int = 0) -> np.ndarray:
    """Bases under an exact repeat of some period: a run that agrees with itself one period on for at least a period."""
    x = _codes(s)
    mask = np.zeros(len(x), bool)
    for period in range(1, min(longest, len(x) // 2) + 1):
        same = np.append(x[period:] == x[:-period], False)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2]):
            size = b - a + period
            if b - a >= period and size >= least and size >= copies * period:
                mask[a : a + size] = True
    return mask


def low_complexity_mask(s: str, window: int = 16, share: float = 0.9) -> np.ndarray:
    """Bases in a window of which two letters make up at least ``share``."""
    x = _codes(s)
    mask = np.zeros(len(x), bool)
    if len(x) < window:
        return mask
    sums = np.stack([np.concatenate([[0], np.cumsum(x == ord(c))]) for c in "ACGT"])
    counts = np.sort(sums[:, window:] - sums[:, :-window], axis=0)
    for i in np.flatnonzero(counts[-2:].sum(0) >= share * window):
        mask[i : i + window] = True
    return mask


@F.pandas_udf(T.DoubleType())
def tandem_fraction(s: pd.Series) -> pd.Series:
    """Share of a sequence under tandem repeats of period 1 to 12."""
    return s.map(lambda x: float(tandem_mask(x).mean()) if x else 0.0)


@F.pandas_udf(T.DoubleType())
def microsatellite_fraction(s: pd.Series) -> pd.Series:
    """Share under repeats of period up to 6, of 12 bases and 3 copies at least."""
    return s.map(lambda x: float(tandem_mask(x, 6, 12, 3).mean()) if x else 0.0)


@F.pandas_udf(T.DoubleType())
def simple_repeat_fraction(s: pd.Series) -> pd.Series:
    """Share under microsatellites or windows of two letters."""
    return s.map(lambda x: float((tandem_mask(x, 6, 12, 3) | low_complexity_mask(x)).mean()) if x else 0.0)


def semiglobal_distance(query: str, target: str) -> int:
    """Edits to place the whole query somewhere in the target; ends of the target are free."""
    q, t = _codes(query), _codes(target)
    row = np.zeros(len(t) + 1, np.int64)
    span = np.arange(len(t) + 1)
    for i, c in enumerate(q, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (t != c))
        now = np.concatenate([[i], step])
        row = np.minimum.accumulate(now - span) + span  # deletions along the target
    return int(row.min())


@F.pandas_udf(T.DoubleType())
def semiglobal_identity(query: pd.Series, target: pd.Series) -> pd.Series:
    """1 - edits / length of the query, 0 at least."""
    return pd.Series([max(0.0, 1 - semiglobal_distance(q, t) / len(q)) if q and t is not None else 0.0 for q, t in zip(query, target, strict=True)])


def mismatch_budget(length: int, rate: float = 0.1, cap: int = 2) -> int:
    """Mismatches that a duplication of some length may have."""
    return min(cap, int(length * rate))


def find_duplication(left: str, right: str, least: int = 4, most: int = 50) -> tuple[int, int]:
    """(length, mismatches) of the longest suffix of the left flank that the right flank begins with; exact ones first, (0, 0) for none."""
    x, y = _codes(left), _codes(right)
    top = min(most, len(x), len(y))
    for tolerant in (False, True):
        for n in range(top, least - 1, -1):
            wrong = int((x[len(x) - n :] != y[:n]).sum())
            if wrong <= (mismatch_budget(n) if tolerant else 0):
                return n, wrong
    return 0, 0


def occurrence_fraction(motif: str, background: str, budget: int) -> float:
    """Share of a background's positions at which a motif stands within a budget of mismatches; 1 if it cannot be asked."""
    m, b = _codes(motif), _codes(background)
    n = len(b) - len(m) + 1
    if not len(m) or n <= 0:
        return 1.0
    windows = np.lib.stride_tricks.sliding_window_view(b, len(m))
    return float(((windows != m).sum(1) <= budget).mean())


DUPLICATION = T.StructType().add("length", T.IntegerType()).add("mismatches", T.IntegerType()).add("sequence", T.StringType()).add("null_fraction", T.DoubleType())


@F.pandas_udf(DUPLICATION)
def target_site_duplication(left: pd.Series, right: pd.Series, background: pd.Series) -> pd.DataFrame:
    """The duplication between two flanks, and how often its sequence occurs around by chance."""
    rows = []
    for l, r, b in zip(left.fillna(""), right.fillna(""), background.fillna(""), strict=True):
        n, wrong = find_duplication(l, r)
        motif = l[len(l) - n :] if n else ""
        rows.append((n, wrong, motif, occurrence_fraction(motif, b, mismatch_budget(n)) if n else 1.0))
    return pd.DataFrame(rows, columns=["length", "mismatches", "sequence", "null_fraction"])


# Fixed values of the search for duplications: lengths, flank of the background, its limit, and the mismatch allowance.
TSD_LEAST, TSD_MOST, TSD_FLANK, TSD_COMMON, TSD_RATE, TSD_CAP = 3, 50, 150, 0.05, 0.10, 2


def _plain_run(codes: np.ndarray) -> int:
    """Letters A, C, G, T from the start on."""
    other = np.flatnonzero(~np.isin(codes, np.frombuffer(b"ACGT", np.uint8)))
    return int(other[0]) if len(other) else len(codes)


def _longest(forms: list[tuple[int, np.ndarray]], least: int, rate: float, cap: int) -> tuple[int, int, int, int] | None:
    """(form, length, mismatches, budget) of the longest agreement: exact ones first, then within the budget; the first form wins ties.

    A form is its usable length and the mismatches of its first n pairs, for every n.
    """
    for tolerant in (False, True):
        for n in range(max((usable for usable, _ in forms), default=0), least - 1, -1):
            budget = mismatch_budget(n, rate, cap) if tolerant else 0
            if tolerant and not budget:
                continue
            for form, (usable, wrong) in enumerate(forms):
                if n <= usable and wrong[n] <= budget:
                    return form, n, int(wrong[n]), budget
    return None


def detect_duplication(reference: str, base: int, left: int, right: int, insert: str, least: int = TSD_LEAST, most: int = TSD_MOST, flank: int = TSD_FLANK, common: float = TSD_COMMON, rate: float = TSD_RATE, cap: int = TSD_CAP) -> tuple[str, int, int, str, float]:
    """(kind, length, mismatches, sequence, background share) at a breakpoint; ``reference`` begins at position ``base``.

    Two breakpoints leave a duplication where the flanks repeat, or a deletion
    where reference bases are missing between them. One position leaves the second
    copy in the insert, at its end (which wins ties) or its start. A duplication
    that is common around, under the budget that it was accepted with, is UNCERTAIN.
    """
    nothing = ("NONE", 0, 0, "", 1.0)
    left, right = max(0, left), max(0, right)
    text = reference.upper()
    cut = lambda a, b: text[max(0, a - base) : max(0, b - base)]
    up, down = _codes(cut(max(0, left - most), left)), _codes(cut(right, right + most))

    def named(kind: str, sequence: str, wrong: int, budget: int) -> tuple[str, int, int, str, float]:
        share = occurrence_fraction(sequence, cut(max(0, left - flank), right + flank), budget)
        return (kind if share <= common else "UNCERTAIN", len(sequence), wrong, sequence, share)

    if left == right:
        if not insert:
            return nothing
        own, forms = _codes(insert), []
        for a, b in ((own[::-1], up[::-1]), (own, down)):
            n = min(len(a), len(b), most)
            usable = min(n, _plain_run(a[:n]), _plain_run(b[:n]))
            forms.append((usable, np.concatenate([[0], np.cumsum(a[:n] != b[:n])])))
        if (found := _longest(forms, least, rate, cap)) is None:
            return nothing
        form, n, wrong, budget = found
        return named("DUP", cut(left - n, left) if form == 0 else cut(right, right + n), wrong, budget)

    usable = min(len(up), len(down), left, _plain_run(up[::-1]), _plain_run(down))
    wrong = np.array([0] + [int((up[len(up) - n :] != down[:n]).sum()) for n in range(1, usable + 1)])
    if found := _longest([(usable, wrong)], least, rate, cap):
        return named("DUP", cut(left - found[1], left), found[2], found[3])
    lost = cut(left, right)
    if least <= right - left <= most and len(lost) == right - left and _plain_run(_codes(lost)) == len(lost):
        return named("DEL", lost, 0, 0)
    return nothing


def repeat_share(window: str, start: int, end: int) -> float:
    """Share of a slice of a window under microsatellites of the window."""
    lo, hi = max(0, start), min(len(window), end)
    return float(tandem_mask(window, 6, 12, 3)[lo:hi].mean()) if hi > lo else 0.0


_PLACE = T.StructType().add("shift", T.LongType()).add("length", T.IntegerType()).add("mismatches", T.IntegerType()).add("sequence", T.StringType()).add("repeat_share", T.DoubleType()).add("chance", T.DoubleType())


@F.pandas_udf(T.ArrayType(_PLACE))
def duplications(reference: pd.Series, base: pd.Series, left: pd.Series, right: pd.Series, insert: pd.Series, shifts: pd.Series) -> pd.Series:
    """Duplications at a breakpoint and at its shifts, each with the chance of one as long at the other shifts.

    The first of ``shifts`` is the place itself (0). ``chance`` is (1 + hits) / (1 + n),
    never less than n shifts can certify; -1 without a duplication or other shifts.
    """
    out = []
    for text, b, l, r, ins, offsets in zip(reference.fillna(""), base, left, right, insert.fillna(""), shifts, strict=True):
        rows = []
        for s in offsets:
            kind, n, wrong, sequence, _ = detect_duplication(text, int(b), int(l + s), int(r + s), ins)
            n, wrong, sequence = (n, wrong, sequence) if kind in ("DUP", "UNCERTAIN") else (0, 0, "")
            lo, hi = max(0, int(min(l, r) + s) - 100), int(max(l, r) + s) + 100
            window = text[max(0, lo - int(b)) : max(0, hi - int(b))]
            at = int(min(l, r) + s) - lo
            share = repeat_share(window, at - n, max(at, int(max(l, r) + s) - lo) + n) if n else 0.0
            rows.append([int(s), n, wrong, sequence, share])
        lengths = np.array([row[1] for row in rows[1:]])
        done = []
        for i, row in enumerate(rows):
            others = np.delete(lengths, i - 1) if i else lengths
            chance = float((1 + (others >= row[1]).sum()) / (1 + len(others))) if row[1] > 0 and len(others) else -1.0
            done.append(dict(zip(("shift", "length", "mismatches", "sequence", "repeat_share", "chance"), [*row, chance], strict=True)))
        out.append(done)
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def repeat_share_of(window: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    """``repeat_share`` of columns."""
    return pd.Series([repeat_share((w or "").upper(), int(a), int(b)) for w, a, b in zip(window, start, end, strict=True)])
