"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is
parsed against every automaton by greedy longest match: the longest stretch
that occurs in the language's text is one phrase, then the next begins. A
phrase is told by its place in the sample, log2 of the sample's length in bits,
so phrases times that, by the text's length, estimate the text's entropy under
the language (bits a character). The language of the lowest entropy wins; equal
ones go to the alphabetically first.

Any code point is a symbol and every label is learned. An automaton's
transitions on its own most frequent symbols are a dense table, those on the
rest a sorted list, so large alphabets match like small ones.

Texts are parsed in lockstep: one step moves the state of every stretch of a
batch. A text is cut into stretches of ``STRETCH`` characters that are parsed
at once and then joined: the parse that comes in from the stretch before is
followed until it opens a phrase where the stretch's own parse does, from where
both agree. The result is the parse of the whole text.

The labelled text is a sample: whole documents in the order of a hash of their
id, ``CHARS`` characters a language at most (less beyond ``TOTAL`` in all); a
label whose documents are all longer is learned from the beginnings of some.
Predictions see the text alone. Null texts and texts without a letter are
``und`` with score 0; without any labelled text everything is ``und``. Texts in
no learned language get the nearest one, and an entropy by which to reject them.
Repeated rows each get a result; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import learnable, prepare
from .text import row_blocks

#: Characters of labelled text a language at most; an automaton has up to twice as many states.
CHARS = 24_000
#: Characters of labelled text in all; with more languages than this holds, each has less.
TOTAL = 4_800_000
#: Characters parsed on their own before they are joined.
STRETCH = 512
#: Stretches in lockstep.
WIDTH = 8192
#: Characters that are parsed together.
PORTION = 1 << 21
#: Columns of a dense table: 0 is unknown, the last is a symbol that the sorted list has.
COLUMNS = 256
_POINTS = 0x110000


def _codes(text: str) -> np.ndarray:
    """Code points of the folded text; non-letters are 0, and one of each run of them stays."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, 0)
    keep = points > 0
    keep[1:] |= points[:-1] > 0
    return points[keep]


_letter_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    """True at the code points of letters."""
    global _letter_table
    if _letter_table is None:
        _letter_table = np.fromiter((chr(i).isalpha() for i in range(_POINTS)), bool, _POINTS)
    return _letter_table


def letters(text: str | None) -> int:
    """Letters of a text."""
    return int((_codes(text) > 0).sum()) if text else 0


def suffix_automaton(sequence: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the start and nothing leads back to it."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sequence:
        fresh = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = fresh
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[fresh] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[fresh] = copy
        last = fresh
    return step


class Automaton:
    """Transitions of one language: a dense table for frequent symbols, a sorted list for the rest. State 0 is the start and the lack of a way."""

    def __init__(self, sample: np.ndarray, points: np.ndarray):
        """``sample``: symbols, numbered from 1 in the order of ``points``."""
        steps = suffix_automaton(sample.tolist())
        count = np.bincount(sample, minlength=len(points) + 1)
        often = np.sort(np.argsort(-count[1:], kind="stable")[: COLUMNS - 2] + 1) if len(points) > COLUMNS - 2 else np.arange(1, len(points) + 1)
        often = often[count[often] > 0]
        self.column = np.where(count > 0, COLUMNS - 1, 0).astype(np.uint8)
        self.column[often] = np.arange(1, len(often) + 1)
        self.rare = bool((self.column == COLUMNS - 1).any())
        self.width = COLUMNS if self.rare else len(often) + 1
        self.symbols, self.bits = len(count), float(np.log2(max(2, len(sample))))
        table = np.zeros((len(steps), self.width), np.uint16 if len(steps) < 1 << 16 else np.int32)
        keys, ways = [], []
        for state, out in enumerate(steps):
            for symbol, to in out.items():
                if (at := self.column[symbol]) < COLUMNS - 1:
                    table[state, at] = to
                else:
                    keys.append(state * self.symbols + symbol)
                    ways.append(to)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ways = np.array(keys, np.int64)[order], np.array(ways, np.int64)[order]
        self.flat = table.ravel()

    def step(self, state: np.ndarray, symbol: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Where each state leads by its symbol; 0 where there is no way."""
        after = self.flat[state * self.width + column].astype(np.int64)
        if self.rare and len(some := np.flatnonzero(column == COLUMNS - 1)):
            key = state[some] * self.symbols + symbol[some]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            after[some] = np.where(self.keys[at] == key, self.ways[at], 0)
        return after

    def parse(self, rows: np.ndarray, lengths: np.ndarray, follows: np.ndarray, enter: int = 0) -> tuple[np.ndarray, int]:
        """Phrases opened in each stretch by the parse of its whole text, the first phrase of a text not counted, and the last state.

        ``rows``: symbols of the stretches; ``follows``: whether a stretch goes on
        with the text of the one before; ``enter``: the state before the first, if it
        goes on with a text.
        """
        live = np.argsort(-lengths, kind="stable")
        opens = np.zeros(rows.shape, bool)
        last = np.zeros(len(rows), np.int64)
        self._run(rows, lengths, live, np.zeros(len(rows), np.int64), opens, last)
        count = opens.sum(1)
        # The parse that comes in ends as the stretch's own does, unless the two never meet; then the next is followed again.
        after, todo = last.copy(), np.flatnonzero(follows)
        own = np.cumsum(opens, 1, dtype=np.int32)
        while len(todo):
            count[todo], end = self._follow(rows, lengths, todo, np.where(todo > 0, after[todo - 1], enter), opens, own, last)
            moved = end != after[todo]
            after[todo] = end
            todo = todo[moved] + 1
            todo = todo[todo < len(rows)]
            todo = todo[follows[todo]]
        return count, int(after[-1])

    def _run(self, rows: np.ndarray, lengths: np.ndarray, live: np.ndarray, state: np.ndarray, opens: np.ndarray, last: np.ndarray) -> None:
        """Parse all stretches from ``state``, in the order ``live`` (longest first): marks where phrases open, and the last states."""
        sorted_rows = rows[live]
        steps, columns = np.ascontiguousarray(sorted_rows.T), np.ascontiguousarray(self.column[sorted_rows].T)
        alive = np.searchsorted(-lengths[live], -np.arange(rows.shape[1]), "left")
        state = state[live]
        root = self.step(np.zeros(self.symbols, np.int64), np.arange(self.symbols), self.column)
        for at in range(rows.shape[1]):
            if not (n := alive[at]):
                break
            after = self.step(state[:n], steps[at, :n], columns[at, :n])
            miss = np.flatnonzero(after == 0)
            if len(miss):
                after[miss] = root[steps[at, miss]]
                opens[live[miss], at] = True
            state[:n] = after
        last[live] = state

    def _follow(self, rows: np.ndarray, lengths: np.ndarray, todo: np.ndarray, state: np.ndarray, opens: np.ndarray, own: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases opened in the stretches ``todo`` entered in ``state``, and the states at their ends."""
        fresh, end, own_total = np.zeros(len(todo), np.int64), state.copy(), own[todo, -1]
        open_ = np.arange(len(todo))  # those that have not met their own parse
        at = 0
        while len(open_):
            row = todo[open_]
            done = lengths[row] <= at
            if done.any():
                end[open_[done]] = state[done]
                open_, state, row = open_[~done], state[~done], row[~done]
                if not len(open_):
                    break
            symbol = rows[row, at]
            column = self.column[symbol]
            after = self.step(state, symbol, column)
            miss = after == 0
            if miss.any():
                after[miss] = self.step(np.zeros(int(miss.sum()), np.int64), symbol[miss], column[miss])
                fresh[open_[miss]] += 1
                met = miss & (opens[row, at] | (at == 0))
                if met.any():
                    which = open_[met]
                    fresh[which] += own_total[which] - own[row[met], at]
                    end[which] = last[row[met]]
                    open_, after = open_[~met], after[~met]
            state = after
            at += 1
        return fresh, end


class Model:
    """Automata of the languages."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        flat = {lang: np.concatenate([np.append(_codes(t), 0) for t in texts]) for lang, texts in samples.items()}
        self.points = np.unique(np.concatenate([*flat.values(), np.zeros(1, np.uint32)]))
        self.automata = [Automaton(self.symbols(flat[lang]), self.points) for lang in self.languages]

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Numbers from 1 of the code points that some language has; 0 for the rest."""
        at = np.minimum(np.searchsorted(self.points, codes), len(self.points) - 1)
        return np.where(self.points[at] == codes, at + 1, 0).astype(np.int32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
        """Language, score and entropy of each text, in portions of about ``PORTION`` characters.

        The score is 1 less the lowest entropy by the second lowest; the entropy is
        null where there is no letter or no language.
        """
        lang: list[str] = []
        score: list[float] = []
        bits: list[float | None] = []
        size = np.append(0, np.cumsum([len(t) if t else 0 for t in texts])).astype(np.int64)
        for start, end in row_blocks(size, PORTION):
            some = self._predict(texts[start:end])
            lang += some[0]
            score += some[1]
            bits += some[2]
        return lang, score, bits

    def phrases(self, symbols: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text in each language."""
        size = np.array([len(s) for s in symbols], np.int64)
        total = np.zeros((len(self.automata), len(symbols)), np.int64) + (size > 0)
        if not size.sum():
            return total
        flat = np.append(np.concatenate(symbols), np.zeros(STRETCH, np.int32))
        ends = np.cumsum(size)
        pieces = -(-size // STRETCH)
        owner = np.repeat(np.arange(len(symbols)), pieces)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (ends - size)[owner] + place * STRETCH
        length = np.minimum(STRETCH, ends[owner] - start)
        states = [0] * len(self.automata)
        for at in range(0, len(owner), WIDTH):
            some = slice(at, at + WIDTH)
            rows = flat[start[some, None] + np.arange(int(length[some].max()))]
            for lang, automaton in enumerate(self.automata):
                opened, states[lang] = automaton.parse(rows, length[some], place[some] > 0, states[lang])
                np.add.at(total[lang], owner[some], opened)
        return total

    def _predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
        codes = [_codes(t) if t else np.zeros(0, np.uint32) for t in texts]
        size = np.array([len(c) for c in codes], np.int64)
        letters = np.array([bool((c > 0).any()) for c in codes], bool)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
        cost = self.phrases([self.symbols(c) for c in codes]) * np.array([[a.bits] for a in self.automata])
        best = cost.argmin(0)
        ranked = np.sort(cost, 0)
        second = ranked[1] if len(self.languages) > 1 else size * self.automata[0].bits
        score = np.where(letters & (second > 0), np.clip(1 - ranked[0] / np.maximum(second, 1e-9), 0, 1), 0.0)
        bits = ranked[0] / np.maximum(size, 1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], score.tolist(), [float(b) if ok else None for b, ok in zip(bits, letters, strict=True)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chars: int = CHARS) -> Model:
    """A model of at most ``chars`` characters a language, from rows that may be learned from.

    Of the table, one row a label and the samples come to the driver. Documents
    of up to ``chars`` characters are chosen; a label without any gives the first
    ``chars`` characters of some longer ones.
    """
    size = F.length(text_col)
    rows = docs.filter(learnable(F.col(id_col)) & F.col(lang_col).isNotNull() & (size > 0))
    counts = rows.groupBy(lang_col).agg(
        F.count(F.lit(1)).alias("all"), F.count(F.when(size <= chars, 1)).alias("n"), F.sum(F.when(size <= chars, size)).alias("size"),
    ).collect()
    chars = min(chars, max(256, TOTAL // max(1, len(counts))))
    order = F.md5(F.concat(F.lit("lang:"), F.col(id_col).cast("string")).cast("binary"))
    place = F.conv(F.substring(order, 1, 8), 16, 10).cast("double")
    # A share of each language that holds about four times the characters wanted.
    shares = [(r[lang_col], r["n"] > 0, (min(1.0, 4 * chars / max(1, r["size"]) + 40 / r["n"]) if r["n"] else min(1.0, 40 / r["all"])) * 2.0**32) for r in counts]
    wanted = docs.sparkSession.createDataFrame(shares, "_lang string, _short boolean, _below double")
    picked = rows.join(F.broadcast(wanted), F.col(lang_col) == F.col("_lang")).filter((place < F.col("_below")) & (~F.col("_short") | (size <= CHARS)))
    samples: dict[str, list[str]] = {}
    left: dict[str, int] = {}
    for row in picked.select(F.col("_lang").alias("lang"), "_short", F.substring(text_col, 1, CHARS).alias("text"), order.alias("h")).orderBy("h", "text").toLocalIterator():
        room = left.setdefault(row["lang"], chars)
        if len(row["text"]) <= room or row["lang"] not in samples:
            samples.setdefault(row["lang"], []).append(row["text"][:room])
            left[row["lang"]] = room - len(row["text"][:room])
    return Model(samples)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per row: id, lang_pred, score, entropy; with ``keep`` all columns and the three behind them (underscores appended where the names are taken)."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    where = docs.columns.index(text_col) if keep else 1
    source = docs if keep else docs.select(id_col, text_col)
    names = ["lang_pred", "score", "entropy"]
    while keep and set(names) & set(docs.columns):
        names = [f"{name}_" for name in names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if keep or f.name == id_col] + [f"{names[0]} string", f"{names[1]} double", f"{names[2]} double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, 2048)
                lang, score, bits = judge.predict(part.column(where).to_pylist())
                columns = list(part.columns) if keep else [part.column(0)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], [*(part.schema.names if keep else [id_col]), *names])
                start += 2048

    return source.mapInArrow(run, schema)
