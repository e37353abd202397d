"""Benchmark decontamination by greedy string tiling.

Texts and items are token sequences (runs of letters and digits, A-Z folded).
Documents meet items through shared runs of ``k`` tokens (seeds). For each
meeting, greedy string tiling marks the longest common stretches first, never
marking a token twice and never a stretch under ``k`` tokens; stretches are
found by running Karp-Rabin hashes, whose length is halved until it is ``k``,
and what a longer stretch leaves of another goes back in its place by length.
Of equal stretches the first in the item, then in the text, is marked. The
share of the item's tokens under tiles is its coverage, so a passage whose
parts were reordered is still covered.

Items with fewer than ``k`` tokens are no evidence and never match; null and
empty texts match nothing; without items or documents nothing is found. Items
with equal ids are tested one by one and the best counts. Repeated documents,
and documents of one id with different texts, each get rows of their own.
Columns other than those named are ignored; texts are compared whole.

Work for a document and an item grows with the pairs of equal stretches between
them, which only repeated tokens make many. The seeds of the items are broadcast
in slices of ``SLICE_WORDS`` tokens at most, which pass the driver one by one; a
larger benchmark takes one more pass over the documents for each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import filter_batches, prepare
from .text import NOT_ALNUM, row_blocks, shingles, utf8, words

#: Tokens of benchmark items that are broadcast at once (at 8 bytes for the token and 24 for its seed).
SLICE_WORDS = 1_000_000
#: Pairs of equal stretches that are prolonged at once.
PAIRS = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Running:
    """Karp-Rabin hashes of all stretches of one length of a token sequence."""

    def __init__(self, tokens: np.ndarray):
        self.sums = np.append(_U(0), np.cumsum(tokens * _powers(_BASE, len(tokens)), dtype=_U))
        self.back = _powers(_INVERSE, len(tokens) + 1)

    def of(self, s: int) -> np.ndarray:
        n = len(self.sums) - s
        return (self.sums[s:] - self.sums[:n]) * self.back[:n] if n > 0 else np.zeros(0, _U)

    def at(self, places: np.ndarray, s: int) -> np.ndarray:
        """Hashes of the stretches of ``s`` tokens at some places."""
        return (self.sums[places + s] - self.sums[places]) * self.back[places]


def tile(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of the tiles, longest first; of equal ones the first in the item, then in the text."""
    tiles: list[tuple[int, int, int]] = []
    if min(len(item), len(text)) < least:
        return tiles
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    by_item, by_text = Running(item), Running(text)
    s = min(len(item), len(text))
    while True:
        queue = _stretches(item, text, free_item, free_text, by_item, by_text, s)
        heapq.heapify(queue)
        while queue:
            n, i, j = heapq.heappop(queue)
            n = -n
            free = free_item[i : i + n] & free_text[j : j + n]
            if free.all():
                free_item[i : i + n] = free_text[j : j + n] = False
                tiles.append((i, j, n))
                continue
            # What longer stretches have left of this one goes back, in its place by length.
            edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
            for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if end - start >= s:
                    heapq.heappush(queue, (start - end, i + start, j + start))
        if s == least or not free_item.any():
            return tiles
        s = max(least, s // 2)


def _runs(free: np.ndarray) -> np.ndarray:
    """Free tokens from each place on."""
    taken = np.append(np.flatnonzero(~free), len(free))
    return taken[np.searchsorted(taken, np.arange(len(free)))] - np.arange(len(free))


def _stretches(item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, by_item: Running, by_text: Running, s: int) -> list[tuple[int, int, int]]:
    """(-length, start in item, start in text) of the longest common stretches of free tokens, ``s`` tokens or more each."""
    room_item, room_text = _runs(free_item), _runs(free_text)
    left, right = np.flatnonzero(room_item >= s), np.flatnonzero(room_text >= s)
    if not len(left) or not len(right):
        return []
    a, b = by_item.of(s)[left], by_text.of(s)[right]
    order = np.argsort(a, kind="stable")
    left, a = left[order], a[order]
    lo, hi = np.searchsorted(a, b, "left"), np.searchsorted(a, b, "right")
    some = np.flatnonzero(hi > lo)
    many = np.append(0, np.cumsum((hi - lo)[some]))
    found: list[tuple[int, int, int]] = []
    for first, end in row_blocks(many, PAIRS):
        row = np.repeat(some[first:end], np.diff(many[first : end + 1]))
        place = np.arange(len(row)) - np.repeat(many[first:end] - many[first], np.diff(many[first : end + 1]))
        i, j = left[lo[row] + place], right[row]
        # One that the token before prolongs is part of a longer one.
        before = (i > 0) & (j > 0)
        before[before] = free_item[i[before] - 1] & free_text[j[before] - 1] & (item[i[before] - 1] == text[j[before] - 1])
        i, j = i[~before], j[~before]
        n, most = np.zeros(len(i), np.int64), np.minimum(room_item[i], room_text[j])
        step = 1 << max(0, int(most.max(initial=1)).bit_length() - 1)
        while step:
            ok = np.flatnonzero(n + step <= most)
            same = ok[by_item.at(i[ok] + n[ok], step) == by_text.at(j[ok] + n[ok], step)]
            n[same] += step
            step >>= 1
        keep = n >= s
        found += [(-n_, i_, j_) for n_, i_, j_ in zip(n[keep].tolist(), i[keep].tolist(), j[keep].tolist(), strict=True) if (item[i_ : i_ + n_] == text[j_ : j_ + n_]).all()]
    return found


@dataclass
class Items:
    """Tokens of the items of a slice, and their seeds in hash order."""

    ids: list
    tokens: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray

    def __post_init__(self):
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.seeds >> _U(42)).astype(np.int64)] = True


def _items(ids: list, texts: pa.Array, k: int) -> Items:
    data, offsets = utf8(texts)
    hashes, _, _, at = words(data, offsets, NOT_ALNUM)
    tokens = [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    seeds = [shingles(t, k) for t in tokens]
    flat = np.concatenate([*seeds, np.zeros(0, _U)])
    item = np.repeat(np.arange(len(tokens)), [len(s) for s in seeds])
    place = np.concatenate([*(np.arange(len(s)) for s in seeds), np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(flat, kind="stable")
    return Items(ids, tokens, flat[order], item[order], place[order])


def _matches(items: Items, column: pa.Array, k: int, coverage: float) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
    """(row, item, covered tokens, tiles with word positions) of every item that a row covers enough."""
    data, offsets = utf8(column)
    for start, end in row_blocks(offsets):
        low = offsets[start]
        hashes, _, _, at = words(data[low : offsets[end]], offsets[start : end + 1] - low, NOT_ALNUM)
        runs = shingles(hashes, k)
        some = np.flatnonzero(items.maybe[(runs >> _U(42)).astype(np.int64)])
        lo = np.searchsorted(items.seeds, runs[some], "left")
        hi = np.searchsorted(items.seeds, runs[some], "right")
        row = np.searchsorted(at, some, "right") - 1
        good = (hi > lo) & (some + k <= at[row + 1])
        some, lo, hi, row = some[good], lo[good], hi[good], row[good]
        meets: dict[tuple[int, int], list] = {}
        for word, a, b, r in zip(some.tolist(), lo.tolist(), hi.tolist(), row.tolist(), strict=True):
            for e in range(a, b):
                meets.setdefault((r, int(items.item[e])), []).append((word, int(items.place[e])))
        for (r, i), seeds in meets.items():
            item = items.tokens[i]
            under = np.zeros(len(item) + 1, np.int64)
            for p in {p for _, p in seeds}:
                under[p] += 1
                under[min(p + k, len(item))] -= 1
            if (np.cumsum(under)[:-1] > 0).sum() < coverage * len(item):
                continue  # seeds cover less, so tiles do
            # Only tokens within an item's length of a seed can lie under a tile.
            near = np.zeros(at[r + 1] - at[r] + 1, np.int64)
            for w, _ in seeds:
                near[max(0, w - at[r] - len(item))] += 1
                near[min(len(near) - 1, w - at[r] + len(item))] -= 1
            kept = np.flatnonzero(np.cumsum(near)[:-1] > 0)
            text = hashes[at[r] + kept]
            gaps = np.flatnonzero(np.diff(kept) > 1) + 1
            text = np.insert(text, gaps, np.arange(len(gaps), dtype=_U))  # parts do not touch
            where = np.insert(kept, gaps, -1)
            tiles = tile(item, text, k)
            covered = sum(n for _, _, n in tiles)
            if covered >= coverage * len(item):
                yield start + r, i, covered, [(a, int(where[b]), n) for a, b, n in tiles]


def _best(items: Items, hits: list[tuple]) -> list[tuple]:
    """Of the items with equal ids that a row covers, the one of which it covers most tokens."""
    best: dict[tuple, tuple] = {}
    for hit in hits:
        row, i, covered, tiles = hit
        key, rank = (row, items.ids[i]), (covered, len(items.tokens[i]), -len(tiles))
        if key not in best or rank > best[key][0]:
            best[key] = (rank, hit)
    return [hit for _, hit in best.values()]


def _slices(benchmark: DataFrame, id_col: str, text_col: str, k: int) -> Iterator[Items]:
    """The benchmark in slices of ``SLICE_WORDS`` tokens at most (or one id), one after another; items of an id stay together."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = max(1, -(-size // (2 * SLICE_WORDS)))  # a token takes two bytes with what parts it from the next
    for part in range(parts):
        table = rows.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).orderBy("id", "text").toArrow().combine_chunks()
        ids, texts = table["id"].to_pylist(), table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string())
        _, _, _, at = words(*utf8(texts), NOT_ALNUM)
        start = 0
        while start < len(ids) or (not ids and not start and parts == 1):
            end = max(start + 1, int(np.searchsorted(at, at[start] + SLICE_WORDS, "right")) - 1)
            while start < end < len(ids) and ids[end - 1] == ids[end]:  # at the last id that ends in time, or else at the end of the first
                earlier = next((e for e in range(end, start, -1) if ids[e - 1] != ids[e]), None)
                end = earlier or next((e for e in range(end, len(ids)) if ids[e - 1] != ids[e]), len(ids))
            end = min(end, len(ids))
            yield _items(ids[start:end], texts.slice(start, end - start), k)
            start = max(end, 1)


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row for every document and item that it covers: ids, item_words, covered_words, coverage, n_tiles, tiles.

    ``tiles``: (first token in the item, first token in the document, tokens).
    Documents that cover no item are not listed.
    """
    spark = prepare(docs.sparkSession)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    item_arrow = pa.int64() if item_kind.simpleString() == "bigint" else None
    span = pa.list_(pa.struct([("item_start", pa.int64()), ("doc_start", pa.int64()), ("length", pa.int64())]))
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind.simpleString()}, item_words bigint, covered_words bigint, coverage double, n_tiles int, tiles array<struct<item_start: bigint, doc_start: bigint, length: bigint>>"
    found = None
    for items in _slices(benchmark, item_col, text_col, k):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                hits = _best(items, list(_matches(items, batch.column(1), k, coverage)))
                total = [len(items.tokens[i]) for _, i, _, _ in hits]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([r for r, *_ in hits], pa.int64())),
                        pa.array([items.ids[i] for _, i, _, _ in hits], item_arrow),
                        pa.array(total, pa.int64()),
                        pa.array([c for _, _, c, _ in hits], pa.int64()),
                        pa.array([c / n for (_, _, c, _), n in zip(hits, total, strict=True)], pa.float64()),
                        pa.array([len(t) for *_, t in hits], pa.int32()),
                        pa.array([[{"item_start": a, "doc_start": b, "length": n} for a, b, n in t] for *_, t in hits], span),
                    ],
                    [id_col, item_col, "item_words", "covered_words", "coverage", "n_tiles", "tiles"],
                )

        part = docs.select(id_col, text_col).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, coverage: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item, with all columns."""
    spark = prepare(docs.sparkSession)
    for items in _slices(benchmark, "item_id", "text", k):
        shared = spark.sparkContext.broadcast(items)

        def clean(column: pa.Array, shared=shared) -> np.ndarray:
            keep = np.ones(len(column), bool)
            keep[[r for r, *_ in _matches(shared.value, column, k, coverage)]] = False
            return keep

        docs = filter_batches(docs, text_col, clean)
    return docs
