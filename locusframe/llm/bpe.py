"""Byte-level BPE encoding and decoding.

Every match of the split pattern is encoded on its own. A segment tree over
the match's byte positions holds, for each live position, the rank of the pair
that starts there; its root is the smallest rank, leftmost on ties. A merge
joins the pair at the root and updates three leaves (the merged position, its
live left neighbour and the position that died), each in logarithmic time, so a
match of n bytes costs O(n log n) however long it is.

Null and empty texts have no tokens; special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .text import row_blocks

SHIFT = 32
FREE = 1 << 30  # above any rank: this pair is no token
NONE = FREE << SHIFT
LOW = (1 << SHIFT) - 1
CACHED_MATCHES = 200_000
CACHED_BYTES = 64
LONG_TEXT = 1 << 20
BATCHED = 1 << 14
DOCS_AT_ONCE = 1 << 20  # characters


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a ``.tiktoken`` file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match by segment-tree merging."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    half = 1 << (n - 1).bit_length()
    # A leaf holds rank << SHIFT | position, so the root is the leftmost smallest rank.
    tree = [NONE] * half
    tree += [get(piece[i : i + 2], FREE) << SHIFT | i for i in range(n - 1)]
    tree += [NONE] * (2 * half - len(tree))
    for i in range(half - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left < right else right
    after = list(range(1, n + 2))  # the next live position, which is also this token's end
    before = list(range(-1, n))
    while (top := tree[1]) < NONE:
        i = top & LOW
        j = after[i]
        end = after[i] = after[j]
        before[end] = i
        p = before[i]
        at = half + j
        key = NONE
        while True:  # point updates at j, then i, then p, each up to the first unchanged minimum
            tree[at] = key
            while at > 1:
                other = tree[at ^ 1]
                if other < key:
                    key = other
                at >>= 1
                if tree[at] == key:
                    break
                tree[at] = key
            if j >= 0:
                j = -1
                at = half + i
                key = get(piece[i : after[end]], FREE) << SHIFT | i if end < n else NONE
            elif p >= 0:
                at = half + p
                key = get(piece[p:end], FREE) << SHIFT | p
                p = -1
            else:
                break
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class PairTable:
    """Ranks of token pairs by their two ids, as one open-addressed array."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[token[:k]] << 32 | ranks[token[k:]], rank) for token, rank in ranks.items() for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        keys = np.array([k for k, _ in pairs], np.uint64)
        values = np.array([v for _, v in pairs], np.int32)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << self.bits, FREE, np.int32)
        self.reach = 1
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # the first of those that want a slot takes it, the rest move on
            free = left[self.keys[slot[left]] == np.iinfo(np.uint64).max]
            _, first = np.unique(slot[free], return_index=True)
            got = free[first]
            self.keys[slot[got]], self.values[slot[got]] = keys[got], values[got]
            left = np.setdiff1d(left, got, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            self.reach += bool(len(left))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, FREE for pairs that are no token."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], FREE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != np.iinfo(np.uint64).max))
        for step in range(1, self.reach):
            if not len(open_):
                break
            at = (slot[open_] + step) & ((1 << self.bits) - 1)
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.keys[at] != np.iinfo(np.uint64).max)]
        return out


def merge_many(pieces: list[bytes], pairs: PairTable, single: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """``merge_bytes`` for many matches of 2 to ``half`` bytes at once: flat ids, and the number of each.

    Every match has a segment tree of its own, a row of one array; each round
    makes the merge at every root that has one and updates the three leaves.
    """
    count, width = len(pieces), 2 * half
    lengths = np.fromiter(map(len, pieces), np.int64, count)
    raw = np.frombuffer(b"".join(piece.ljust(half, b"\0") for piece in pieces), np.uint8).reshape(count, half)
    token = single[raw].ravel()
    place = np.arange(half)
    alive = place < lengths[:, None]
    bits = half.bit_length() - 1
    key = pairs.of(token, np.roll(token, -1)).reshape(count, half).astype(np.int64) << bits | place
    none = FREE << bits
    key[place >= lengths[:, None] - 1] = none
    tree = np.full((count, width), none, np.int64)
    tree[:, half:] = key
    for at in range(half - 1, 0, -1):
        np.minimum(tree[:, 2 * at], tree[:, 2 * at + 1], out=tree[:, at])
    tree, alive = tree.ravel(), alive.ravel()
    after = np.broadcast_to(np.arange(1, half + 2), (count, half + 1)).ravel().copy()
    before = np.broadcast_to(np.arange(-1, half), (count, half + 1)).ravel().copy()
    rows = np.arange(count)
    while True:
        top = tree[rows * width + 1]
        rows, top = rows[top < none], top[top < none]
        if not len(rows):
            break
        i = top & (half - 1)
        link, flat = rows * (half + 1), rows * half
        j = after[link + i]
        end = after[link + j]
        after[link + i], before[link + end] = end, i
        token[flat + i] = top >> bits
        alive[flat + j] = False
        p = before[link + i]
        leaf = rows * width + half
        tree[leaf + j] = none
        right = end < lengths[rows]
        tree[leaf + i] = np.where(right, pairs.of(token[flat + i], token[flat + np.where(right, end, 0)]).astype(np.int64) << bits | i, none)
        left = p >= 0
        tree[(leaf + p)[left]] = pairs.of(token[(flat + p)[left]], token[(flat + i)[left]]).astype(np.int64) << bits | p[left]
        at, base = half + np.concatenate([j, i, p[left]]), np.concatenate([rows, rows, rows[left]]) * width
        for _ in range(bits):
            at >>= 1
            tree[base + at] = np.minimum(tree[base + 2 * at], tree[base + 2 * at + 1])
    return token[alive], alive.reshape(count, half).sum(1)


class Codec:
    """Encoder and decoder for one table of ranks and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern)
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def _learn(self, matches: set[str]) -> None:
        """Ids of matches not seen before. Whole tokens are themselves; long matches go one by one."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for match in matches:
            raw = match.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[match] = rank.to_bytes(4, "little")
            elif len(raw) > CACHED_BYTES:
                self.known[match] = np.array(merge_bytes(raw, self.ranks), "<u4").tobytes()
            else:
                by_size.setdefault(1 << (len(raw) - 1).bit_length(), []).append((match, raw))
        for half, some in by_size.items():
            for start in range(0, len(some), BATCHED):
                part = some[start : start + BATCHED]
                flat, counts = merge_many([raw for _, raw in part], self.pairs, self.single, half)
                blob, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                self.known.update((match, blob[a:b]) for (match, _), a, b in zip(part, [0, *ends], ends, strict=False))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHED_MATCHES:
            self.known.clear()
        found = [self.find.findall(text) for text in texts]
        fresh = {match for match in set().union(*found) if match not in self.known}
        if fresh:
            self._learn(fresh)
        at = self.known.__getitem__
        return [b"".join(map(at, matches)) for matches in found]

    def encode(self, text: str) -> bytes:
        """Ids of one text, however long."""
        if len(text) < LONG_TEXT:
            return self.encode_many([text])[0]
        matches, parts = self.find.finditer(text), []
        while some := [m[0] for m in islice(matches, 1 << 17)]:
            if len(self.known) > CACHED_MATCHES:
                self.known.clear()
            self._learn({match for match in set(some) if match not in self.known})
            parts.append(b"".join(map(self.known.__getitem__, some)))
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        """Bytes that the ids stand for."""
        at = self.tokens.__getitem__
        flat = np.frombuffer(ids, "<u4")
        return b"".join(b"".join(map(at, flat[i : i + LONG_TEXT].tolist())) for i in range(0, len(flat), LONG_TEXT))


_codecs: dict[tuple[int, str], Codec] = {}


def codec_of(ranks_file: bytes, pattern: str) -> Codec:
    """The worker's codec for a ranks file; one is kept."""
    key = (hash(ranks_file), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(parse_ranks(ranks_file), pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 and decoded_sha256; with ``ids`` also token_ids (binary).

    ``ranks_path`` is read once on the driver and broadcast (about a megabyte).
    Each text is encoded whole and its ids are decoded again. Other columns are
    ignored.
    """
    spark: SparkSession = docs.sparkSession
    with open(ranks_path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", token_ids binary" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value, pattern)
        for batch in batches:
            size = np.cumsum([0, *(len(x) for x in texts)]) if (texts := [x or "" for x in batch.column(1).to_pylist()]) else np.zeros(1)
            for start, end in row_blocks(size, DOCS_AT_ONCE):
                part = batch.slice(start, end - start)
                count, hashed, back, kept = [], [], [], []
                for encoded in codec.encode_many(texts[start:end]) if size[end] - size[start] < LONG_TEXT + DOCS_AT_ONCE else [codec.encode(x) for x in texts[start:end]]:
                    count.append(len(encoded) // 4)
                    hashed.append(hashlib.sha256(encoded).hexdigest())
                    back.append(hashlib.sha256(codec.decode(encoded)).hexdigest())
                    if ids:
                        kept.append(encoded)
                columns = [part.column(0), pa.array(count, pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The other columns of ``docs`` with ``n_tokens``, the tokens of the whole text; null texts have none. A column of that name is replaced."""
    spark: SparkSession = docs.sparkSession
    with open(ranks_path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    others = [c for c in docs.columns if c not in (text_col, "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(len(others)).to_pylist()]
            counts: list[int] = []
            for start, end in row_blocks(np.cumsum([0, *map(len, texts)]), DOCS_AT_ONCE):
                some = texts[start:end]
                counts += [len(x) // 4 for x in (codec.encode_many(some) if sum(map(len, some)) < LONG_TEXT + DOCS_AT_ONCE else map(codec.encode, some))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*others, "n_tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema.fields), "n_tokens bigint"])
    return docs.select(*others, text_col).mapInArrow(run, schema)
