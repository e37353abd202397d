"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is described
by its make-up (letter cases, digits, kinds of punctuation, word endings and
lengths, repetition within the passage and of what stood earlier in the
document) and encoded by one hidden layer. Gated attention weighs the encoded
passages, the weights sum to one over the document, and a logistic unit scores
the weighted sum. Only documents carry labels.

The fit reads a sample bounded by ``DOCS`` labelled documents a class, in the
order of a hash of their id, none longer than ``DOC_BYTES``; sample weights put
the classes back in their proportion among all labelled rows. Scores see the
text alone. Null, empty and blank texts are one passage without words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import learnable, prepare
from .text import mix64, row_blocks, shingles, utf8, words

#: Labelled documents a class that fit the model at most.
DOCS = 2500
#: Longest document that is fitted on.
DOC_BYTES = 8_000
#: Words of a passage.
PASSAGE = 48
HIDDEN = 16
ATTENTION = 8

_GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n\r", ".,;:", "!?", "'\"-()", "|", "#$%&*", "@/\\_=+<>[]{}~^`")
_KIND = np.full(256, len(_GROUPS), np.uint8)
for _i, _group in enumerate(_GROUPS):
    _KIND[[ord(c) for c in _group]] = _i
_KIND[128:] = len(_GROUPS) + 1
_KINDS = len(_GROUPS) + 2
_LETTER = (_KIND < 3) | (_KIND == _KINDS - 1)
WIDTH = _KINDS + 12


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the passage offsets of the rows; each row has one at least."""
    rows = len(offsets) - 1
    hashes, first, last, at = words(data, offsets)
    count = np.diff(at)
    number = np.maximum(1, -(-count // PASSAGE))
    of_row = np.append(0, np.cumsum(number))
    total = int(of_row[-1])
    doc = np.repeat(np.arange(rows), count)
    owner = of_row[doc] + (np.arange(len(hashes)) - at[doc]) // PASSAGE
    x = np.zeros((total, WIDTH))
    if len(hashes):
        # A passage's bytes run from its first word to the next passage's.
        begins = np.append(True, owner[1:] != owner[:-1])
        where = first[begins]
        held = owner[begins]
        ends = np.append(where[1:], len(data))
        same = np.append(doc[begins][1:] == doc[begins][:-1], False)
        ends = np.where(same, ends, offsets[doc[begins] + 1])
        byte_of = np.zeros(len(data) + 1, np.int64)
        np.add.at(byte_of, where, 1)
        run = np.cumsum(byte_of[:-1]) - 1
        inside = run >= 0
        counts = np.bincount(run[inside] * _KINDS + _KIND[data[inside]], minlength=len(where) * _KINDS).reshape(-1, _KINDS)
        x[held, :_KINDS] = counts / np.maximum(1, ends - where)[:, None]
        n = np.bincount(owner, minlength=total).astype(float)
        some = np.maximum(n, 1)
        size = (last - first).astype(float)
        mean = np.bincount(owner, size, total) / some
        tail = _KIND[data[last - 1]]
        before = _KIND[data[np.maximum(last - 2, first)]]
        head = _KIND[data[first]]
        symbol = ~_LETTER[data[last - 1]]
        share = lambda flag: np.bincount(owner, flag, total) / some
        extra = [
            np.minimum(mean, 40) / 10,
            np.minimum(np.sqrt(np.maximum(np.bincount(owner, size * size, total) / some - mean * mean, 0)), 40) / 10,
            share(symbol),
            share(symbol & (tail == before) & (size > 1)),
            share((head == 0) & (before == 0) & (size > 2)),
            share(size > 18),
            share(size < 2),
            1 - _distinct(owner, hashes, total) / some,
        ]
        again = np.zeros(len(hashes))
        triple = shingles(hashes, 3)
        if len(triple):
            whole = doc[: len(triple)] == doc[2:]
            mixed = mix64(triple ^ mix64(doc[: len(triple)].astype(np.uint64)))
            _, one = np.unique(mixed, return_index=True)
            seen = np.ones(len(triple), bool)
            seen[one] = False
            again[: len(triple)] = seen & whole
        extra += [share(again), np.log1p(n) / 4, np.log1p(count[np.repeat(np.arange(rows), number)]) / 8]
        for j, column in enumerate(extra):
            x[:, _KINDS + j] = column
    x[:, WIDTH - 1] = np.repeat(count == 0, number)
    return x, of_row


def _distinct(owner: np.ndarray, hashes: np.ndarray, total: int) -> np.ndarray:
    """Distinct hashes of every owner."""
    _, one = np.unique(mix64(hashes ^ mix64(owner.astype(np.uint64))), return_index=True)
    return np.bincount(owner[one], minlength=total)


@dataclass
class Model:
    """Standardisation and the weights of encoder, gated attention and output."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def score(self, x: np.ndarray, of_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each bag, and the attention of each passage."""
        p, attention, _ = _forward(self.w, (x - self.mean) / self.scale, of_row)
        return p, attention


def _forward(w: dict[str, np.ndarray], x: np.ndarray, of_row: np.ndarray):
    h = np.tanh(x @ w["w"] + w["b"])
    t = np.tanh(h @ w["v"])
    g = 1 / (1 + np.exp(-(h @ w["u"])))
    logit = (t * g) @ w["a"]
    bag = np.repeat(np.arange(len(of_row) - 1), np.diff(of_row))
    top = np.maximum.reduceat(logit, of_row[:-1])
    e = np.exp(logit - top[bag])
    a = e / np.add.reduceat(e, of_row[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, of_row[:-1], axis=0)
    p = 1 / (1 + np.exp(-(z @ w["o"] + w["c"])))
    return p, a, (h, t, g, bag, z)


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, of_row: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    p, a, (h, t, g, bag, z) = _forward(w, x, of_row)
    d = weight * (p - y) / weight.sum()
    dz = d[:, None] * w["o"]
    back = dz[bag]
    along = (back * h).sum(1)
    dlogit = a * (along - np.add.reduceat(a * along, of_row[:-1])[bag])
    dt = dlogit[:, None] * w["a"] * g * (1 - t * t)
    dg = dlogit[:, None] * w["a"] * t * g * (1 - g)
    dh = a[:, None] * back + dt @ w["v"].T + dg @ w["u"].T
    dx = dh * (1 - h * h)
    return {"w": x.T @ dx, "b": dx.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (dlogit[:, None] * t * g).sum(0), "o": z.T @ d, "c": d.sum()}


def _train(x: np.ndarray, of_row: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 40, batch: int = 256, seed: int = 3) -> dict[str, np.ndarray]:
    """Adam over batches of bags."""
    rng = np.random.default_rng(seed)
    wide = x.shape[1]
    w = {"w": rng.normal(0, wide**-0.5, (wide, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, 0.25, (HIDDEN, ATTENTION)), "u": rng.normal(0, 0.25, (HIDDEN, ATTENTION)), "a": rng.normal(0, 0.35, ATTENTION), "o": rng.normal(0, 0.25, HIDDEN), "c": np.zeros(())}
    m, v, t = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
        for i in range(0, len(y), batch):
            some = order[i : i + batch]
            sizes = of_row[some + 1] - of_row[some]
            local = np.append(0, np.cumsum(sizes))
            take = np.repeat(of_row[some] - local[:-1], sizes) + np.arange(local[-1])
            grad = _gradient(w, x[take], local, y[some], weight[some])
            t += 1
            for k, g in grad.items():
                g = g + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = DOCS) -> Model:
    """A model from a bounded sample of the rows that may be learned from."""
    known = labels.filter(learnable(F.col(id_col)) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    share = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    order = F.md5(F.concat(F.lit("quality:"), F.col("_id").cast("string")).cast("binary"))
    chosen = None
    for y in (0, 1):  # 1.5 * most ids a class at most, of which some are too long or missing
        part = known.filter(F.col("_y") == y).distinct().orderBy(order, "_id").limit(most + most // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.filter(F.octet_length(text_col) <= DOC_BYTES).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    table = rows.join(F.broadcast(chosen), "_id").withColumn("_h", order).orderBy("_h", "_text").select("_y", "_text").toArrow()
    y = table["_y"].to_numpy()
    keep = np.sort(np.concatenate([np.flatnonzero(y == c)[:most] for c in (0, 1)]))
    y = y[keep].astype(float)
    if not len(y) or y.min() == y.max():
        prior = 0.5 if not len(y) else 0.99 if y[0] else 0.01
        w = {"w": np.zeros((WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "v": np.zeros((HIDDEN, ATTENTION)), "u": np.zeros((HIDDEN, ATTENTION)), "a": np.zeros(ATTENTION), "o": np.zeros(HIDDEN), "c": np.log(prior / (1 - prior))}
        return Model(np.zeros(WIDTH), np.ones(WIDTH), w)
    data, offsets = utf8(table["_text"].take(pa.array(keep)))
    del table
    parts = [passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_blocks(offsets, 1 << 20)]
    x = np.concatenate([p for p, _ in parts])
    of_row = np.append(0, np.cumsum(np.concatenate([np.diff(r) for _, r in parts])))
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    weight = np.where(y > 0, share[1] / (y > 0).sum(), share[0] / (y == 0).sum())
    return Model(mean, scale, _train((x - mean) / scale, of_row, y, weight))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Per row: id, score, predicted, n_passages, and the passage with most attention."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for start, end in row_blocks(offsets, 1 << 21):
                low = offsets[start]
                x, of_row = passages(data[low : offsets[end]], offsets[start : end + 1] - low)
                p, attention = judge.score(x, of_row)
                most = [int(attention[a:b].argmax()) for a, b in zip(of_row[:-1], of_row[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(np.diff(of_row), pa.int64()), pa.array(most, pa.int64())],
                    [id_col, "score", "predicted", "n_passages", "most_attended"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, n_passages bigint, most_attended bigint")
