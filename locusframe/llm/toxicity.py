"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its
words and word beginnings; the document's is their noisy-or,
``1 - prod(1 - p)``, and only documents carry labels. Training is full-batch
gradient descent on the documents' log loss, and afterwards the sentence
probabilities say which sentences offend.

The fit reads a sample bounded by ``DOCS`` labelled documents a class, in the
order of a hash of their id, none longer than ``DOC_BYTES``; sample weights put
the classes back in their proportion among all labelled rows. Scores see the
text alone. Null and empty texts score what a bag without sentences scores: 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import learnable, prepare
from .text import NOT_ALNUM, prefix_hashes, row_blocks, utf8, words

#: Labelled documents a class that fit the model at most.
DOCS = 2500
#: Longest document that is fitted on.
DOC_BYTES = 8_000
#: Bytes of text that the fit describes at once.
FIT_BLOCK = 1 << 19
#: Features that the model holds at most.
FEATURES = 1 << 15
PREFIXES = (4, 5, 6)
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n\r"]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte of each sentence, byte after its last, and the sentence offsets of the rows.

    A sentence runs up to and with its end marks; blank rows have none.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    end = _END[data]
    starts = np.zeros(len(data), bool)
    starts[1:] = end[:-1] & ~end[1:]
    starts[offsets[:-1][offsets[:-1] < len(data)]] = True
    first = np.flatnonzero(starts)
    return first, np.append(first[1:], len(data)), np.searchsorted(first, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature hash, its sentence), and the sentences as ``sentences`` gives them."""
    first, last, of_row = sentences(data, offsets)
    whole, begin, end, _ = words(data, offsets, NOT_ALNUM)
    owner = np.searchsorted(first, begin, "right") - 1
    kinds = [whole ^ np.uint64(0x5DEECE66D)] + [prefix_hashes(data, begin, end, n) for n in PREFIXES]
    return np.concatenate(kinds), np.tile(owner, len(kinds)), first, last, of_row


@dataclass
class Model:
    """Sorted feature hashes with their weights, and the bias of a sentence."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that hold features, and the features."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return at, at
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        good = self.keys[key] == hashes[at]
        return at[good], key[good]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each row; of each sentence; and the sentences."""
        hashes, owner, first, last, of_row = features(data, offsets)
        place, key = self.hits(hashes)
        z = np.full(len(first), self.bias)
        np.add.at(z, owner[place], self.weights[key])
        soft = np.logaddexp(0, z)
        total = np.append(0, np.cumsum(soft))
        bag = total[of_row[1:]] - total[of_row[:-1]]
        return -np.expm1(-np.maximum(bag, 0)), -np.expm1(-soft), first, last, of_row


def _train(sentence: np.ndarray, feature: np.ndarray, count: int, bag: np.ndarray, bags: int, label: np.ndarray, weight: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the noisy-or log loss."""
    w, b = np.zeros(count), -6.0
    m, v = np.zeros(count + 1), np.zeros(count + 1)
    total = weight.sum()
    for t in range(1, rounds + 1):
        z = np.full(len(bag), b) + np.bincount(sentence, w[feature], len(bag))
        soft = np.bincount(bag, np.logaddexp(0, z), bags).clip(1e-9, 50)
        slope = weight * np.where(label > 0, -1 / np.expm1(soft), 1.0) / total
        dz = slope[bag] / (1 + np.exp(-z))
        grad = np.append(np.bincount(feature, dz[sentence], count) + 2e-6 * w, dz.sum())
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        step = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w -= step[:-1]
        b -= step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = DOCS) -> Model:
    """A model from a bounded sample of the rows that may be learned from."""
    known = labels.filter(learnable(F.col(id_col)) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    share = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    order = F.md5(F.concat(F.lit("tox:"), F.col("_id").cast("string")).cast("binary"))
    chosen = None
    for y in (0, 1):  # 1.5 * most ids a class at most, of which some are too long or missing
        part = known.filter(F.col("_y") == y).distinct().orderBy(order, "_id").limit(most + most // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.filter(F.octet_length(text_col) <= DOC_BYTES).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    table = rows.join(F.broadcast(chosen), "_id").withColumn("_h", order).orderBy("_h", "_text").select("_y", "_text").toArrow()
    y = table["_y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1, np.uint64), np.zeros(1), float(np.log(1e-3) if not len(y) or not y.max() else 3.0))
    keep = np.sort(np.concatenate([np.flatnonzero(y == c)[:most] for c in (0, 1)]))
    y = y[keep]
    data, offsets = utf8(table["_text"].take(pa.array(keep)))
    del table
    # Features by the toxic documents that hold them, then by the others; in blocks, so that little is held.
    keys, pos = _document_counts(data, offsets, y > 0)
    keys, pos = keys[pos >= 3], pos[pos >= 3]
    if not len(keys):
        return Model(np.zeros(1, np.uint64), np.zeros(1), float(np.log(share[1] / (share[0] + share[1]))))
    seen, count = _document_counts(data, offsets, y == 0, Model(keys, np.zeros(len(keys)), 0.0))
    neg = np.zeros(len(keys), np.int64)
    neg[np.searchsorted(keys, seen)] = count
    weight = np.where(y > 0, share[1] / max(1, (y > 0).sum()), share[0] / max(1, (y == 0).sum()))
    lift = (pos + 0.1) / (y > 0).sum() / ((neg + 0.5) / (y == 0).sum())
    able = np.flatnonzero((pos >= 3) & (lift >= 4))
    able = np.sort(able[np.argsort(-pos[able] * np.log(lift[able]), kind="stable")][:FEATURES])
    if not len(able):
        return Model(np.zeros(1, np.uint64), np.zeros(1), float(np.log(share[1] / (share[0] + share[1]))))
    model = Model(keys[able], np.zeros(len(able)), 0.0)
    sentence, feature, bags, total = [], [], [], 0
    for start, end in row_blocks(offsets, FIT_BLOCK):
        hashes, owner, first, _, of_row = features(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
        place, key = model.hits(hashes)
        sentence.append(owner[place] + total)
        feature.append(key)
        bags.append(np.repeat(np.arange(start, end), np.diff(of_row)))
        total += len(first)
    model.weights, model.bias = _train(np.concatenate(sentence), np.concatenate(feature), len(able), np.concatenate(bags), len(y), y, weight)
    return model


def _document_counts(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray, among: Model | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted features of the chosen rows (or those of them in a model), and the rows that hold each."""
    kept = []
    for start, end in row_blocks(offsets, FIT_BLOCK):
        low = offsets[start]
        hashes, owner, _, _, of_row = features(data[low : offsets[end]], offsets[start : end + 1] - low)
        row = np.searchsorted(of_row, owner, "right") - 1
        if among is not None:
            place, key = among.hits(hashes)
            hashes, row = among.keys[key], row[place]
        good = chosen[start + row]
        hashes, row = hashes[good], row[good]
        order = np.lexsort((row, hashes))
        hashes, row = hashes[order], row[order]
        once = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
        kept.append(np.unique(hashes[once], return_counts=True))
    keys = np.concatenate([k for k, _ in kept] + [np.zeros(0, np.uint64)])
    counts = np.concatenate([c for _, c in kept] + [np.zeros(0, np.int64)])
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where, counts, len(found)).astype(np.int64)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: id, score, predicted, and the sentences at or over the threshold by themselves.

    ``offending``: (first byte, byte after the last, probability) in the UTF-8 text.
    """
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for start, end in row_blocks(offsets):
                low = offsets[start]
                bag, each, first, last, of_row = judge.score(data[low : offsets[end]], offsets[start : end + 1] - low)
                bad = np.flatnonzero(each >= threshold)
                row = np.searchsorted(of_row, bad, "right") - 1
                spans: list[list] = [[] for _ in range(end - start)]
                for r, s in zip(row.tolist(), bad.tolist(), strict=True):
                    base = int(offsets[start + r] - low)
                    spans[r].append({"start": int(first[s]) - base, "end": int(last[s]) - base, "p": float(each[s])})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(bag), pa.array((bag >= threshold).astype(np.int32)), pa.array(spans, span)], [id_col, "score", "predicted", "offending"]
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, offending array<struct<start: bigint, end: bigint, p: double>>")
