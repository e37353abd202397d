"""Embedding near-duplicates by product quantisation.

A coarse quantiser (k-means over a bounded sample) deals every vector into one
inverted list, where it stands as codes of its residual in several subspaces.
A vector asks every list whose bisector with its own list lies within ``slack``
of it, half the chord of the threshold unless told, which misses no link;
distances there are looked up from its own tables (asymmetric), and what
could reach the threshold, given the member's known quantisation error, is
ranked again by exact cosine in double precision.

Equal vectors collapse to one node first, so copies cost nothing. Lists are cut
into blocks of members and of queries, and a task holds one block of each. A
block reports counts and a spanning forest of its links, never its pairs.

Vectors that are null, zero, or that hold null or non-finite components link
with nothing; vectors link with those of their own length only. Repeated ids
get a row each; rows without an id link like others, and their component is the
smallest id in it, null if it has none. Equal vectors are told by a 64-bit hash:
among n different ones two are taken for equal with a chance of n * n / 2^65. An
empty table gives an empty result. Columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, prepare
from .components import connected_components

#: Vectors that fit the quantisers at most.
SAMPLE = 20_000
#: Coarse lists at most; below that, twice the square root of the vectors.
MOST_LISTS = 4096
#: Rows of a block of members or queries.
BLOCK = 2048
#: Added to the slack for rounding where centroids nearly coincide.
ROUNDING = 1e-4


@dataclass
class Quantiser:
    """Coarse centroids, and a codebook for each subspace of the residual."""

    coarse: np.ndarray
    books: list[np.ndarray]
    spans: list[tuple[int, int]]

    def assign(self, unit: np.ndarray, slack: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own list of each vector, and the lists it must ask (its own among them)."""
        own, probes = np.empty(len(unit), np.int64), []
        norms = (self.coarse**2).sum(1)
        apart = np.sqrt(np.maximum(norms[:, None] + norms[None] - 2 * self.coarse @ self.coarse.T, 1e-12))
        for at in range(0, len(unit), 1024):
            power = norms - 2 * unit[at : at + 1024] @ self.coarse.T
            best = power.argmin(1)
            own[at : at + 1024] = best
            gap = (power - power[np.arange(len(best)), best][:, None]) / (2 * apart[best])
            gap[np.arange(len(best)), best] = 0
            probes += [np.flatnonzero(row) for row in gap <= slack]
        return own, probes

    def encode(self, unit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what the codes leave out."""
        rest = unit - self.coarse[own]
        codes = np.empty((len(unit), len(self.books)), np.uint8)
        for s, ((a, b), book) in enumerate(zip(self.spans, self.books, strict=True)):
            codes[:, s] = _nearest(rest[:, a:b], book)
            rest[:, a:b] -= book[codes[:, s]]
        return codes, np.sqrt((rest**2).sum(1))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms = (centres**2).sum(1)
    return np.concatenate([(norms - 2 * x[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centres))
        held = count > 0
        centres[held] = sums[held] / count[held][:, None]
    return centres


def fit(sample: np.ndarray, vectors: int, subspaces: int = 8, seed: int = 7) -> Quantiser:
    """Quantisers for about ``vectors`` vectors from a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(MOST_LISTS, int(2 * vectors**0.5), len(sample) // 4))
    coarse = _kmeans(sample, lists, 8, rng)
    rest = sample - coarse[_nearest(sample, coarse)]
    ends = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
    spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
    return Quantiser(coarse, [_kmeans(rest[:, a:b], 256, 6, rng) for a, b in spans], spans)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node reachable) for the links between arrays of node ids."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == old).all():
            break
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _block(table: pa.Table, quantiser: Quantiser, threshold: float) -> pa.Table:
    """Link counts and spanning edges between the queries and the members of one block."""
    asks = table["asks"].to_numpy()
    node, count, own = table["node"].to_numpy(), table["c"].to_numpy(), table["own"].to_numpy()
    unit = np.frombuffer(b"".join(table["unit"].to_pylist()), np.float64).reshape(len(node), -1)
    q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
    ids, counts, us, vs = [], [], [], []
    if len(q) and len(m):
        codes = np.frombuffer(b"".join(x for x, ask in zip(table["codes"].to_pylist(), asks, strict=True) if not ask), np.uint8).reshape(len(m), -1)
        err = table["err"].to_numpy()[m]
        probes = [x for x, ask in zip(table["probes"].to_pylist(), asks, strict=True) if not ask]
        padded = np.full((len(m), max(map(len, probes))), -1)
        for row, x in zip(padded, probes, strict=True):
            row[: len(x)] = x
        centre = quantiser.coarse[own[m[0]]]
        near = np.repeat((unit[q] @ centre).astype(np.float32)[:, None], len(m), 1)
        for s, ((a, b), book) in enumerate(zip(quantiser.spans, quantiser.books, strict=True)):
            near += (unit[q, a:b] @ book.T).astype(np.float32)[:, codes[:, s]]
        qi, mi = np.nonzero(near >= threshold - err[None] - 1e-4)
        links = np.zeros(len(node), np.int64)
        for at in range(0, len(qi), 1 << 16):
            x, y = q[qi[at : at + (1 << 16)]], m[mi[at : at + (1 << 16)]]
            good = (np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold) & (node[x] != node[y])
            x, y, back = x[good], y[good], mi[at : at + (1 << 16)][good]
            np.add.at(links, x, count[y])
            unseen = ~(padded[back] == own[x][:, None]).any(1)  # the member does not ask the query's list
            np.add.at(links, y[unseen], count[x[unseen]])
            if len(x):
                u, v = _forest(node[x], node[y])
                us.append(u)
                vs.append(v)
        some = links > 0
        ids, counts = node[some], links[some]
    u, v = (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2
    if len(us) > 1:
        u, v = _forest(u, v)
    return pa.table(
        {
            "node": pa.array(np.concatenate([np.asarray(ids, np.int64), u]), pa.int64()),
            "other": pa.array([None] * len(ids) + v.tolist(), pa.int64()),
            "links": pa.array(np.concatenate([np.asarray(counts, np.int64), np.zeros(len(u), np.int64)]), pa.int64()),
        }
    )


def full_slack(threshold: float) -> float:
    """Slack at which no link is missed.

    Unit vectors at the threshold lie a chord of sqrt(2 - 2 * threshold) apart at
    most. If they are in different lists, the segment between them crosses the
    bisector, so one of the two lies within half the chord of it and asks.
    """
    return max(0.0, (1 - threshold) / 2) ** 0.5 + ROUNDING


def _unit_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, node, dim, unit) of every row; node is null for vectors that link with nothing."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, dim, unit = [], [], []
            for value in batch.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in value or []], np.float64)
                scale = np.abs(x).max() if len(x) else 0.0
                if np.isfinite(x).all() and scale > 0:
                    x = x / scale  # so that the norm neither overflows nor vanishes
                    raw = (x / np.sqrt((x * x).sum()) + 0.0).tobytes()
                    node.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True))
                    dim.append(len(x))
                    unit.append(raw)
                else:
                    node.append(None)
                    dim.append(None)
                    unit.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(dim, pa.int32()), pa.array(unit, pa.binary())], ["id", "node", "dim", "unit"])

    return vectors.select(id_col, vec_col).mapInArrow(run, f"id {kind}, node bigint, dim int, unit binary")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, slack: float | None = None) -> DataFrame:
    """Per row: id, n_links (other vectors linked directly), component_id, kept (id = component_id)."""
    spark = prepare(vectors.sparkSession)
    slack = full_slack(threshold) if slack is None else slack
    rows = _unit_rows(vectors, id_col, vec_col)
    nodes = cut(rows.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("c"), F.first("dim").alias("dim"), F.first("unit").alias("unit")))
    ids = rows.select("id", "node")
    links, edges = spark.createDataFrame([], "node bigint, links bigint"), spark.createDataFrame([], "u bigint, v bigint")
    # Vectors of different lengths have no cosine, so each length is a search of its own.
    for row in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("dim").collect():
        more, ties = _search(spark, nodes.filter(F.col("dim") == row["dim"]), row["n"], threshold, slack)
        links, edges = links.unionByName(more), edges.unionByName(ties)
    parts = connected_components(edges)
    # Written first, so that a component of very many nodes is no group of the join's own stage, and a skewed join can be dealt anew.
    roots = cut(parts.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("root")))
    placed = nodes.select("node", "least", "c").join(parts, "node", "left").join(roots, "component", "left")
    named = placed.join(links, "node", "left").select("node", F.coalesce("root", "least").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("links"))
    found = ids.join(named, "node", "left").select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _search(spark, nodes: DataFrame, n: int, threshold: float, slack: float) -> tuple[DataFrame, DataFrame]:
    """(node, links) and the spanning edges of all links."""
    share = min(1.0, SAMPLE / n)
    picked = nodes.filter(F.pmod("node", F.lit(1 << 20)) < max(1, int(share * (1 << 20)))) if share < 1 else nodes  # node ids are hashes
    sample = np.frombuffer(b"".join(picked.select("unit").limit(2 * SAMPLE).toArrow()["unit"].to_pylist()), np.float64)
    dim = len(nodes.select("unit").first()[0]) // 8
    shared = spark.sparkContext.broadcast(fit(sample.reshape(-1, dim), n) if len(sample) else Quantiser(np.zeros((1, dim)), [np.zeros((1, dim))], [(0, dim)]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(batch.num_rows, -1)
            own, probes = quantiser.assign(unit, slack)
            codes, err = quantiser.encode(unit, own)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own), pa.array([p.tolist() for p in probes], pa.list_(pa.int64())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err)],
                ["node", "c", "unit", "own", "probes", "codes", "err"],
            )

    dealt = cut(nodes.select("node", "c", "unit").mapInArrow(deal, "node bigint, c bigint, unit binary, own bigint, probes array<bigint>, codes binary, err double"))
    members = dealt.groupBy(F.col("own").alias("list")).agg(F.count(F.lit(1)).alias("members"))
    asked = dealt.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("queries"))
    # One row a list, 4,096 at most by the bound on the coarse quantiser.
    blocks = F.broadcast(members.join(asked, "list").selectExpr("list", f"cast(ceil(members / {BLOCK}) as int) mb", f"cast(ceil(queries / {BLOCK}) as int) qb"))
    place = F.xxhash64("node")
    as_members = dealt.join(blocks, dealt["own"] == blocks["list"]).select(
        "list", F.pmod(place, F.col("mb")).cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), F.lit(False).alias("asks"), "node", "c", "own", "unit", "codes", "err", "probes"
    )
    as_queries = dealt.select("node", "c", "own", "unit", F.explode("probes").alias("list")).join(blocks, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), F.pmod(place, F.col("qb")).cast("int").alias("q"), F.lit(True).alias("asks"), "node", "c", "own", "unit",
        F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("err"), F.lit(None).cast("array<bigint>").alias("probes"),
    )

    def block(table: pa.Table) -> pa.Table:
        return _block(table, shared.value, threshold)

    found = cut(as_members.unionByName(as_queries).groupBy("list", "m", "q").applyInArrow(block, "node bigint, other bigint, links bigint"))
    links = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    return links, found.filter("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v"))
