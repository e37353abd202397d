"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct word shingles, as 64-bit hashes. Sets are put
in one order (rare shingles first) and two sets that reach the threshold share
a shingle within their prefixes. Documents with equal sets collapse to one
node; nodes with identical prefixes and sizes collapse to one group; group
pairs that meet in a posting list pass the size and position filters, are
expanded to their members, and every pair of members is verified on whole sets.
Before sets are sent anywhere, pairs are compared by parity bitmaps of about a
bit a shingle: sets differ in at least as many shingles as their bitmaps in
bits, so a pair that this rules out cannot link.

No posting list is paired with itself: first every list links its members to
one leader, and what is verified there forms components; then only pairs of
members that are still in different components are compared. That loses no
component, and a group of copies costs work in proportion to its size.

The order only steers speed. Shingles that occur in many documents of a stretch
are counted, and the most frequent go last; a frequent shingle that this misses
gives longer posting lists, never another result.

Null, blank and wordless texts have size 0 and link with nothing; rows with
equal ids each get a result. Rows without an id link like others and their
component is the smallest id in it, null if it has none. An empty table gives an
empty result; texts are read whole, of any length. Columns other than the two
named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import cut, prepare
from .components import connected_components
from .text import row_blocks, shingle_set, utf8, words

#: Of the frequent shingles, so many are ordered last. Bounds the broadcast at about 3 MB.
FREQUENT = 200_000
#: Shingles of different sets that are counted together (8 bytes each).
STRETCH = 4_000_000
#: A shingle counts as frequent in such a stretch if so many different sets hold it.
FREQUENT_IN_STRETCH = 3
#: 64-bit words of the small bitmap that is compared where posting lists are joined.
MINI = 4
#: Rows of (id, node) up to which the wanted documents are broadcast instead of shuffled.
BROADCAST_ROWS = 200_000
#: Dropped ids up to which they are broadcast against the texts.
DROPPED_ROWS = 1_000_000


def _signed(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def _hash(data: bytes) -> int:
    return _signed(hashlib.blake2b(data, digest_size=8).digest())


def _sets(batch: pa.RecordBatch, column: int, k: int) -> Iterator[list[np.ndarray]]:
    """Shingle sets of the rows, in blocks of rows."""
    data, offsets = utf8(batch.column(column))
    for start, end in row_blocks(offsets, 1 << 23):
        low = offsets[start]
        hashes, _, _, at = words(data[low : offsets[end]], offsets[start : end + 1] - low)
        yield [shingle_set(hashes[at[i] : at[i + 1]], k) for i in range(end - start)]


def frequent_shingles(docs: DataFrame, text_col: str, k: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counted documents. At most ``most``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        size = 0

        def often() -> pa.RecordBatch:
            flat = np.sort(np.concatenate([*held.values(), np.zeros(0, np.uint64)]))
            firsts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
            counts = np.diff(np.append(firsts, len(flat)))
            kept = counts >= FREQUENT_IN_STRETCH
            return pa.RecordBatch.from_arrays([pa.array(flat[firsts[kept]].view(np.int64)), pa.array(counts[kept])], ["token", "c"])

        for batch in batches:
            for sets in _sets(batch, 0, k):
                for s in sets:
                    key = hashlib.blake2b(s.tobytes(), digest_size=8).digest()
                    if len(s) and key not in held:
                        held[key] = s
                        size += len(s)
                if size >= STRETCH:
                    yield often()
                    held.clear()
                    size = 0
        yield often()

    top = docs.select(text_col).mapInArrow(count, "token bigint, c bigint").groupBy("token").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "token").limit(most).toArrow()
    token, c = top["token"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(token)
    return token[order], c[order]


class PrefixOrder:
    """Rare shingles by hash, then frequent ones by count."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        self.frequent, self.counts = frequent, counts
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(frequent >> np.uint64(42)).astype(np.int64)] = True

    def prefix(self, tokens: np.ndarray, length: int) -> np.ndarray:
        """The first ``length`` of a sorted set."""
        suspects = np.flatnonzero(self.maybe[(tokens >> np.uint64(42)).astype(np.int64)])
        if len(suspects):
            at = np.searchsorted(self.frequent, tokens[suspects])
            hit = self.frequent[np.minimum(at, len(self.frequent) - 1)] == tokens[suspects]
            suspects, at = suspects[hit], at[hit]
        if not len(suspects):
            return tokens[:length]
        rare = np.ones(len(tokens), bool)
        rare[suspects] = False
        first = tokens[rare][:length]
        if len(first) == length:
            return first
        last = tokens[suspects][np.argsort(self.counts[at], kind="stable")]
        return np.concatenate([first, last[: length - len(first)]])


def parity(tokens: np.ndarray, bits: int = 0) -> np.ndarray:
    """Bitmap as 64-bit words: bit ``b`` is the parity of the shingles with low bits ``b``. About a bit a shingle unless told."""
    bits = bits or max(64, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


#: Folds the longer of two bitmaps in half; sizes that may link are never further apart.
_FOLD = "case when size({a}) > size({b}) then zip_with(slice({a}, 1, size({b})), slice({a}, size({b}) + 1, size({b})), (x, y) -> x ^ y) else {a} end"


def _differ(a: str, b: str) -> str:
    """SQL: bits in which two bitmaps differ."""
    return f"aggregate(zip_with({_FOLD.format(a=a, b=b)}, {_FOLD.format(a=b, b=a)}, (x, y) -> bit_count(x ^ y)), 0, (a, x) -> a + x)"


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps do not rule them out, and whose sizes allow the threshold."""
    left = nodes.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("bits").alias("bu"))
    right = nodes.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("bits").alias("bv"))
    both = pairs.select("u", "v").join(left, "u").join(right, "v").filter(f"{percent} * greatest(nu, nv) <= 100 * least(nu, nv)")
    # difference <= sizes - 2 * overlap, and overlap >= percent / (100 + percent) * sizes
    return both.filter(f"{100 + percent} * {_differ('bu', 'bv')} <= {100 - percent} * (nu + nv)").select("u", "v")


def _profiles(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, order) -> DataFrame:
    """(id, n, node, g, prefix, bits, mini) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = PrefixOrder(*order.value)
        for batch in batches:
            start = 0
            for sets in _sets(batch, 1, k):
                n, node, g, prefix, bits, mini = [], [], [], [], [], []
                for s in sets:
                    size = len(s)
                    n.append(size)
                    if not size:
                        node.append(None)
                        g.append(None)
                        prefix.append(None)
                        bits.append(None)
                        mini.append(None)
                        continue
                    p = by.prefix(s, size - -(-percent * size // 100) + 1)
                    node.append(_hash(s.tobytes()))
                    g.append(_hash(p.tobytes() + size.to_bytes(8, "little")))
                    prefix.append(p.view(np.int64))
                    bits.append(parity(s))
                    mini.append(parity(s, 64 * MINI))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(sets)), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(g, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(mini, pa.list_(pa.int64()))],
                    ["id", "n", "node", "g", "prefix", "bits", "mini"],
                )
                start += len(sets)

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n bigint, node bigint, g bigint, prefix array<bigint>, bits array<bigint>, mini array<bigint>")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` of nodes whose whole sets reach the threshold."""
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct().join(nodes.select("node", "doc"), "node")
    wanted = cut(wanted)
    nameless = wanted.filter("doc is null").select("node")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(wanted, "doc").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, start = batch.column(0).to_pylist(), 0
            for sets in _sets(batch, 1, k):
                kept = [(h, s) for e, s in zip(expected[start : start + len(sets)], sets, strict=True) if len(s) and (h := _hash(s.tobytes())) == (h if e is None else e)]
                start += len(sets)
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in kept], pa.int64()), pa.array([s.view(np.int64) for _, s in kept], pa.list_(pa.int64()))], ["node", "s"])

    sets = texts.mapInArrow(run, "node bigint, s array<bigint>")
    if not nameless.isEmpty():  # only rows without an id hold these nodes: they are found by hash, since ids would pair every such row with every such node
        unnamed = docs.filter(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("node"), F.col(text_col).alias("text"))
        sets = sets.unionByName(unnamed.mapInArrow(run, "node bigint, s array<bigint>").join(nameless, "node", "left_semi").dropDuplicates(["node"]))
    left = sets.select(F.col("node").alias("u"), F.col("s").alias("su"))
    right = sets.select(F.col("node").alias("v"), F.col("s").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    reached = 100 * both >= percent * (F.size("su") + F.size("sv") - both)
    return pairs.select("u", "v").join(left, "u").join(right, "v").filter(reached).select("u", "v").distinct()


def _may_link(a: str, b: str, percent: int) -> str:
    """SQL: sizes allow the threshold, and so do the positions if this is the first common shingle.

    Two sets that link have a first common shingle in both prefixes, and meet there.
    """
    overlap = f"least({a}.n - {a}.pos, {b}.n - {b}.pos)"
    return f"{percent} * greatest({a}.n, {b}.n) <= 100 * least({a}.n, {b}.n) and {100 + percent} * ({overlap}) >= {percent} * ({a}.n + {b}.n)"


def link_nodes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles of all rows, the nodes, and (node, component) of the linked nodes."""
    spark = prepare(docs.sparkSession)
    order = spark.sparkContext.broadcast(frequent_shingles(docs, text_col, k))
    profiles = cut(_profiles(docs, id_col, text_col, k, percent, order))
    held = profiles.filter("n > 0")
    nodes = cut(held.groupBy("node").agg(F.min("id").alias("doc"), F.first("n").alias("n"), F.first("g").alias("g"), F.first("bits").alias("bits"), *(F.first(F.col("mini")[j]).alias(f"b{j}") for j in range(MINI))))
    groups = held.groupBy("g").agg(F.min("node").alias("lead"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))

    # Posting lists of more than one group. A group's centrality is the length of the lists
    # that it stands in; a list's leader is its most central group, for a group of copies
    # the one that most others resemble.
    everyone = W.partitionBy("token")
    listed = cut(
        groups.select("g", "lead", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
        .withColumn("many", F.count(F.lit(1)).over(everyone))
        .filter("many > 1")
    )
    central = listed.groupBy("g").agg((F.sum("many") / F.max("n")).alias("central"))
    shared = cut(listed.join(central, "g").withColumn("first", F.max(F.struct("central", "g", "lead", "n", "pos")).over(everyone)).drop("central", "many"))
    starred = shared.alias("x").filter(f"g <> first.g and {_may_link('x', 'first', percent)}").selectExpr("least(lead, first.lead) u", "greatest(lead, first.lead) v")
    inside = nodes.join(nodes.groupBy("g").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("many")).filter("many > 1"), "g")
    pairs = cut(_plausible(starred.unionByName(inside.filter("node <> lead").selectExpr("lead u", "node v")).distinct(), nodes, percent))
    links = _verified(pairs, nodes, docs, id_col, text_col, k, percent)
    parts = cut(connected_components(links))

    # What the leaders left apart: members of one list in different components.
    small = [f"b{j}" for j in range(MINI)]
    placed = nodes.join(parts, "node", "left").select("g", "node", "n", *small, F.coalesce("component", "node").alias("c"))
    lists = shared.select("g", "pos", "token").join(placed, "g")
    own = inside.select("node", "g", "n", *small).join(parts, "node", "left").select("g", F.lit(0).alias("pos"), F.col("g").alias("token"), "node", "n", *small, F.coalesce("component", "node").alias("c"))
    lists = lists.unionByName(own)
    sizes = lists.groupBy("token", "c").agg(F.count(F.lit(1)).alias("m"))
    mixed = sizes.groupBy("token").agg(F.max_by("c", F.struct("m", "c")).alias("big"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("token", "big")
    lists = cut(lists.join(mixed, "token"))
    a, b = lists.filter("c <> big").alias("a"), lists.alias("b")
    apart = " + ".join(f"bit_count(a.{w} ^ b.{w})" for w in small)
    rest = a.join(b, F.expr(f"a.token = b.token and a.c <> b.c and (b.c = b.big or a.node < b.node) and {_may_link('a', 'b', percent)} and {100 + percent} * ({apart}) <= {100 - percent} * (a.n + b.n)")).selectExpr("least(a.node, b.node) u", "greatest(a.node, b.node) v").distinct()
    rest = cut(_plausible(rest, nodes, percent).join(pairs, ["u", "v"], "left_anti"))
    if rest.isEmpty():
        return profiles, nodes, parts
    more = _verified(rest, nodes, docs, id_col, text_col, k, percent)
    stars = parts.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    return profiles, nodes, cut(connected_components(stars.unionByName(more)))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    profiles, nodes, parts = link_nodes(docs, id_col, text_col, k, percent)
    # Written first, so that a component of very many nodes is no group of the join's own stage, and a skewed join can be dealt anew.
    roots = cut(parts.join(nodes.select("node", "doc"), "node").groupBy("component").agg(F.min("doc").alias("root")))
    named = nodes.select("node", "doc").join(parts, "node", "left").join(roots, "component", "left").select("node", F.coalesce("root", "doc").alias("root"))
    return profiles.select("id", "n", "node").join(named, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows equal in id and text stay as one."""
    found = cut(jaccard_components(docs, id_col, text_col, k, percent))
    mine = F.col("component_id").eqNullSafe(F.col(id_col))
    gone = found.groupBy(F.col(id_col).alias("_gone")).agg(F.max(mine.cast("int")).alias("_stays")).filter("_stays = 0").select("_gone")
    if gone.count() <= DROPPED_ROWS:  # else the texts are shuffled to their ids
        gone = F.broadcast(gone)
    kept = docs.join(gone, F.col(id_col).eqNullSafe(F.col("_gone")), "left_anti")
    repeated = not found.filter(mine).groupBy(id_col).count().filter("count > 1").isEmpty()
    return kept.dropDuplicates([id_col, text_col]) if repeated else kept
