"""K-mer tables, votes and distances over rows of sequences or texts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import seq
from ..session import workers

#: Up to so many k-mers a library goes to the workers; beyond, windows are joined with it. Texts of more characters give up their windows as rows.
CARRIED, LONG_TEXT, BATCH = 500_000, 2_000_000, 20_000


def explode_windows(df: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """(id, at, kmer) of every window of ``k`` characters, from 0."""
    return df.select(F.col(id_col).alias("id"), F.posexplode(seq.windows(text, k)).alias("at", "kmer"))


def explode_kmers(df: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """(id, kmer) of the canonical k-mers over A, C, G, T."""
    return df.select(F.col(id_col).alias("id"), F.explode(seq.kmers(text, k)).alias("kmer")).select("id", seq.canonical("kmer").alias("kmer"))


def frequencies(kmers: DataFrame) -> DataFrame:
    """(kmer, n, share) over all rows; the total is one broadcast row."""
    counts = kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("kmer", "n", (F.col("n") / F.col("_t")).alias("share"))


def unambiguous(library: DataFrame) -> DataFrame:
    """(kmer, entry) of the k-mers that one entry alone holds, the entry without an id included; ``library`` is (id, kmer)."""
    alone = F.when(F.count("id") == 0, True).otherwise((F.count("id") == F.count(F.lit(1))) & (F.min("id") == F.max("id")))
    return library.groupBy("kmer").agg(F.min("id").alias("entry"), alone.alias("_one")).filter("_one").drop("_one")


def votes(queries: DataFrame, library: DataFrame) -> DataFrame:
    """(id, entry, hits, total, share): distinct k-mers of a query that name one entry."""
    own = queries.distinct()
    totals = own.groupBy("id").agg(F.count(F.lit(1)).alias("total"))
    hits = own.join(unambiguous(library), "kmer").groupBy("id", "entry").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(totals, "id").withColumn("share", F.col("hits") / F.col("total"))


def distinct_windows(df: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """(id, kmer) of the windows of each row, in one pass over its text; equal ones of a row once, unless the text is long."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("kmer", T.StringType())])

    def run(batches):
        for batch in batches:
            for i, t in enumerate(batch.column(1)):
                t = t.as_py()
                n = len(t) - k + 1
                windows = list({t[j : j + k] for j in range(n)}) if n <= LONG_TEXT else None
                for at in range(0, len(windows) if windows is not None else n, BATCH):
                    part = windows[at : at + BATCH] if windows is not None else [t[j : j + k] for j in range(at, min(n, at + BATCH))]
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(part)), pa.array(part, pa.string())], ["id", "kmer"])

    workers(df.sparkSession)
    return df.filter(F.length(text) >= k).select(id_col, text).mapInArrow(run, schema)


def text_votes(df: DataFrame, id_col: str, text: str, k: int, library: DataFrame) -> DataFrame:
    """``votes`` of whole texts' windows."""
    entry = library.schema["id"].dataType
    fields = [T.StructField("entry", entry), T.StructField("hits", T.LongType()), T.StructField("total", T.LongType())]

    def count(entries, total):
        return [(e, c, total) for e, c in Counter(entries).items()]

    found = _by_text(df, id_col, text, k, unambiguous(library), fields, count, lambda rows: votes(rows, library).select("id", "entry", "hits", "total"))
    return found.filter("id is not null").withColumn("share", F.col("hits") / F.col("total"))


def text_containment(df: DataFrame, id_col: str, text: str, k: int, background: DataFrame) -> DataFrame:
    """``containment`` of whole texts' windows."""
    fields = [T.StructField("held", T.LongType()), T.StructField("total", T.LongType())]
    known = background.select("kmer").distinct().withColumn("entry", F.lit(1))
    found = _by_text(df, id_col, text, k, known, fields, lambda entries, total: [(len(entries), total)], lambda rows: containment(rows, background).select("id", "held", "total"))
    return found.withColumn("containment", F.col("held") / F.col("total"))


def _points(t: str):
    return np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")


def _hashes(points, k: int):
    """A 64-bit hash of each window of ``k`` code points; equal windows have equal ones."""
    n = len(points) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += points[j : j + n]
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def distinct_starts(t: str, k: int):
    """Hashes and starts of the distinct windows of a text; windows of one hash are compared."""
    points = _points(t)
    h = _hashes(points, k)
    order = np.argsort(h)
    ranked = h[order]
    first = np.ones(len(h), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    again = np.flatnonzero(~first)
    a, b = order[again], order[again - 1]
    if any((points[a + j] != points[b + j]).any() for j in range(k)):  # two windows with one hash
        starts = np.array(sorted({t[j : j + k]: j for j in range(len(h))}.values()))
        return h[starts], starts
    return ranked[first], order[first]


def _by_text(df: DataFrame, id_col: str, text: str, k: int, table: DataFrame, fields: list, count, joined) -> DataFrame:
    """Counts over the distinct windows of each id: ``count`` (entries found, number of windows) where the text is read, ``joined`` (rows) as a join.

    Windows are counted where they are read if the table (kmer, entry) is of
    bounded size and the text not too long. Rows of an id that has several, and
    the other texts, give their windows as rows, which are joined.
    """
    rows = df.filter(F.length(text) >= k).select(F.col(id_col).alias("id"), F.col(text).alias("_t"))
    small = table.limit(CARRIED + 1).toArrow()  # bounded
    if small.num_rows > CARRIED:
        return joined(distinct_windows(rows, "id", "_t", k))
    held = dict(zip(small["kmer"].to_pylist(), small["entry"].to_pylist(), strict=True))
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *fields])

    def run(batches):
        known = shared.value
        sieve = np.zeros(1 << 23, bool)  # most windows are in no entry: their hashes are not here
        for kmer in known:
            sieve[_hashes(_points(kmer), k) >> np.uint64(41)] = True
        for batch in batches:
            at, out = [], []
            for i, t in enumerate(batch.column(1)):
                t = t.as_py()
                hashes, starts = distinct_starts(t, k)
                likely = (t[j : j + k] for j in starts[sieve[hashes >> np.uint64(41)]].tolist())
                found = count([known[w] for w in likely if w in known], len(starts))
                out += found
                at += [i] * len(found)
            columns = list(zip(*out, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], [f.name for f in schema])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]
    shared = workers(df.sparkSession).sparkContext.broadcast(held)
    # Ids with several rows, or a long text: counted from ids and lengths alone.
    apart = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.length("_t")).alias("_l")).filter((F.col("_n") > 1) | (F.col("_l") > LONG_TEXT)).select(F.col("id").alias("_id"))
    if apart.isEmpty():
        return rows.mapInArrow(run, schema)
    same = rows["id"].eqNullSafe(apart["_id"])
    return rows.join(apart, same, "left_anti").mapInArrow(run, schema).unionByName(joined(distinct_windows(rows.join(apart, same, "left_semi"), "id", "_t", k)))


def weighted_votes(parts: dict[int, DataFrame]) -> DataFrame:
    """(id, entry, support, rank) from votes at several k: shares weighted by k."""
    together = None
    for k, v in parts.items():
        piece = v.select("id", "entry", (F.col("share") * k).alias("_s"))
        together = piece if together is None else together.unionByName(piece)
    support = together.groupBy("id", "entry").agg((F.sum("_s") / sum(parts)).alias("support"))
    return support.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("support"), "entry")))


def containment(queries: DataFrame, background: DataFrame) -> DataFrame:
    """(id, held, total, containment): distinct k-mers of a query that the background has."""
    own = queries.distinct()
    known = background.select("kmer").distinct().withColumn("_in", F.lit(1))
    found = own.join(known, "kmer", "left").groupBy("id").agg(F.count("_in").alias("held"), F.count(F.lit(1)).alias("total"))
    return found.withColumn("containment", F.col("held") / F.col("total"))


def divergence(queries: DataFrame, background: DataFrame) -> DataFrame:
    """(id, jsd): base-2 Jensen-Shannon divergence of a query's k-mers from the background's shares.

    Only the query's k-mers are enumerated; background mass outside them adds half of itself.
    """
    counts = queries.groupBy("id", "kmer").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy("id"))
    both = counts.withColumn("p", p).join(frequencies(background).select("kmer", F.col("share").alias("q")), "kmer", "left").withColumn("q", F.coalesce("q", F.lit(0.0)))
    m = (F.col("p") + F.col("q")) / 2
    term = F.col("p") / 2 * F.log2(F.col("p") / m) + F.when(F.col("q") > 0, F.col("q") / 2 * F.log2(F.col("q") / m)).otherwise(0.0)
    return both.groupBy("id").agg((F.sum(term) + (1 - F.sum("q")) / 2).alias("jsd"))


def seed_diagonals(queries: DataFrame, targets: DataFrame, width: int = 8, most: int = 8) -> DataFrame:
    """(id, target, diagonal, support): shared windows grouped by binned diagonal, the best few of each pair of rows."""
    q = queries.select("id", F.col("at").alias("qa"), "kmer")
    t = targets.select(F.col("id").alias("target"), F.col("at").alias("ta"), "kmer")
    d = q.join(t, "kmer").groupBy("id", "target", F.floor((F.col("ta") - F.col("qa")) / width).alias("diagonal")).agg(F.count(F.lit(1)).alias("support"))
    w = W.partitionBy("id", "target").orderBy(F.desc("support"), "diagonal")
    return d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def longest_chain(hits: DataFrame, keys: list[str], at: str, k: int) -> DataFrame:
    """Longest stretch under consecutive hits of length k: keys, ``stretch``."""
    w = W.partitionBy(*keys).orderBy(at)
    runs = hits.select(*keys, at).distinct().withColumn("_g", F.col(at) - F.row_number().over(w))
    sizes = runs.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_n"))
    return sizes.groupBy(*keys).agg((F.max("_n") + k - 1).alias("stretch"))


def prefix_lookup(df: DataFrame, value: str, table: DataFrame, key: str, result: str, default: Column) -> DataFrame:
    """Adds ``result`` of the longest key that begins the value.

    ``table`` is a small dimension: its distinct key lengths become equi-joins
    on prefixes, so no nested loop is planned.
    """
    lengths = F.broadcast(table.select(F.length(key).alias("_len")).distinct().agg(F.sort_array(F.collect_set("_len")).alias("_lens")))  # one row of a dimension's key lengths
    spread = df.withColumn("_row", F.monotonically_increasing_id()).crossJoin(lengths)
    tried = spread.select("*", F.explode("_lens").alias("_l")).withColumn("_k", F.substring(F.col(value), F.lit(1), F.col("_l"))).filter(F.length("_k") == F.col("_l"))
    hits = tried.join(table.select(F.col(key).alias("_k"), F.col(result).alias("_v")), "_k").groupBy("_row").agg(F.max_by("_v", "_l").alias(result))
    return spread.drop("_lens").join(hits, "_row", "left").withColumn(result, F.coalesce(result, default)).drop("_row")
