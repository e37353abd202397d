"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source and ranked; a row's
fractional rank is ``(2 * rank + 1) / (2 * rows of its source)``. Sorted by
fractional rank the sources interleave in proportion, so equal cuts of that
order give every shard the mixture of the whole, and shard sizes differ by one
row at most (law ``rows``).

Both rankings are distributed: a row's rank is the number of rows in the buckets
before its own plus its place inside the bucket. The first ranking has buckets
of the hash. The second has buckets of the fractional rank, and where very many
rows share one (a source of one row each gives all of them a half), such a
fraction is cut by the hash. So neither a source nor a shard nor a fraction is
sorted in one task; rows of one id and rows of null id, size and checksum are.
Only ids, sizes and checksums are shuffled, never texts.

Null text has size 8 and checksum 0; a null source is a source of its own; null
ids are hashed by size and checksum instead; repeated rows each get a place of
their own; an empty table gives an empty result. Texts are measured whole, of
any length. Columns other than the three named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

ROWS_PER_BUCKET = 50_000
#: Rows of one fractional rank from which on it is cut by the hash.
HEAVY_ROWS = 2_000


#: What orders the buckets of the second ranking.
BUCKET = ["fb", "seg", "hb"]


def _cut_fractions(ranked: DataFrame, n: int) -> DataFrame:
    """Ranked rows with their bucket: by fraction, then before, at or after those that very many rows share, then by hash where they do."""
    # Fewer fractions than a row in `heavy_rows`.
    heavy_rows = max(HEAVY_ROWS, n // 65536)
    heavy = ranked.groupBy("fb", "frac").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > heavy_rows).groupBy("fb").agg(F.array_sort(F.collect_list(F.struct("frac", "c"))).alias("heavy"))
    ranked = ranked.join(F.broadcast(heavy), "fb", "left")
    ranked = ranked.withColumn("own", F.expr("try_element_at(filter(heavy, x -> x.frac = frac), 1).c")).select(
        "id", "stratum", "size", "crc", "h", "frac", "fb",
        F.expr("coalesce(2 * size(filter(heavy, x -> x.frac < frac)) + if(own is null, 0, 1), 0)").alias("seg"),
        F.when(F.col("own").isNotNull(), F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.ceil(F.col("own") / heavy_rows) / F.lit(1 << 32))).otherwise(0).cast("int").alias("hb"),
    )
    return ranked


def interleave_shards(docs: DataFrame, shards: int = 24, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, source) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("stratum"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
    ).withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.concat_ws(":", F.lit(""), "size", "crc"))).cast("binary")))
    n = docs.count()
    buckets = 1 << max(6, min(16, (max(1, n) // ROWS_PER_BUCKET).bit_length()))
    rows = rows.withColumn("b", F.floor(F.conv(F.substring("h", 1, 4), 16, 10).cast("long") * buckets / 65536).cast("int"))

    inner = W.partitionBy("stratum", "b").orderBy("h", "id", "size", "crc")
    placed = rows.withColumn("k", F.row_number().over(inner))
    # Bucket counts, at most `buckets` rows a source, give the rows before each bucket.
    source = W.partitionBy("stratum")
    before = (
        rows.groupBy("stratum", "b").agg(F.count(F.lit(1)).alias("c"))
        .select("stratum", "b", (F.sum("c").over(source.orderBy("b").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")).alias("lead"), F.sum("c").over(source).alias("m"))
    )
    ranked = placed.join(before, ["stratum", "b"]).withColumn("frac", (2 * (F.col("lead") + F.col("k") - 1) + 1) / (2 * F.col("m")))
    ranked = ranked.select("id", "stratum", "size", "crc", "h", "frac", F.least(F.lit(buckets - 1), F.floor(F.col("frac") * buckets)).cast("int").alias("fb"))

    ranked = _cut_fractions(ranked, n)

    # `buckets` rows, and one for each `heavy_rows` rows: 200,000 by the bounds above.
    starts = ranked.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("c")).select(*BUCKET, (F.sum("c").over(W.orderBy(*BUCKET).rowsBetween(W.unboundedPreceding, 0)) - F.col("c")).alias("lead"))
    at = F.col("lead") + F.row_number().over(W.partitionBy(*BUCKET).orderBy("frac", "h", "id", "size", "crc")) - 1
    total = F.lit(n).cast("long")
    shard = F.floor(F.col("at") * shards / total).cast("long")
    return (
        ranked.join(F.broadcast(starts), BUCKET).withColumn("at", at)
        .withColumn("part", F.expr(f"(at * {shards}L) div {n}L") if n else shard)
        .select(
            F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("part").cast("int").alias("shard"),
            (F.col("at") - F.expr(f"(part * {n}L + {shards - 1}L) div {shards}L")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
            F.when(F.col("stratum") != "n", F.substring("stratum", 2, 1 << 30)).alias("source"),
        )
    )
