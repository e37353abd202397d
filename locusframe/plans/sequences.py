"""Sequence, k-mer and parsing operators as queries over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import seq
from ..operators import kmers
from ..session import table
from .registry import query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark")


_W = "unnest(list_transform(range(1, len(text) - {k} + 2), lambda i: substr(text, i, {k})))"


@query(f"""SELECT kmer, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM (SELECT {_W.format(k=5)} AS kmer FROM benchmark WHERE len(text) >= 5) GROUP BY kmer""")
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of the 5-character windows of the benchmark."""
    return kmers.frequencies(kmers.explode_windows(_bench(spark, sf_dir), "item_id", "text", 5)).withColumn("share", F.round("share", 9))


@query("""SELECT item_id, (len(text) - 4)::BIGINT AS total, len(list_distinct(list_transform(range(1, len(text) - 3), lambda i: substr(text, i, 5))))::BIGINT AS uniq, round(uniq / total, 9) AS uniqueness FROM benchmark WHERE len(text) >= 5""")
def kmer_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct share of each item's windows."""
    w = seq.windows("text", 5)
    rows = _bench(spark, sf_dir).filter(F.length("text") >= 5).select("item_id", F.size(w).cast("long").alias("total"), F.size(F.array_distinct(w)).cast("long").alias("uniq"))
    return rows.withColumn("uniqueness", F.round(F.col("uniq") / F.col("total"), 9))


@query(f"""WITH b AS (SELECT DISTINCT {_W.format(k=12)} AS kmer FROM benchmark WHERE len(text) >= 12), d AS (SELECT DISTINCT doc_id, {_W.format(k=12)} AS kmer FROM documents WHERE len(text) >= 12)
SELECT doc_id AS id, count(b.kmer)::BIGINT AS held, count(*)::BIGINT AS total, round(count(b.kmer) / count(*), 9) AS containment FROM d LEFT JOIN b USING (kmer) GROUP BY 1""")
def kmer_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each document's windows that the benchmark has."""
    background = kmers.distinct_windows(_bench(spark, sf_dir), "item_id", "text", 12)
    return kmers.text_containment(_docs(spark, sf_dir), "doc_id", "text", 12, background).withColumn("containment", F.round("containment", 9))


@query(f"""WITH b AS (SELECT kmer, count(*) / sum(count(*)) OVER () AS q FROM (SELECT {_W.format(k=3)} AS kmer FROM benchmark WHERE len(text) >= 3) GROUP BY kmer),
c AS (SELECT item_id, kmer, count(*) AS n FROM (SELECT item_id, {_W.format(k=3)} AS kmer FROM benchmark WHERE len(text) >= 3) GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY item_id) AS p FROM c),
j AS (SELECT item_id, p, coalesce(q, 0) AS q FROM p LEFT JOIN b USING (kmer))
SELECT item_id AS id, round(sum(p / 2 * log2(p / ((p + q) / 2)) + CASE WHEN q > 0 THEN q / 2 * log2(q / ((p + q) / 2)) ELSE 0 END) + (1 - sum(q)) / 2, 6) AS jsd FROM j GROUP BY 1""")
def kmer_jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of each item's windows from those of the whole benchmark."""
    rows = kmers.explode_windows(_bench(spark, sf_dir), "item_id", "text", 3).select("id", "kmer")
    return kmers.divergence(rows, rows).withColumn("jsd", F.round("jsd", 6))


@query(f"""WITH l AS (SELECT kmer, min(item_id) AS entry FROM (SELECT DISTINCT item_id, {_W.format(k=16)} AS kmer FROM benchmark WHERE len(text) >= 16) GROUP BY 1 HAVING count(*) = 1),
q AS (SELECT DISTINCT doc_id, {_W.format(k=16)} AS kmer FROM documents WHERE len(text) >= 16), t AS (SELECT doc_id, count(*) AS total FROM q GROUP BY 1), h AS (SELECT doc_id, entry, count(*) AS hits FROM q JOIN l USING (kmer) GROUP BY 1, 2)
SELECT doc_id AS id, entry, hits::BIGINT AS hits, total::BIGINT AS total, round(hits / total, 9) AS share FROM h JOIN t USING (doc_id)""")
def kmer_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of documents' windows for the one item that holds them."""
    library = kmers.distinct_windows(_bench(spark, sf_dir), "item_id", "text", 16)
    return kmers.text_votes(_docs(spark, sf_dir), "doc_id", "text", 16, library).withColumn("share", F.round("share", 9))


@query(f"""WITH l AS (SELECT item_id, generate_subscripts(w, 1) - 1 AS ta, unnest(w) AS kmer FROM (SELECT item_id, list_transform(range(1, len(text) - 9), lambda i: substr(text, i, 11)) AS w FROM benchmark WHERE len(text) >= 11)),
d AS (SELECT a.item_id AS id, b.item_id AS target, floor((b.ta - a.ta) / 8.0)::BIGINT AS diagonal, count(*) AS support FROM l a JOIN l b USING (kmer) GROUP BY 1, 2, 3)
SELECT id, target, diagonal, support::BIGINT AS support FROM (SELECT *, row_number() OVER (PARTITION BY id, target ORDER BY support DESC, diagonal) AS r FROM d) WHERE r <= 8""")
def seed_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared 11-character seeds of items by diagonal."""
    w = kmers.explode_windows(_bench(spark, sf_dir), "item_id", "text", 11)
    return kmers.seed_diagonals(w, w).select("id", "target", F.col("diagonal").cast("long").alias("diagonal"), "support")


_ENTROPY = " + ".join(f"CASE WHEN {c} > 0 THEN -({c} / total) * log2({c} / total) ELSE 0 END" for c in ("na", "nc", "ng", "nt"))


@query(f"""WITH c AS (SELECT doc_id, (len(t) - len(replace(t, 'a', '')))::DOUBLE AS na, (len(t) - len(replace(t, 'c', '')))::DOUBLE AS nc, (len(t) - len(replace(t, 'g', '')))::DOUBLE AS ng, (len(t) - len(replace(t, 't', '')))::DOUBLE AS nt FROM (SELECT doc_id, lower(text) AS t FROM documents)), s AS (SELECT *, na + nc + ng + nt AS total FROM c)
SELECT doc_id, round(CASE WHEN total > 0 THEN {_ENTROPY} ELSE 0 END, 6) AS entropy, round((na + nt) / nullif(total, 0), 6) AS at_fraction, round((ng + nc) / nullif(total, 0), 6) AS gc_fraction FROM s""")
def text_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy and composition over four letters of each document."""
    t = F.upper(F.regexp_replace(F.lower("text"), "[^acgt]", ""))
    rows = _docs(spark, sf_dir).select("doc_id", t.alias("t"))
    return rows.select("doc_id", F.round(seq.entropy("t"), 6).alias("entropy"), F.round(seq.letter_fraction("t", "AT"), 6).alias("at_fraction"), F.round(seq.letter_fraction("t", "GC"), 6).alias("gc_fraction"))


@query("""WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM benchmark WHERE len(text) > 0), f AS (SELECT *, CASE WHEN c = lag(c) OVER (PARTITION BY item_id ORDER BY i) THEN 0 ELSE 1 END AS o FROM c), g AS (SELECT *, sum(o) OVER (PARTITION BY item_id ORDER BY i) AS k FROM f), r AS (SELECT item_id, k, count(*) AS n FROM g GROUP BY 1, 2)
SELECT item_id, max(n)::INT AS longest_run FROM r GROUP BY 1""")
def homopolymer_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of one character in each item."""
    return _bench(spark, sf_dir).filter("length(text) > 0").select("item_id", seq.longest_run(F.regexp_replace("text", r"[\r\n]", "\t")).alias("longest_run"))


@query("""WITH t AS (SELECT item_id, translate(text, 'acgt', 'ACGT') AS s FROM benchmark), r AS (SELECT item_id, reverse(translate(regexp_replace(s, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) AS rc FROM t)
SELECT item_id, md5(rc) AS rc_md5, least(md5(rc), md5(rc || 'x')) AS low FROM r""")
def revcomp_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse complements of items taken as sequences."""
    rc = seq.reverse_complement(F.translate("text", "acgt", "ACGT"))
    return _bench(spark, sf_dir).select("item_id", F.md5(rc.cast("binary")).alias("rc_md5"), F.least(F.md5(rc.cast("binary")), F.md5(F.concat(rc, F.lit("x")).cast("binary"))).alias("low"))


@query("""WITH p AS (SELECT p_partkey, p_name, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS other FROM part)
SELECT p_partkey, round(CASE WHEN greatest(len(p_name), len(other)) > 0 THEN 1 - levenshtein(p_name, other) / greatest(len(p_name), len(other)) ELSE 1 END, 6) AS identity FROM p WHERE other IS NOT NULL""")
def edit_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit identity of neighbouring part names of a brand."""
    other = F.lead("p_name").over(W.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", other.alias("other")).filter("other is not null").select("p_partkey", F.round(seq.edit_identity("p_name", "other"), 6).alias("identity"))


@query("""WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT l_partkey)) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1), n AS (SELECT *, lead(o_custkey) OVER (ORDER BY o_custkey) AS other_key, lead(parts) OVER (ORDER BY o_custkey) AS other FROM s)
SELECT o_custkey, other_key, len(list_intersect(parts, other))::INT AS shared, (len(parts) + len(other) - len(list_intersect(parts, other)))::INT AS united, round(len(list_intersect(parts, other)) / (len(parts) + len(other) - len(list_intersect(parts, other))), 9) AS jaccard FROM n WHERE other_key = o_custkey + 1""")
def support_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard of the parts of customers with consecutive keys, as an equi-join."""
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    s = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).groupBy("o_custkey").agg(F.collect_set("l_partkey").alias("parts"))
    t = s.select(F.col("o_custkey").alias("other_key"), F.col("parts").alias("other"), (F.col("other_key") - 1).alias("o_custkey"))
    j = s.join(t, "o_custkey").withColumn("shared", F.size(F.array_intersect("parts", "other"))).withColumn("united", F.size("parts") + F.size("other") - F.col("shared"))
    return j.select("o_custkey", "other_key", "shared", "united", F.round(F.col("shared") / F.col("united"), 9).alias("jaccard"))


@query("""WITH k AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS key, 'material' AS kind FROM part UNION SELECT DISTINCT split_part(p_type, ' ', 1) || ' ' || split_part(p_type, ' ', 2), 'finish' FROM part WHERE p_size > 40)
SELECT p_partkey, coalesce((SELECT arg_max(kind, len(key)) FROM k WHERE starts_with(p_type, key) AND len(key) > 0), 'none') AS kind FROM part""")
def longest_prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of each part by the longest key that begins its type."""
    part = table(spark, sf_dir, "part")
    words = F.split("p_type", " ")
    one = part.select(words[0].alias("key"), F.lit("material").alias("kind"))
    two = part.filter("p_size > 40").select(F.concat_ws(" ", words[0], F.coalesce(F.get(words, F.lit(1)), F.lit(""))).alias("key"), F.lit("finish").alias("kind"))
    keys = one.unionByName(two).filter("length(key) > 0").distinct()
    return kmers.prefix_lookup(part.select("p_partkey", "p_type"), "p_type", keys, "key", "kind", F.lit("none")).select("p_partkey", "kind")


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page_no, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages""")
def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the pages' addresses."""
    x = lambda pattern: F.regexp_extract("url", pattern, 1)
    return table(spark, sf_dir, "pages").select("page_id", x("^([a-z]+)://").alias("scheme"), x("^[a-z]+://([^/?#]+)").alias("host"), x("[?&]page=([0-9]+)").alias("page_no"), x("#(.*)$").alias("fragment"))


@query("""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p[ >]'))::INT AS paragraphs FROM pages""")
def html_header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, title and paragraphs of pages by patterns."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p[ >]")).alias("paragraphs"))


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.page'), 'NA') AS page, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events""")
def latest_ledger_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields of the events' JSON with defaults for what is missing."""
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.page"), F.lit("NA")).alias("page"), F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') as bigint)"), F.lit(-1)).alias("k"))
