"""The corpus queries, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import langid, quality, toxicity
from .bpe import encode_documents
from .common import held_out, prepare, read_table
from .decontam import find_leaks
from .html import extract_pages
from .neardup import near_duplicates
from .ngram_join import jaccard_components
from .rollup import TokenRollup, token_totals, whole_corpus_totals
from .sharding import interleave_shards

RANKS = "byte_bpe_50k.tiktoken"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return interleave_shards(read_table(spark, sf_dir, "documents"), shards=24)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_totals(read_table(spark, sf_dir, "documents"), TokenRollup.temporary(spark), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of op4 over counts that SQL can make: words, and words with punctuation marks apart."""
    return whole_corpus_totals(read_table(spark, sf_dir, "documents"), TokenRollup.temporary(spark))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard_components(read_table(spark, sf_dir, "documents"), k=5, percent=80)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "entropy")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    found = toxicity.score_documents(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")), threshold=0.3)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=5, coverage=0.5)
    return found.drop("tiles")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    found = quality.score_documents(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")), threshold=0.7)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_bpe": op2_bpe,
    "op3_embedding_neardup": op3_embedding_neardup,
    "op4_token_counts": op4_token_counts,
    "rollup_words": rollup_words,
    "op5_html_extraction": op5_html_extraction,
    "op6_ngram_join": op6_ngram_join,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE: dict[str, str] = {
    # crc32 over the bytes by its table, made by eight shifts of every byte value.
    "op1_sharding": """
WITH RECURSIVE steps(b, k, c) AS (SELECT range, 0, range FROM range(0, 256) UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
x AS (SELECT *, md5('mix-1:' || coalesce(doc_id::VARCHAR, ':' || size || ':' || crc)) AS h FROM (SELECT doc_id, source, strlen(text) + 8 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * strlen(text), 2), lambda i: ('0x' || substr(hex(encode(text)), i, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)::BIGINT AS crc FROM d, crc)),
r AS (SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, crc) - 1) + 1) / (2 * count(*) OVER (PARTITION BY source)) AS frac FROM x),
p AS (SELECT *, row_number() OVER (ORDER BY frac, h, doc_id, size, crc) - 1 AS place, count(*) OVER () AS n FROM r)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, (place * 24 // n)::INT AS shard, (place - ((place * 24 // n) * n + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard, source FROM p""",
    "op3_embedding_neardup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id), m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM m""",
    # op4's BPE counts are beyond SQL; this is its rollup over counts that are not.
    "rollup_words": r"""
WITH w AS (SELECT source, lang, coalesce(strlen(text), 0) AS bytes, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words, coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]')), 0) AS marks FROM documents)
SELECT source, lang, 'words-1' AS tokenizer, count(*)::BIGINT AS n_docs, sum(words)::BIGINT AS n_tokens, sum(bytes)::BIGINT AS n_bytes FROM w GROUP BY 1, 2
UNION ALL SELECT source, lang, 'marks-1', count(*)::BIGINT, sum(marks)::BIGINT, sum(bytes)::BIGINT FROM w GROUP BY 1, 2""",
    "op6_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2, 3, 4),
l AS (SELECT a, b FROM c WHERE 100 * k >= 80 * (n + m - k)), r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, any_value(len(s))::BIGINT AS n_shingles, min(c) AS component_id FROM r JOIN s USING (doc_id) GROUP BY doc_id""",
}
