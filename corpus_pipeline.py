"""The corpus pipeline: ``documents`` through five stages, each on what the one before kept.

Every stage but the last returns the columns of ``documents``; each stage's
result is written as Parquet in the shared checkpoint folder and read again as
the next one's documents.
"""

from __future__ import annotations

import uuid

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from locusframe.llm import langid, toxicity
from locusframe.llm.bpe import encode_documents
from locusframe.llm.common import filter_batches, prepare, read_table
from locusframe.llm.decontam import drop_leaks
from locusframe.llm.ngram_join import keep_one_per_component
from locusframe.llm.text import row_blocks, utf8

#: From this score on a document is toxic.
TOXIC = 0.3
#: Bits a character under the nearest learned language beyond which a text is in none of them.
MOST_BITS = 5.7
#: Letters from which on a text is long enough to be told so.
LEAST_LETTERS = 100


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, by the prediction.

    Null texts and texts without a letter go, and so do texts of ``LEAST_LETTERS``
    letters or more whose cross-parsing entropy is over ``MOST_BITS`` under every
    learned language. If no document has a usable label, nothing can be told and
    every text with a letter stays.
    """
    shared = prepare(spark).sparkContext.broadcast(langid.fit(docs))

    def speaks(column: pa.Array) -> np.ndarray:
        keep = np.zeros(len(column), bool)
        for start in range(0, len(column), 2048):
            texts = column.slice(start, 2048).to_pylist()
            if not shared.value.languages:
                keep[start : start + len(texts)] = [langid.letters(t) > 0 for t in texts]
                continue
            lang, _, bits = shared.value.predict(texts)
            keep[start : start + len(texts)] = [p != "und" and (b <= MOST_BITS or langid.letters(t) < LEAST_LETTERS) for p, b, t in zip(lang, bits, texts, strict=True)]
        return keep

    return filter_batches(docs, "text", speaks)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; the model learns from the documents that are left and their labels."""
    shared = prepare(spark).sparkContext.broadcast(toxicity.fit(docs, read_table(spark, sf_dir, "labels")))

    def clean(column: pa.Array) -> np.ndarray:
        data, offsets = utf8(column)
        keep = np.ones(len(column), bool)
        for start, end in row_blocks(offsets):
            low = offsets[start]
            keep[start:end] = shared.value.score(data[low : offsets[end]], offsets[start : end + 1] - low)[0] < TOXIC
        return keep

    return filter_batches(docs, "text", clean)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle sets of similarity 0.8 or more: the one of smallest id."""
    return keep_one_per_component(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to half or more."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"), k=5, coverage=0.5)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with the digests of their round trip."""
    prepare(spark)
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("language ID", language_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", encoding_stage),
]

#: Trained scores and BPE merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
