"""Token counts as delta-maintained rollups.

A change is a signed row: +1 inserts a document's count, -1 takes one back; a
revised count is the old row with -1 and the new with +1. Totals by source,
language and tokenizer version are sums of signs, of signed tokens and of
signed bytes, so batches add up in any order and nothing already counted is
read again.

A batch is committed by writing its summed delta beside the others and renaming
the folder to the batch's name, which fails if the name is taken: of two
writers of one batch, one commits it. A batch that is already committed is
skipped, and one whose writing was cut short is written again, so redelivery
changes nothing. Names begin with a letter or digit and hold letters, digits,
dots, dashes and underscores; others are refused.

``compact`` folds committed deltas into a base, which counts only once it is
whole and lists the batches that it holds. Folded deltas and the base before it
stay until the next ``compact``, so readers that began earlier come to an end;
one process compacts at a time. The driver sees the names of the deltas since
the last two compactions, never all names.

Null sources and languages are groups of their own. Changes with a null sign or
count are rejected by an error when the batch is applied. Groups that come down
to no documents and no tokens are not listed. An empty batch commits an empty
delta, and an empty corpus has no totals. Texts are counted whole, of any
length; columns other than source, lang and text are ignored.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .bpe import count_tokens
from .common import cut, prepare

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_bytes")
#: Words, and words with punctuation marks apart: patterns that Java and RE2 read alike.
WORDS = r"[^\x20\x09-\x0D]+"
MARKS = r"[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]"


def count_matches(text: Column, pattern: str) -> Column:
    """Matches of a pattern in a text; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def changes(rows: DataFrame, tokens: Column, tokenizer: str, sign: int) -> DataFrame:
    """Signed changes for counted documents (source, lang, bytes), with ``tokens`` each."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("sign"), tokens.cast("long").alias("tokens"), F.col("bytes").cast("long").alias("bytes"))


class TokenRollup:
    """Totals kept as committed deltas in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(conf)
        self._names = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    @classmethod
    def temporary(cls, spark: SparkSession) -> TokenRollup:
        """A rollup of its own in the checkpoint folder."""
        prepare(spark)
        return cls(spark, f"{spark.sparkContext.getCheckpointDir()}/rollup-{uuid.uuid4().hex}")

    def _committed(self, kind: str) -> list[str]:
        if not self._fs.exists(self._path(kind)):
            return []
        names = (x.getPath().getName() for x in self._fs.listStatus(self._path(kind)))
        return sorted(n for n in names if self._fs.exists(self._path(kind, n, "_SUCCESS")))

    def _base(self) -> str | None:
        """Name of the newest whole base."""
        return (self._committed("base") or [None])[-1]

    def _folded(self) -> DataFrame:
        """Names of the batches in the base."""
        base = self._base()
        return self.spark.read.parquet(f"{self.path}/base/{base}/batches") if base else self.spark.createDataFrame([], "batch string")

    def _listed(self, deltas: list[str]) -> DataFrame:
        return self._folded().unionByName(self.spark.createDataFrame([(n,) for n in deltas], "batch string")).distinct()

    def batches(self) -> list[str]:
        """Names of the committed batches, for reports: all of them come to the driver."""
        return sorted(r[0] for r in self._listed(self._committed("delta")).collect())

    def committed(self, batch: str) -> bool:
        """Whether a batch is committed."""
        return self._fs.exists(self._path("delta", batch, "_SUCCESS")) or not self._folded().filter(F.col("batch") == batch).isEmpty()

    def apply(self, batch: str, signed: DataFrame) -> bool:
        """Commit a batch of signed changes; False if it was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError(f"a batch's name begins with a letter or digit and may hold letters, digits, dots, dashes and underscores: {batch!r}")
        if self.committed(batch):
            return False
        tokens = F.when(F.col("sign").isNull() | F.col("tokens").isNull(), F.raise_error(F.lit("a change without sign or tokens"))).otherwise(F.col("sign") * F.col("tokens"))
        delta = signed.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(tokens).alias("n_tokens"), F.sum(F.col("sign") * F.coalesce("bytes", F.lit(0))).alias("n_bytes"))
        attempt = self._path("attempts", uuid.uuid4().hex)
        delta.write.parquet(attempt.toString())
        self._fs.mkdirs(self._path("delta"))
        if not self._fs.exists(self._path("delta", batch, "_SUCCESS")):
            self._fs.delete(self._path("delta", batch), True)  # what an interrupted writer left
        try:
            self._names.rename(attempt, self._path("delta", batch), self._no_options)
        except Py4JJavaError:
            self._fs.delete(attempt, True)
            if not self.committed(batch):
                raise
            return False
        return True

    def _parts(self, deltas: list[str] | None = None) -> DataFrame | None:
        base, deltas = self._base(), self._committed("delta") if deltas is None else deltas
        folded = {r[0] for r in self._folded().filter(F.col("batch").isin(deltas)).collect()} if deltas else set()
        paths = [f"{self.path}/base/{base}/totals"] if base else []
        paths += [f"{self.path}/delta/{b}" for b in deltas if b not in folded]
        return self.spark.read.parquet(*paths) if paths else None

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_bytes) over all committed batches."""
        return self._summed(self._parts())

    def _summed(self, parts: DataFrame | None) -> DataFrame:
        if parts is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_bytes bigint")
        summed = parts.groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS))
        return summed.filter(" or ".join(f"{c} <> 0" for c in SUMS))

    def compact(self) -> None:
        """Fold all committed deltas into a new base; what the base before it had folded goes after it is whole."""
        old, deltas = self._committed("base"), self._committed("delta")  # one list of deltas: a batch committed meanwhile is not in the base
        stale = [r[0] for r in self._folded().filter(F.col("batch").isin(deltas)).collect()]
        name = f"{len(old) and int(old[-1]) + 1 or 1:08d}"
        where = f"{self.path}/base/{name}"
        self._summed(self._parts(deltas)).write.mode("overwrite").parquet(f"{where}/totals")
        self._listed(deltas).write.mode("overwrite").parquet(f"{where}/batches")
        self._fs.create(self._path("base", name, "_SUCCESS"), True).close()
        for b in stale:
            self._fs.delete(self._path("delta", b), True)
        for b in old[:-1]:
            self._fs.delete(self._path("base", b), True)


#: Version of the byte-level BPE counts, and of the counts of words.
BPE, WORD = "byte_bpe_50k", "words-1"
#: Documents with fewer words leave the corpus for a while.
LEAST_WORDS = 20
#: What is cleaned before counts are revised.
NOISE = r"[#$%&*!|]+"


def token_totals(docs: DataFrame, rollup: TokenRollup, ranks_path: str, pattern: str) -> DataFrame:
    """Totals of every document's whole text in BPE tokens and in words, by way of batches that insert, delete and revise.

    Texts are read once: their counts are stored, and all batches come from them.
    BPE counts are inserted as estimates (four bytes a token) and revised to the
    real ones; short documents are deleted and come back. Two batches are
    delivered twice.
    """
    words = count_matches(F.col("text"), WORDS)
    counted = cut(count_tokens(docs.select("source", "lang", words.alias("words"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), "text"), ranks_path, pattern))
    guess, real, words = F.ceil(F.col("bytes") / 4), F.col("n_tokens"), F.col("words")
    short, rest = counted.filter(words < LEAST_WORDS), counted.filter(words >= LEAST_WORDS)
    batches = {
        "insert": changes(counted, guess, BPE, 1).unionByName(changes(counted, words, WORD, 1)),
        "delete-short": changes(short, guess, BPE, -1).unionByName(changes(short, words, WORD, -1)),
        "revise": changes(rest, guess, BPE, -1).unionByName(changes(rest, real, BPE, 1)),
        "restore-short": changes(short, real, BPE, 1).unionByName(changes(short, words, WORD, 1)),
    }
    for name in ("insert", "delete-short", "insert", "revise", "delete-short", "restore-short"):
        rollup.apply(name, batches[name])
    rollup.compact()
    return rollup.totals()


def _counted(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return cut(docs.select(
        "source", "lang", F.coalesce(F.octet_length(text), F.lit(0)).alias("bytes"), count_matches(text, WORDS).alias("words"), count_matches(text, MARKS).alias("marks"),
        count_matches(F.regexp_replace(text, NOISE, " "), WORDS).alias("cleaned"),
    ))


def _corpus_batches(counted: DataFrame) -> dict[str, DataFrame]:
    """Signed changes of the four batches of ``corpus_totals`` by name."""
    words, marks, cleaned = F.col("words"), F.col("marks"), F.col("cleaned")
    short = words < LEAST_WORDS
    return {
        "insert-words": changes(counted, words, "words-1", 1),
        "insert-marks": changes(counted, marks, "marks-1", 1),
        "delete-short": changes(counted.filter(short), words, "words-1", -1).unionByName(changes(counted.filter(short), marks, "marks-1", -1)),
        "revise-words": changes(counted.filter(~short), words, "words-1", -1).unionByName(changes(counted.filter(~short), cleaned, "words-1", 1)),
    }


def corpus_totals(docs: DataFrame, rollup: TokenRollup) -> DataFrame:
    """Totals after four batches over a whole corpus, two of which are delivered twice.

    All documents are counted in words and in marks; documents under
    ``LEAST_WORDS`` words are deleted; the words of the rest are revised after
    cleaning runs of noise characters.
    """
    _cleaned(_corpus_batches(_counted(docs)), rollup)
    return rollup.totals()


def _cleaned(batches: dict[str, DataFrame], rollup: TokenRollup) -> None:
    for name, signed in batches.items():
        rollup.apply(name, signed)
    for name in ("delete-short", "insert-words"):
        rollup.apply(name, batches[name])
    rollup.compact()


def whole_corpus_totals(docs: DataFrame, rollup: TokenRollup) -> DataFrame:
    """Totals of every document's whole text in words and marks: the batches of ``corpus_totals``, then the inverse of its deletion and revision."""
    batches = _corpus_batches(_counted(docs))
    _cleaned(batches, rollup)
    for name in ("delete-short", "revise-words"):
        rollup.apply(f"undo-{name}", batches[name].withColumn("sign", -F.col("sign")))
    rollup.compact()
    return rollup.totals()
