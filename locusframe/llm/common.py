"""What the corpus operators share: table access, lineage cuts, and column hygiene.

Nothing here touches a machine-local path on a cluster: lineage is cut with
``checkpoint()`` into the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Folder that holds the package, for Python workers started elsewhere.
ROOT = str(Path(__file__).resolve().parents[2])

#: Rows of an Arrow batch that goes to a Python worker.
ROWS_PER_BATCH = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers, name a checkpoint folder, and keep Arrow batches small.

    ``spark.checkpoint.dir`` is read from the session. Only a local session
    without one (tests) gets a temporary folder; a cluster without one is an
    error, since executors could not share it.
    """
    sc = spark.sparkContext
    # Texts are long: ten thousand of them at once, in the JVM and in Python, are the memory peak of every stage.
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    known = sc.environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="locusframe-checkpoint-")
        sc.setCheckpointDir(named)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_of_id(id_col: Column) -> Column:
    """crc32 of an id written as text; null ids give null."""
    return F.crc32(id_col.cast("string").cast("binary"))


def held_out(id_col: Column) -> Column:
    """True for ids whose crc32 as text leaves 2 modulo 4; such rows are never learned from."""
    return F.coalesce(crc_of_id(id_col) % 4 == 2, F.lit(False))


def learnable(id_col: Column) -> Column:
    """True for ids that may be learned from; null ids may not."""
    return F.coalesce(crc_of_id(id_col) % 4 != 2, F.lit(False))


def filter_batches(docs: DataFrame, column: str, mask) -> DataFrame:
    """Rows of ``docs`` for which ``mask(column of a batch)`` is true; all columns pass unchanged, nothing is shuffled."""
    at = docs.columns.index(column)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(mask(batch.column(at))))

    return docs.mapInArrow(run, docs.schema)
