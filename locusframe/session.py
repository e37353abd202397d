"""Session settings, and the driver tables as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, **more: str) -> SparkSession:
    """A session with the settings that results rely on (UTC) and plans profit from (AQE)."""
    builder = SparkSession.builder.appName("locusframe")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workers(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers, for functions that run there."""
    import os
    from pathlib import Path

    root, sc = str(Path(__file__).resolve().parents[1]), spark.sparkContext
    known = sc.environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Driver tables as temporary views."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def settle(df: DataFrame) -> DataFrame:
    """Compute once what several branches of a plan read: in the checkpoint folder where there is one, else persisted."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()
