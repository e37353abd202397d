"""The stateful scan against plain loops."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from locusframe.streaming import scan

SCHEMA = "chrom string, pos bigint, end bigint, name string"
LENGTHS = {"b": 95, "a": 60, "z": 10}


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    scan.keep_state_in_rocksdb(spark)
    yield spark
    spark.conf.set(key, before)


def fold(key, rows):
    return pd.DataFrame({"chrom": [key[0]], "bin": [key[1]], "names": [",".join(rows["name"])]})


def stream_of(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_contigs_lie_on_one_line(spark):
    assert scan.contig_starts({"x": 20, "y": 21, "w": 0, "v": 1}, 10) == {"x": 0, "y": 20, "w": 50, "v": 50}
    rows = spark.createDataFrame([("a", 5, 6, "p"), ("?", 5, 6, "q"), (None, 5, 6, "r"), ("a", None, 6, "s")], SCHEMA)
    assert [r[0] for r in rows.orderBy("name").select(scan.on_one_line("chrom", "pos", {"a": 100})).collect()] == [105, None, None, None]


def test_bins_close_once_over_contigs(rocksdb, tmp_path):
    """Bins over two contigs in file order, rows of one bin in two batches, a late row, and bins that stay open."""
    batches = [
        [("b", 3, 25, "r1"), ("b", 12, 13, "r2"), ("b", 12, None, "r3"), ("b", None, 9, "r0"), ("?", 1, 2, "r-")],
        [("b", 14, 41, "r4"), ("b", 55, 50, "r5")],
        [("b", 2, 90, "late"), ("b", 90, 94, "r6")],
        [("a", 1, 12, "r7"), ("a", 8, 9, "r8")],
        [("z", 0, 1, "end")],
    ]
    stream = scan.closed_bins(stream_of(rocksdb, tmp_path / "in", batches), "chrom", "pos", "end", LENGTHS, 10, 5, ["pos", "name"], fold, "chrom string, bin bigint, names string")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert scan.run_while(query, lambda n: True) == 12
    got = sorted(tuple(r) for r in rocksdb.read.parquet(str(tmp_path / "out")).select("chrom", "bin", "names").collect())
    want = {}
    for chrom, pos, end, name in (r for b in batches for r in b):
        if chrom in LENGTHS and pos is not None and name not in ("late", "end"):
            for k in range(pos // 10, max(pos, end or pos) // 10 + 1):
                want.setdefault((chrom, k), []).append((pos, name))
    assert got == sorted((c, k, ",".join(n for _, n in sorted(v))) for (c, k), v in want.items())


def test_scan_stops_early_and_tallies(rocksdb, tmp_path):
    batches = [[("b", i, i + 1, f"{i}-{j}") for j in range(4)] for i in range(6)]
    stream = scan.tallied(stream_of(rocksdb, tmp_path / "in", batches), "gate", F.col("name").endswith("0"))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert scan.run_while(query, lambda n: True, 0.2) == 24
    tallies = [p.observedMetrics["gate"] for p in query.recentProgress if "gate" in p.observedMetrics]
    assert (sum(t["total"] for t in tallies), sum(t["passed"] for t in tallies)) == (24, 6)
    assert rocksdb.read.parquet(str(tmp_path / "out")).count() == 6
    again = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp2")).trigger(processingTime="1 second").start()
    scan.run_while(again, lambda n: n < 4, 0.2)
    assert not again.isActive
