"""Signals along a coordinate as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import signal
from ..session import table
from .registry import query
from .views import EVENTS_SQL, days, events

_SMOOTH_SQL = f"""{EVENTS_SQL}, h AS (SELECT event_type, t // 3600 AS cell, sum(1.0) AS mass FROM ev GROUP BY 1, 2), s AS (SELECT event_type, min(cell) AS a, max(cell) AS b FROM h GROUP BY 1),
g AS (SELECT event_type, unnest(range(a, b + 1)) AS cell FROM s), d AS (SELECT g.event_type, g.cell, coalesce(mass, 0.0)::DOUBLE AS mass FROM g LEFT JOIN h USING (event_type, cell)),
m AS (SELECT *, 0.25 * coalesce(lag(mass, 2) OVER w, 0) + 0.6 * coalesce(lag(mass, 1) OVER w, 0) + mass + 0.6 * coalesce(lead(mass, 1) OVER w, 0) + 0.25 * coalesce(lead(mass, 2) OVER w, 0) AS smoothed FROM d WINDOW w AS (PARTITION BY event_type ORDER BY cell))"""


@query(f"""WITH {_SMOOTH_SQL}, p AS (SELECT *, coalesce(lag(smoothed) OVER w, 0) AS l, coalesce(lead(smoothed) OVER w, 0) AS r FROM (SELECT event_type, cell, mass, round(smoothed, 6) AS smoothed FROM m) WINDOW w AS (PARTITION BY event_type ORDER BY cell))
SELECT event_type, cell::BIGINT AS cell, mass, smoothed FROM p WHERE smoothed >= l AND smoothed >= r AND smoothed >= 1.2""")
def hist_smooth_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly histogram of each event type, smoothed, and its peaks."""
    h = signal.smooth(signal.histogram(events(spark, sf_dir), ["event_type"], "t", 3600), ["event_type"]).withColumn("smoothed", F.round("smoothed", 6))
    return signal.peaks(h, ["event_type"], 1.2).select("event_type", "cell", "mass", "smoothed")


@query()
def density_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows grown around the peaks of the smoothed histogram."""
    h = signal.smooth(signal.histogram(events(spark, sf_dir), ["event_type"], "t", 3600), ["event_type"]).withColumn("smoothed", F.round("smoothed", 6))
    return signal.expand_peaks(h, ["event_type"], signal.peaks(h, ["event_type"], 1.2))


@query(f"""WITH {EVENTS_SQL} SELECT event_id, (count(*) FILTER (WHERE value <= 50) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN 50000 PRECEDING AND 50000 FOLLOWING))::BIGINT AS near, near >= 10 AS collapsed FROM ev""")
def range_frame_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-value events within 50,000 s of each event, and whether they make a collapse region."""
    near = signal.range_count(events(spark, sf_dir), ["event_type"], "t", 50_000, F.col("value") <= 50)
    return near.select("event_id", "near", (F.col("near") >= 10).alias("collapsed"))


@query("""WITH s AS (SELECT l_orderkey, (epoch_us(l_shipdate) // 86400000000)::BIGINT AS d, CASE WHEN l_returnflag = 'N' THEN 2.0 WHEN l_returnflag = 'R' THEN 6.0 ELSE 3.0 END AS sigma FROM lineitem),
sp AS (SELECT l_orderkey, count(*) AS n, min(d) AS a, max(d) AS b FROM s GROUP BY 1), g AS (SELECT l_orderkey, n, unnest(range(a - 20, least(b + 20, a + 1980) + 1)) AS x FROM sp WHERE n >= 2),
h AS (SELECT g.l_orderkey, n, x, sum(exp(-((x - d) / sigma) * ((x - d) / sigma) / 2) / sigma) AS h FROM g JOIN s USING (l_orderkey) GROUP BY 1, 2, 3),
p AS (SELECT *, h / sum(h) OVER (PARTITION BY l_orderkey) AS p FROM h), c AS (SELECT *, sum(p) OVER (PARTITION BY l_orderkey ORDER BY x ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(p, 12) DESC, x) AS r FROM p)
SELECT l_orderkey, n::BIGINT AS n_signals, max(CASE WHEN r = 1 THEN x END)::BIGINT AS mode, min(CASE WHEN cum >= 0.05 THEN x END)::BIGINT AS ci_lo, min(CASE WHEN cum >= 0.95 THEN x END)::BIGINT AS ci_hi FROM c GROUP BY 1, 2
UNION ALL SELECT l_orderkey, n, 0, 0, 0 FROM sp WHERE n < 2""")
def kernel_posterior_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior of each order's ship day from kernels around its lines."""
    sigma = F.when(F.col("l_returnflag") == "N", 2.0).when(F.col("l_returnflag") == "R", 6.0).otherwise(3.0)
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", days("l_shipdate").alias("d"), sigma.alias("sigma"))
    return signal.position_posterior(s, ["l_orderkey"], "d", "sigma", entropy=False)
