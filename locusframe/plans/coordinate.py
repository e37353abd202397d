"""Coordinate operators as queries: bins, islands, merges, interval and nearest joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators import greedy, intervals, islands
from ..streaming import bins
from ..session import table
from .registry import query
from .views import EVENTS_SQL, SPANS_SQL, days, events, order_spans

DAY = 86_400


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT *, t AS s, t + (abs(value) * 3600)::BIGINT AS e FROM ev WHERE value IS NOT NULL)
SELECT bin, count(*)::BIGINT AS members, count(DISTINCT user_id)::BIGINT AS users, sum(CASE WHEN s // 86400 = bin THEN 1 ELSE 0 END)::BIGINT AS owned
FROM (SELECT *, unnest(range(s // 86400, e // 86400 + 1)) AS bin FROM e) GROUP BY bin""")
def hopping_bin_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event joins all day bins that its span touches; one bin owns it."""
    e = events(spark, sf_dir).filter("value is not null").withColumn("e", F.col("t") + F.round(F.abs("value") * 3600).cast("long"))
    spread = intervals.bins_of(e, "t", "e", DAY)
    return spread.groupBy("bin").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("user_id").alias("users"), F.sum(F.when(F.floor(F.col("t") / DAY) == F.col("bin"), 1).otherwise(0)).alias("owned"))


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 1800 THEN 0 ELSE 1 END AS opens FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t, event_id) AS island FROM f)
SELECT user_id, island::BIGINT AS island, min(t) AS first_t, max(t) AS last_t, count(*)::BIGINT AS n FROM i GROUP BY 1, 2""")
def gap_islands_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of each user's events with gaps up to 30 minutes, in two levels."""
    i = islands.assign_islands(events(spark, sf_dir), ["user_id"], "t", 1800, ["event_id"], bucket=7 * DAY)
    return i.groupBy("user_id", "island").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 14400 THEN 0 ELSE 1 END AS opens FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY event_type ORDER BY t, event_id) AS island FROM f),
b AS (SELECT *, (row_number() OVER (PARTITION BY event_type, island ORDER BY t, event_id) - 1) // 25 AS block FROM i)
SELECT event_type, island::BIGINT AS island, block::BIGINT AS block, count(*)::BIGINT AS n, min(event_id) AS first_id FROM b GROUP BY 1, 2, 3""")
def capped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of each event type cut after 25 rows; few keys, so windows run in buckets of two days."""
    b = islands.capped_blocks(events(spark, sf_dir), ["event_type"], "t", 14_400, 25, ["event_id"], bucket=2 * DAY)
    return b.groupBy("event_type", "island", "block").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query(f"""WITH {SPANS_SQL}, f AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY custkey ORDER BY "start", "end", orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END AS opens FROM spans),
i AS (SELECT *, sum(opens) OVER (PARTITION BY custkey ORDER BY "start", "end", orderkey) AS k FROM f)
SELECT custkey, min("start") AS "start", max("end") AS "end", count(*)::BIGINT AS members FROM i GROUP BY custkey, k""")
def interval_merge_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each customer's orders merged over gaps of up to 3 days."""
    return islands.merge_intervals(order_spans(spark, sf_dir), ["custkey"], "start", "end", 3, bucket=400)


@query(f"""WITH {SPANS_SQL}, f AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY custkey ORDER BY "start", "end", orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM spans WHERE "start" < "end"),
i AS (SELECT *, sum(opens) OVER (PARTITION BY custkey ORDER BY "start", "end", orderkey) AS k FROM f),
m AS (SELECT custkey, min("start") AS s, max("end") AS e FROM i GROUP BY custkey, k)
SELECT custkey, sum(e - s)::BIGINT AS covered FROM m GROUP BY custkey""")
def interval_union_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that each customer's orders cover together."""
    return islands.union_length(order_spans(spark, sf_dir), ["custkey"], "start", "end", bucket=400)


@query(f"""WITH {SPANS_SQL}
SELECT a.custkey, a.orderkey AS left_order, b.orderkey AS right_order, (least(a."end", b."end") - greatest(a."start", b."start"))::BIGINT AS shared
FROM spans a JOIN spans b ON a.custkey = b.custkey AND a."end" > b."start" AND a."start" < b."end" AND a.orderkey < b.orderkey""")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one customer's orders that overlap."""
    spans = order_spans(spark, sf_dir)
    pairs = intervals.overlap_join(spans, spans, ["custkey"], width=64).filter("orderkey < r_orderkey")
    return pairs.select("custkey", F.col("orderkey").alias("left_order"), F.col("r_orderkey").alias("right_order"), (F.least("end", "r_end") - F.greatest("start", "r_start")).alias("shared"))


@query(f"""WITH {SPANS_SQL},
inside AS (SELECT a.custkey, a.orderkey, b.orderkey AS outer_order FROM spans a JOIN spans b ON a.custkey = b.custkey AND a.orderkey <> b.orderkey AND b."start" <= a."start" AND b."end" >= a."end"),
big AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 250000)
SELECT custkey, orderkey, count(DISTINCT outer_order)::BIGINT AS outers FROM inside
WHERE orderkey NOT IN (SELECT o_orderkey FROM big) AND NOT EXISTS (SELECT 1 FROM big WHERE o_orderkey = outer_order) GROUP BY 1, 2""")
def containment_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders spanned by another order of the customer, where neither is a big one (containment and two anti joins)."""
    spans = order_spans(spark, sf_dir)
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 250000").select(F.col("o_orderkey").alias("orderkey"))
    pairs = intervals.containment_join(spans, spans, ["custkey"], width=64).filter("orderkey <> r_orderkey")
    clean = pairs.join(big, "orderkey", "left_anti").join(big.select(F.col("orderkey").alias("r_orderkey")), "r_orderkey", "left_anti")
    return clean.groupBy("custkey", "orderkey").agg(F.countDistinct("r_orderkey").alias("outers"))


@query(f"""WITH {EVENTS_SQL}, p AS (SELECT event_type, min(t) AS lo FROM ev GROUP BY 1), s AS (SELECT event_type, lo + k * 400000 AS "start", lo + k * 400000 + 100000 AS "end" FROM p, range(0, 7) AS r(k))
SELECT e.event_id, s."start" AS span_start FROM ev e JOIN s ON e.event_type = s.event_type AND s."start" <= e.t AND e.t < s."end" """)
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events inside seven spans of their type."""
    e = events(spark, sf_dir)
    low = e.groupBy("event_type").agg(F.min("t").alias("lo")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    spans = low.select("event_type", (F.col("lo") + F.col("k") * 400_000).alias("start"), (F.col("lo") + F.col("k") * 400_000 + 100_000).alias("end"))
    return intervals.points_in_intervals(e, spans, ["event_type"], "t", width=100_000).select("event_id", F.col("r_start").alias("span_start"))


@query(f"""WITH {EVENTS_SQL}, a AS (SELECT * FROM ev WHERE event_type = (SELECT min(event_type) FROM ev)), b AS (SELECT * FROM ev WHERE event_type = (SELECT max(event_type) FROM ev)),
j AS (SELECT a.event_id, b.event_id AS near_id, abs(a.t - b.t) AS distance, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.event_id) AS r FROM a JOIN b ON a.user_id = b.user_id AND abs(a.t - b.t) <= 259200)
SELECT event_id, near_id, distance::BIGINT AS distance FROM j WHERE r = 1""")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For events of the first type, the user's nearest event of the last type within three days."""
    e = events(spark, sf_dir)
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    a = e.join(F.broadcast(ends.select("lo")), F.col("event_type") == F.col("lo"))  # one row
    b = e.join(F.broadcast(ends.select("hi")), F.col("event_type") == F.col("hi"))
    near = intervals.nearest(a, b, ["user_id"], "t", "t", 3 * DAY, ["event_id"], ["r_event_id"])
    return near.select("event_id", F.col("r_event_id").alias("near_id"), "distance")


@query()
def one_to_one_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one matching of two event types of a user within a day, nearest first."""
    e = events(spark, sf_dir)
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    a = e.join(F.broadcast(ends.select("lo")), F.col("event_type") == F.col("lo")).select("user_id", "t", F.col("event_id").alias("id"))
    b = e.join(F.broadcast(ends.select("hi")), F.col("event_type") == F.col("hi")).select("user_id", "t", F.col("event_id").alias("id"))
    return greedy.match_one_to_one(a, b, ["user_id"], "t", DAY)


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, (epoch_us(l_shipdate) // 86400000000)::BIGINT AS d FROM lineitem),
s AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY l_orderkey ORDER BY d, l_linenumber) <= 10 THEN 0 ELSE 1 END AS o FROM c),
i AS (SELECT *, sum(o) OVER (PARTITION BY l_orderkey ORDER BY d, l_linenumber) AS island FROM s)
SELECT l_orderkey, island::BIGINT AS island, list_sort(list(d))[count(*) // 2 + 1] AS centre, count(*)::BIGINT AS support FROM i GROUP BY 1, 2""")
def breakpoint_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of an order's ship days, with upper-median centres and supports."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", days("l_shipdate").alias("d"))
    return islands.islands_of_breakpoints(lines, ["l_orderkey"], "d", 10)


@query("""WITH d AS (SELECT DISTINCT l_suppkey, (epoch_us(l_shipdate) // 86400000000)::BIGINT AS d FROM lineitem), g AS (SELECT *, d - row_number() OVER (PARTITION BY l_suppkey ORDER BY d) AS g FROM d)
SELECT l_suppkey, min(d) AS "start", count(*)::BIGINT AS "length" FROM g GROUP BY l_suppkey, g HAVING count(*) >= 2""")
def consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more consecutive ship days of each supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", days("l_shipdate").alias("d")).distinct()
    return islands.consecutive_runs(lines, ["l_suppkey"], "d").filter("length >= 2")


@query(f"""WITH {EVENTS_SQL}, a AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM ev),
f AS (SELECT *, CASE WHEN gap <= 3600 THEN 0 ELSE 1 END AS o FROM a), s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM f)
SELECT user_id, min(t) AS session_start, max(t) + 3600 AS session_end, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def stream_session_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows of an hour, in the batch form of the streaming plan. A gap of exactly an hour joins."""
    found = bins.loci(events(spark, sf_dir), ["user_id"], "t", 3600, 0)
    s = found.select("user_id", F.col("first").alias("session_start"), (F.col("last") + 3600).alias("session_end"), "n")
    return s.select("user_id", "session_start", "session_end", "n")


@query(f"""WITH {SPANS_SQL}, c AS (SELECT custkey, orderkey, "start", unnest([("start" - 30), ("start" + 30), ("start" - 60), ("start" + 60), ("start" - 90), ("start" + 90)]) AS control, unnest([1, 2, 3, 4, 5, 6]) AS o, (SELECT min("start") FROM spans) AS lo, (SELECT max("end") FROM spans) AS hi FROM spans),
k AS (SELECT *, row_number() OVER (PARTITION BY orderkey ORDER BY o) - 1 AS k FROM c WHERE control BETWEEN lo AND hi)
SELECT orderkey, k::INT AS k, control::BIGINT AS control FROM k WHERE k < 3""")
def shift_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three shifted control days of every order, inside the observed range."""
    from ..operators.signal import shift_controls as controls

    spans = order_spans(spark, sf_dir)
    ends = F.broadcast(spans.agg(F.min("start").alias("lo"), F.max("end").alias("hi")))  # one row
    return controls(spans.crossJoin(ends), "start", "lo", "hi", 30, 3).select("orderkey", "k", "control")
