"""Aggregation and ranking operators as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators import ranks, stats
from ..session import table
from .registry import query
from .views import EVENTS_SQL, events


@query("""SELECT l_returnflag, count(*)::BIGINT AS n, count(*) FILTER (WHERE kept)::BIGINT AS kept, count(*) FILTER (WHERE sig)::BIGINT AS with_signal, count(*) FILTER (WHERE NOT kept AND NOT sig)::BIGINT AS quiet_dropped
FROM (SELECT l_returnflag, l_discount >= 0.05 AS sig, CASE WHEN l_discount >= 0.05 THEN l_extendedprice >= 20000 AND l_tax <= 0.06 ELSE l_quantity > 20 END AS kept FROM lineitem) GROUP BY 1""")
def gate_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate with one rule for rows with a signal and one for those without, and its counters."""
    sig = F.col("l_discount") >= 0.05
    kept = F.when(sig, (F.col("l_extendedprice") >= 20_000) & (F.col("l_tax") <= 0.06)).otherwise(F.col("l_quantity") > 20)
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", sig.alias("sig"), kept.alias("kept"))
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept"), F.count_if("sig").alias("with_signal"), F.count_if(~F.col("kept") & ~F.col("sig")).alias("quiet_dropped"))


@query("SELECT l_suppkey, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS upper_median, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of each supplier's prices."""
    return stats.upper_median(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")


@query("SELECT l_returnflag, l_linestatus, round(median(l_quantity), 6) AS true_median FROM lineitem GROUP BY 1, 2")
def true_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median that averages the middle two."""
    return stats.true_median(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity").withColumn("true_median", F.round("true_median", 6))


@query("""WITH s AS (SELECT l_suppkey, l_quantity AS v, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY l_suppkey) AS total FROM s)
SELECT l_suppkey, min(v) AS weighted_median FROM c WHERE 2 * cum >= total GROUP BY 1""")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity at which half of a supplier's weight is reached."""
    return stats.weighted_median(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_linenumber")


@query("""WITH m AS (SELECT l_partkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS centre FROM lineitem GROUP BY 1)
SELECT l_partkey, centre, list_sort(list(abs(l_quantity - centre)))[count(*) // 2 + 1] AS mad, count(*)::BIGINT AS n FROM lineitem JOIN m USING (l_partkey) GROUP BY 1, 2""")
def mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median absolute deviation of each part's quantities."""
    return stats.median_absolute_deviation(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity").select("l_partkey", "centre", "mad", "n")


@query("""WITH p AS (SELECT l_partkey, l_suppkey, sum(l_discount * l_quantity) AS vw, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY w DESC, l_suppkey) AS r FROM p)
SELECT l_partkey, round(sum(vw) / sum(w), 9) AS weighted_mean, round(sum(w), 2) AS weight, max(CASE WHEN r = 1 THEN l_suppkey END) AS top_label FROM r GROUP BY 1""")
def weighted_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity-weighted discount of each part and its heaviest supplier."""
    r = stats.weighted_rollup(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_discount", "l_quantity", "l_suppkey")
    return r.withColumns({"weighted_mean": F.round("weighted_mean", 9), "weight": F.round("weight", 2)})


@query("""WITH s AS (SELECT p_brand, p_partkey, max(l_extendedprice) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY p_brand ORDER BY score DESC, p_partkey))
SELECT p_brand, p_partkey AS best, score AS best_score, second AS second_score, round(greatest(0, score - coalesce(second, 0)), 2) AS margin FROM r WHERE r = 1""")
def family_best_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best part of each brand, with the margin to the second."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    best = lines.groupBy("l_partkey").agg(F.max("l_extendedprice").alias("score"))
    scored = best.join(part, best["l_partkey"] == part["p_partkey"]).select("p_brand", "p_partkey", "score")
    return ranks.best_and_second(scored, ["p_brand"], "score", "p_partkey").withColumn("margin", F.round("margin", 2))


@query("""WITH c AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_mktsegment, o_orderpriority AS dominant, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, v DESC, o_orderpriority) AS r FROM c) WHERE r = 1""")
def dominant_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent priority of each segment; value, then name, on ties."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    counts = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).groupBy("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v"))
    return ranks.first_per_group(counts, ["c_mktsegment"], [F.desc("n"), F.desc("v"), "o_orderpriority"]).select("c_mktsegment", F.col("o_orderpriority").alias("dominant"), "n")


@query("""SELECT o_custkey, o_orderkey, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three largest orders of each customer, ranked."""
    return ranks.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3, "rank").select("o_custkey", "o_orderkey", "rank")


@query("""SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line of each part and supplier."""
    first = ranks.first_per_group(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"])
    return first.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_quantity, l_discount, l_tax ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def exact_row_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows equal in the compared columns: the first in order stays."""
    first = ranks.first_per_group(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber"])
    return first.select("l_orderkey", "l_linenumber")


@query("""WITH k AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE AS x, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
f AS (SELECT * FROM k WHERE n >= 4 AND x / n > 0.15 AND x / n < 0.85), a AS (SELECT count(*) AS m, sum(x) AS sx, sum(n) AS sn, sum(n * n) AS snn, sum(x * (n - x) / n) AS w FROM f),
b AS (SELECT m, sn, snn, w, (SELECT sum(n * (x / n - sx / sn) * (x / n - sx / sn)) FROM f) AS b FROM a),
c AS (SELECT m, b / nullif(m - 1, 0) AS msb, w / nullif(sn - m, 0) AS msw, (sn - snn / sn) / nullif(m - 1, 0) AS n0 FROM b)
SELECT m::BIGINT AS sites, round(CASE WHEN m >= 20 THEN least(0.5, greatest(0.0, (msb - msw) / (msb + (n0 - 1) * msw))) ELSE 0.02 END, 6) AS rho FROM c""")
def icc_overdispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overdispersion of suppliers' return shares."""
    k = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("x"), F.count(F.lit(1)).alias("n"))
    return stats.overdispersion(k, "x", "n").withColumn("rho", F.round("rho", 6))


_DECOY = """count(*) FILTER (WHERE c > 0) AS loci, coalesce(sum(c), 0) AS decoys, sum(c * v) AS s, var_samp(CASE WHEN c > 0 THEN v END) AS var"""


@query(f"""WITH r AS (SELECT l_returnflag || l_linestatus || (l_linenumber % 3)::VARCHAR AS te_class, l_linenumber - 1 AS c, l_discount * 20 AS v FROM lineitem),
g AS (SELECT te_class, {_DECOY} FROM r GROUP BY 1 UNION ALL SELECT 'ALL', {_DECOY} FROM r WHERE te_class NOT LIKE 'N%'),
m AS (SELECT *, CASE WHEN decoys > 0 THEN s / decoys ELSE 0.0 END AS mean FROM g),
u AS (SELECT *, CASE WHEN loci = 0 THEN 0.0 WHEN loci = 1 THEN 'inf'::DOUBLE ELSE mean + 1.645 * sqrt(var / loci) END AS upper FROM m),
f AS (SELECT *, CASE WHEN loci = 0 THEN 1.0 ELSE greatest(1.0, upper) END AS factor FROM u), p AS (SELECT upper AS pu, factor AS pf FROM f WHERE te_class = 'ALL')
SELECT te_class, loci::BIGINT AS loci, decoys::BIGINT AS decoys, round(mean, 6) AS mean, round(CASE WHEN te_class <> 'ALL' AND loci < 10 THEN pu ELSE upper END, 6) AS upper, round(CASE WHEN te_class <> 'ALL' AND loci < 10 THEN pf ELSE factor END, 6) AS factor FROM f, p""")
def decoy_class_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoy bound of each class, and of the pool."""
    cls = F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 3).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(cls.alias("cls"), (F.col("l_linenumber") - 1).alias("c"), (F.col("l_discount") * 20).alias("v"))
    d = stats.decoy_checks(rows, "cls", "c", "v", ~F.col("cls").startswith("N"))
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "upper", "factor")})


@query("""SELECT l_orderkey, l_linenumber, round((1 + ge) / (2.0 + n), 9) AS tail_p FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC RANGE UNBOUNDED PRECEDING) AS ge, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)""")
def empirical_tail_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tail share of each line's quantity among its return flag."""
    t = stats.empirical_tail(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity")
    return t.select("l_orderkey", "l_linenumber", F.round("tail_p", 9).alias("tail_p"))


@query("""WITH s AS (SELECT c_nationkey AS block, sum(o_totalprice) AS v, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), b AS (SELECT *, row_number() OVER (ORDER BY block) - 1 AS i FROM s), t AS (SELECT count(*) AS m FROM b),
p AS (SELECT d.draw, (((((((d.draw * 7919 + k.k * 104729 + 15485863) % 2147483647) * 48271 + 11) % 2147483647) * 48271 + 11) % 2147483647) * 48271 + 11) % 2147483647 % m AS i FROM t, range(0, 200) AS d(draw), range(0, 1000) AS k(k) WHERE k.k < m)
SELECT draw::INT AS draw, round(sum(v), 2) AS v, sum(n)::BIGINT AS n FROM p JOIN b USING (i) GROUP BY 1""")
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred resamples of nations."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("block"))
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select("block", F.col("o_totalprice").alias("v"), F.lit(1).cast("long").alias("n"))
    return stats.block_bootstrap(rows, "block", ["v", "n"], 200).withColumn("v", F.round("v", 2))


@query("""WITH e AS (SELECT o_orderkey AS i, o_totalprice / 1000.0 * (CASE WHEN o_orderpriority LIKE '1%' THEN 40 ELSE 1 END) AS e FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY e DESC, i) AS rank, count(*) OVER () AS m FROM e), c AS (SELECT max(CASE WHEN e >= m / (0.1 * rank) THEN rank END) AS cut FROM r)
SELECT i AS o_orderkey, rank::BIGINT AS rank, coalesce(rank <= cut, false) AS selected FROM r, c""")
def ebh_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-value step-up over all orders at q = 0.1."""
    e = F.col("o_totalprice") / 1000.0 * F.when(F.col("o_orderpriority").startswith("1"), 40).otherwise(1)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", e.alias("e"))
    return ranks.select_by_evalue(rows, "e", 0.1, ["o_orderkey"]).select("o_orderkey", "rank", "selected")


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT user_id, round(ln(sum(exp(n - m))) + max(m), 6) AS log_total FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS m FROM c) GROUP BY 1""")
def log_sum_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable log of summed exponentials of each user's counts."""
    c = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return stats.log_sum_exp(c, ["user_id"], "n").withColumn("log_total", F.round("log_total", 6))


@query("""SELECT n_name, r_name, count(*)::BIGINT AS n_orders, round(sum(o_totalprice), 2) AS value, grouping(n_name)::INT AS is_total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and values by region and nation, with the pooled rows of a rollup."""
    orders, customer, nation, region = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region"))
    j = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("value"), F.grouping("n_name").cast("int").alias("is_total"))
