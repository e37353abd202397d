"""Likelihoods and genotypes as queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import prob
from ..session import table
from .registry import query

_COUNTS = "k AS (SELECT l_partkey, count(*) FILTER (WHERE l_returnflag = 'R') AS alt, count(*) FILTER (WHERE l_returnflag = 'A') AS ref FROM lineitem GROUP BY 1)"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("alt"), F.count_if(F.col("l_returnflag") == "A").alias("ref"))


def _bb(k: str, n: str, mu: float, rho: float = 0.02) -> str:
    kappa = (1 - rho) / rho
    a, b = mu * kappa, (1 - mu) * kappa
    return f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0) + lgamma({k} + {a!r}) + lgamma({n} - {k} + {b!r}) - lgamma({n} + {a + b!r}) + lgamma({a + b!r}) - lgamma({a!r}) - lgamma({b!r}))"


@query(f"""WITH {_COUNTS}, l AS (SELECT *, alt + ref AS n, {_bb("alt", "(alt + ref)", 0.02)} + ln(0.25) AS l0, {_bb("alt", "(alt + ref)", 0.5)} + ln(0.5) AS l1, {_bb("alt", "(alt + ref)", 0.98)} + ln(0.25) AS l2 FROM k WHERE alt + ref > 0),
p AS (SELECT *, greatest(l0, l1, l2) AS m FROM l), q AS (SELECT *, 1 - 1 / (exp(l0 - m) + exp(l1 - m) + exp(l2 - m)) AS wrong FROM p)
SELECT l_partkey, CASE WHEN greatest(l1, l2) <= l0 THEN '0/0' WHEN l1 >= l2 THEN '0/1' ELSE '1/1' END AS gt, (CASE WHEN greatest(l1, l2) <= l0 THEN 0 ELSE least(99, greatest(0, floor(-10 * log10(least(greatest(wrong, 1e-12), 1.0)) + 0.5))) END)::INT AS gq, n::INT AS depth, round(alt / n, 6) AS allele_fraction FROM q
UNION ALL SELECT l_partkey, './.', 0, 0, 0.0 FROM k WHERE alt + ref = 0""")
def beta_binomial_genotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotype of each part from returned against accepted lines."""
    g = _counts(spark, sf_dir).select("l_partkey", prob.genotype("alt", "ref").alias("g"))
    return g.select("l_partkey", "g.gt", "g.gq", "g.depth", F.round("g.allele_fraction", 6).alias("allele_fraction"))


_S = prob.spanning_sensitivity(320)


@query(f"""WITH {_COUNTS}, l AS (SELECT *, {_bb("alt", "(alt + ref)", 0.5 * _S + 0.5 * 0.02)} + ln({2 / 3!r}) AS a, {_bb("alt", "(alt + ref)", _S)} + ln({1 / 3!r}) AS b, {_bb("alt", "(alt + ref)", 0.02)} AS z FROM k)
SELECT l_partkey, round(CASE WHEN alt + ref = 0 THEN 0 ELSE greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) - z END, 6) AS log_bf FROM l""")
def log_bf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log Bayes factor of each part's counts for an insertion of 320 over an artifact."""
    return _counts(spark, sf_dir).select("l_partkey", F.round(prob.log_bf_counts("alt", "ref", 320), 6).alias("log_bf"))


@query(f"""WITH {_COUNTS}, b AS (SELECT l_partkey, alt, alt + ref AS n FROM k)
SELECT l_partkey, round(lgamma(n + 1.0) - lgamma(alt + 1.0) - lgamma(n - alt + 1.0) + alt * ln(0.02) + (n - alt) * ln(0.98), 6) AS log_pmf, round(ln(0.8 * exp(alt - 3.0) + 0.2), 6) AS robust FROM b""")
def binomial_log_pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binomial log probabilities, and a bounded likelihood ratio."""
    c = _counts(spark, sf_dir)
    return c.select("l_partkey", F.round(prob.binomial_log_pmf(F.col("alt"), F.col("alt") + F.col("ref"), 0.02), 6).alias("log_pmf"), F.round(prob.robust(F.col("alt") - 3.0, 0.8), 6).alias("robust"))


@query("""SELECT l_orderkey, l_linenumber, round(least(0.45, 0.02 + greatest(greatest(0, (greatest(l_discount * 10, l_tax * 10) - 0.3) / 0.7), l_quantity / 100) * 0.3), 6) AS error_rate, round(1 / (1 + exp(-(l_quantity - 25) / 10)), 6) AS logistic, round(1 - exp(-l_linenumber / 3.0), 6) AS saturated FROM lineitem""")
def scalar_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local error rates, logistic and saturating terms."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(prob.local_error_rate(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 100), 6).alias("error_rate"), F.round(prob.logistic((F.col("l_quantity") - 25) / 10), 6).alias("logistic"), F.round(prob.saturating("l_linenumber", 3.0), 6).alias("saturated"))


_GRID = [0.75 + (0.995 - 0.75) * i / 49 for i in range(50)]


@query(f"""WITH r AS (SELECT p_partkey, p_size::DOUBLE AS n, least(1.0, greatest(0.0, 0.72 + p_size / 150.0)) * p_size AS m FROM part), g AS (SELECT p_partkey, n, m, m * ln(g) + (n - m) * ln(1 - g) AS l FROM r, (SELECT unnest([{", ".join(map(repr, _GRID))}]) AS g)),
t AS (SELECT p_partkey, any_value(n) AS n, any_value(m) AS m, max(l) AS top FROM g GROUP BY 1)
SELECT p_partkey, round(top + ln(sum(exp(l - top))) - {math.log(50)!r} - (t.m * ln(0.7) + (t.n - t.m) * ln(0.3)), 6) AS log_bf FROM t JOIN g USING (p_partkey) GROUP BY p_partkey, top, t.m, t.n""")
def identity_log_bf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture over identities against a background identity."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(prob.te_identity_log_bf(0.72 + F.col("p_size") / 150.0, F.col("p_size")), 6).alias("log_bf"))
