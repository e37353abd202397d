"""Scoring and decision operators as queries over observations made from the driver tables.

Observations are portable SQL expressions of a table's columns, so that the
operator and its SQL see the same rows; the SQL says the rule anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import prob, scalars as S, seq
from ..session import table
from . import mechanism, policy, structure, taxonomy
from .registry import query


def _pick(key: str, values: list[str]) -> str:
    """CASE that picks one of the values by a remainder; portable."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _select(names: dict[str, str], source: str) -> str:
    return "SELECT row_number() OVER () AS rid, " + ", ".join(f"{e} AS {n}" for n, e in names.items()) + f" FROM {source}"


def _six(*names: str) -> list:
    """Columns rounded to six places, without a negative zero."""
    return [(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names]


def _six_sql(*names: str) -> str:
    return ", ".join(f"(round({n}, 6) + 0.0::DOUBLE)::DOUBLE AS {n}" for n in names)


_KEY = {"k": "l_orderkey", "line": "l_linenumber"}
_q = lambda *x: [f"'{v}'" for v in x]
_CLASSES = ["LINE", "SINE", "Retroposon", "PLE", "LTR", "DNA", "RC", "Unknown", "NonTE"]
_LOCUS = _KEY | {
    "te_class": _pick("l_partkey", _q(*_CLASSES)), "superfamily": _pick("(l_suppkey + l_linenumber)", _q("L1", "Alu", "SVA", "Penelope", "Gypsy", "hAT-Charlie", "Helitron", "P", "PiggyBac", "TcMar-Tigger", "Pogo", "NA")),
    "identity": "CAST((l_orderkey % 41) AS DOUBLE) / 40", "aligned_len": "CAST((l_partkey * 7 + l_linenumber) % 600 AS INT)", "element_length": "CAST(CASE WHEN l_partkey % 11 = 0 THEN -1 ELSE 300 + (l_orderkey % 7) * 150 END AS INT)",
    "element_start": "CAST((l_suppkey * 13) % 200 AS INT)", "element_end": "CAST((l_suppkey * 13) % 200 + (l_partkey * 3) % 400 AS INT)", "polya_len": "CAST((l_linenumber * 5 + l_orderkey) % 29 AS INT)",
    "five_whole": "l_orderkey % 3 = 0", "three_whole": "l_partkey % 2 = 0", "ltr_start": "CAST(l_orderkey % 4 - 1 AS INT)", "ltr_end": "CAST(l_partkey % 3 AS INT)", "tir_identity": "CAST((l_suppkey + l_orderkey) % 23 - 2 AS DOUBLE) / 20",
    "helitron_start": "CAST(l_orderkey % 4 - 1 AS INT)", "helitron_end": "CAST(l_partkey % 5 AS INT)", "tsd_len": "CAST((l_orderkey + l_linenumber) % 17 AS INT)", "tsd_mismatches": "CAST(l_partkey % 3 AS INT)",
    "tsd_seq": "substr('TATTAATAACGTACGTTAA', 1, CAST((l_orderkey + l_linenumber) % 17 AS INT))", "motif_log_odds": "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(l_partkey % 18 AS DOUBLE) - 9.5 END",
    "n_alt": "CAST(l_orderkey % 23 AS INT)", "n_ref": "CAST(l_partkey % 19 AS INT)", "insert_len": "CAST((l_suppkey * 31 + l_partkey) % 6000 AS INT)", "a_share": "CAST(l_orderkey % 11 AS DOUBLE) / 10", "t_share": "CAST(l_partkey % 8 AS DOUBLE) / 10",
    "repeat_share": "CASE WHEN l_partkey % 4 = 0 THEN 0.3 ELSE 0.0 END", "tsd_chance": "CASE WHEN l_orderkey % 6 = 0 THEN -1.0 ELSE CAST(1 + l_partkey % 9 AS DOUBLE) / 101 END",
}


#: Orders with the columns that observations read, for the costlier models.
_ORDERS = {"l_orderkey": "o_orderkey", "l_partkey": "o_custkey", "l_suppkey": "(o_orderkey * 7 + o_custkey) % 97", "l_linenumber": "o_orderkey % 7 + 1"}
_ORDERS_SQL = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in _ORDERS.items()) + " FROM orders)"


def _observe(spark: SparkSession, sf_dir: str, names: dict[str, str], name: str = "lineitem") -> DataFrame:
    rows = table(spark, sf_dir, name)
    if name == "orders":
        rows = rows.selectExpr(*(f"{e} AS {n}" for n, e in _ORDERS.items()))
    return rows.selectExpr(*(f"{e} AS {n}" for n, e in names.items()))


def _values(rows: list[tuple], names: str) -> str:
    shown = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS {names}"


_LSE = "(SELECT CASE WHEN max(v) = '-inf'::DOUBLE THEN max(v) ELSE max(v) + ln(sum(exp(v - m))) END FROM (SELECT v, max(v) OVER () AS m FROM (SELECT unnest({list}) AS v)))"
#: DuckDB macros that the SQL of this module shares; each query is one statement, so they are inlined.
_ROBUST = lambda l, w: f"(greatest({l} + ln({w}), ln(1 - {w})) + ln(1 + exp(-abs({l} + ln({w}) - ln(1 - {w})))))"
_RATIO = lambda k, n, p, c: f"(least({k}, {n}) * ln({p} / {c}) + ({n} - least({k}, {n})) * ln((1 - {p}) / (1 - {c})))"
_BB = lambda k, n, a, b: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + lgamma({k} + {a}) + lgamma({n} - {k} + {b}) - lgamma({n} + {a} + {b}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b}))"
_LSE2 = lambda *v: f"(greatest({', '.join(v)}) + ln({' + '.join(f'exp({x} - greatest({chr(44).join(v)}))' for x in v)}))"
#: Models by superfamily prefix and class, as rows.
_MODELS = [(k, *v) for k, v in mechanism.SUPERFAMILY_TSD.items()]
_CLASS_MODELS = [(k, *v) for k, v in mechanism.CLASS_TSD.items()]


def _length_sql(m: str) -> str:
    """ln of a duplication's length under the model in alias ``m``."""
    p = f"CASE WHEN tau = {m}.modal THEN 1 - {m}.spread WHEN abs(tau - {m}.modal) = 1 THEN {m}.spread / 2 * 0.9 ELSE {m}.spread * 0.1 / 50 END"
    return f"CASE WHEN tau <= 0 THEN ln(greatest(1 - {m}.present, 1e-6)) WHEN {m}.mean > 0 THEN ln({m}.present) + ln(1 / {m}.mean) - tau / {m}.mean WHEN {m}.modal <= 0 THEN ln(greatest({m}.present, 1e-6)) - ln(50) ELSE ln({m}.present) + ln({p}) END"


def _tsd_sql(m: str) -> str:
    hit = f"({m}.motif = upper(tsd_seq) OR {m}.motif = reverse(translate(upper(tsd_seq), 'ACGT', 'TGCA')))"
    motif = f"CASE WHEN {m}.motif <> '' AND length({m}.motif) = tau AND tsd_seq <> '' THEN CASE WHEN {hit} THEN {_ROBUST(f'length({m}.motif) * ln(4)', '0.9')} ELSE ln(1 - 0.9) END ELSE 0 END"
    return f"CASE WHEN tau = 0 THEN {_length_sql(m)} ELSE {_length_sql(m)} - ln(greatest(greatest(p_null, tsd_chance), 1e-300)) + {motif} END"


_TAIL = _ROBUST("(CASE WHEN polya_len = 0 THEN ln(1 - 0.85) ELSE ln(0.85 / 25) - polya_len / 25.0 END - (polya_len * ln(f) + ln(1 - f)))", "0.85")
_ANCHOR = "CASE WHEN element_length > 0 AND element_end > element_start THEN ln((CASE WHEN v >= element_length - 5 THEN 0.98 ELSE 0 END) + 0.02 / n1) + ln(n1) ELSE 0 END"
_ENDS = f"CASE WHEN element_length <= 0 OR element_end <= element_start OR n2 <= 1 THEN 0 ELSE (CASE WHEN five_whole THEN {_ROBUST('ln(n2)', '0.8')} ELSE ln(1 - 0.8) END) + (CASE WHEN three_whole THEN {_ROBUST('ln(n2)', '0.8')} ELSE ln(1 - 0.8) END) END"
_LTR = f"CASE WHEN ltr_start >= 0 THEN {_ROBUST(_RATIO('(ltr_start + ltr_end)', '4', '0.95', '0.25'), '0.8')} ELSE 0 END"
_RC = f"CASE WHEN helitron_start >= 0 THEN {_ROBUST(_RATIO('(helitron_start + helitron_end)', '6', '0.95', '0.30'), '0.8')} ELSE 0 END"
_DNA = f"CASE WHEN tir_identity >= 0 THEN {_ROBUST(_RATIO('round_even(tir_identity * 20, 0)', '20', '0.90', '0.25'), '0.7')} ELSE 0 END"
_EN = f"CASE WHEN motif_log_odds IS NULL THEN 0 ELSE {_ROBUST('motif_log_odds', '0.6')} END"
_IN = {"LINE": f"{_ANCHOR} + {_TAIL}", "SINE": f"{_ANCHOR} + {_TAIL}", "Retroposon": f"{_ANCHOR} + {_TAIL}", "PLE": f"{_ANCHOR} + {_TAIL}", "LTR": f"({_ENDS}) + ({_LTR})", "DNA": f"({_ENDS}) + ({_DNA})", "RC": _RC}
_SPAN = "SELECT 200.0 * pow(1000.0, i / 199.0) AS r FROM range(200) t(i)"
_LOCUS_SQL = f"""
WITH o AS ({_select(_LOCUS, _ORDERS_SQL)}), grid AS (SELECT 0.75 + 0.245 * i / 49 AS g FROM range(50) t(i)),
cell AS (SELECT r, exp(-pow(ln(r) - ln(15000.0), 2) / (2 * 0.64)) / r AS w FROM ({_SPAN})),
lens AS (SELECT insert_len, (SELECT sum(w * greatest(0.0, r - greatest(1, insert_len) - 100) / r) / sum(w) FROM cell) AS s FROM (SELECT DISTINCT insert_len FROM o)),
ident AS (SELECT identity, aligned_len, CASE WHEN aligned_len <= 0 THEN 0 ELSE (SELECT max(v) + ln(sum(exp(v - m))) FROM (SELECT v, max(v) OVER () AS m FROM (SELECT least(greatest(identity, 0), 1) * aligned_len * ln(g) + (aligned_len - least(greatest(identity, 0), 1) * aligned_len) * ln(1 - g) AS v FROM grid))) - ln(50)
  - (least(greatest(identity, 0), 1) * aligned_len * ln(0.7) + (aligned_len - least(greatest(identity, 0), 1) * aligned_len) * ln(0.3)) END AS sequence FROM (SELECT DISTINCT identity, aligned_len FROM o)),
chance AS (SELECT tau, tsd_mismatches, sum(exp(lgamma(tau + 1) - lgamma(j + 1) - lgamma(tau - j + 1) + j * ln(3) - tau * ln(4))) AS u FROM (SELECT DISTINCT tsd_len AS tau, tsd_mismatches FROM o WHERE tsd_len > 0), range(20) t(j) WHERE j <= tsd_mismatches AND j <= tau GROUP BY 1, 2),
x AS (SELECT o.*, tsd_len AS tau, least(greatest(a_share, 0.05), 0.95) AS f, CASE WHEN three_whole THEN element_length ELSE element_end END AS v, lens.s, ident.sequence, (1 - repeat_share) * coalesce(chance.u, 1) + repeat_share AS p_null,
  least(0.45, 0.02 + 0.30 * greatest(greatest(0, (greatest(a_share, t_share) - 0.30) / 0.70), repeat_share)) AS eps
  FROM o JOIN lens USING (insert_len) JOIN ident USING (identity, aligned_len) LEFT JOIN chance ON chance.tau = o.tsd_len AND chance.tsd_mismatches = o.tsd_mismatches),
y AS (SELECT *, greatest(1.0, element_length - (v - least(element_start, v - 1)) + 1.0) AS n1, greatest(1.0, element_length - (element_end - element_start) + 1.0) AS n2, n_alt + n_ref AS n,
  0.5 * s + 0.5 * eps AS mu1, s AS mu2 FROM x),
c AS (SELECT *, CASE WHEN n <= 0 THEN 0 ELSE {_LSE2(f"ln(2.0 / 3) + {_BB('n_alt', 'n', 'mu1 * 49', '(1 - mu1) * 49')}", f"ln(1 - 2.0 / 3) + {_BB('n_alt', 'n', 'mu2 * 49', '(1 - mu2) * 49')}")} - {_BB('n_alt', 'n', 'eps * 49', '(1 - eps) * 49')} END AS counts FROM (SELECT * REPLACE (least(greatest(mu1, 1e-12), 1 - 1e-12) AS mu1, least(greatest(mu2, 1e-12), 1 - 1e-12) AS mu2) FROM y)),
models AS (SELECT * FROM {_values(_MODELS, "t(key, present, modal, spread, mean, motif)")}), classes AS (SELECT * FROM {_values(_CLASS_MODELS, "t(te_class, present, modal, spread, mean, motif)")}),
names AS (SELECT superfamily, max_by(key, length(key)) AS key FROM (SELECT DISTINCT superfamily FROM o) JOIN models ON starts_with(lower(superfamily), key) AND (length(key) >= 2 OR lower(superfamily) = key OR NOT regexp_matches(substr(lower(superfamily), length(key) + 1, 1), '[a-z]')) GROUP BY 1),
m AS (SELECT c.*, CASE WHEN names.key IS NULL THEN {{'present': cl.present, 'modal': cl.modal, 'spread': cl.spread, 'mean': cl.mean, 'motif': cl.motif}} ELSE {{'present': mo.present, 'modal': mo.modal, 'spread': mo.spread, 'mean': mo.mean, 'motif': mo.motif}} END AS own,
  {", ".join(f"(SELECT {{'present': present, 'modal': modal, 'spread': spread, 'mean': mean, 'motif': motif}} FROM classes WHERE te_class = '{k}') AS m_{k}" for k in ("LINE", "SINE", "LTR", "DNA", "RC", "Unknown"))}
  FROM c LEFT JOIN names USING (superfamily) LEFT JOIN models mo ON mo.key = names.key LEFT JOIN classes cl ON cl.te_class = c.te_class),
t AS (SELECT *, {", ".join(f"({e}) AS in_{k}" for k, e in _IN.items())}, ({_EN}) AS en, ({_tsd_sql("own")}) AS own_tsd, {", ".join(f"({_tsd_sql(f'm_{k}')}) AS tsd_{k}" for k in ("LINE", "SINE", "LTR", "DNA", "RC", "Unknown"))} FROM m),
r AS (SELECT k, line, CASE WHEN te_class = 'NonTE' THEN least(sequence, 0) + ln(0.01) WHEN aligned_len <= 0 OR identity <= 0 THEN ln(0.05)
    WHEN te_class = 'Unknown' THEN sequence + {_LSE2(*(f"(ln({w}) + in_{k})" for k, w in mechanism.CLASS_PRIOR.items()))} ELSE sequence + CASE te_class {" ".join(f"WHEN '{k}' THEN in_{k}" for k in _IN)} END END AS log_vs_non_te,
  CASE WHEN te_class = 'NonTE' THEN counts WHEN aligned_len <= 0 OR identity <= 0 THEN counts + tsd_Unknown
    WHEN te_class = 'Unknown' THEN counts + {_LSE2(*(f"(ln({w}) + tsd_{k}{' + en' if k in ('LINE', 'SINE') else ''})" for k, w in mechanism.CLASS_PRIOR.items()))} ELSE counts + own_tsd + CASE WHEN te_class IN ('LINE', 'SINE', 'Retroposon') THEN en ELSE 0 END END AS log_vs_artifact FROM t)
SELECT k, line, {_six_sql("log_vs_non_te", "log_vs_artifact")}, (round(least(log_vs_non_te, log_vs_artifact), 6) + 0.0::DOUBLE)::DOUBLE AS log_score FROM r"""


@query(_LOCUS_SQL)
def locus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both likelihood ratios of every observation, by its class, unaligned, of no element, or of unknown class."""
    return mechanism.score_loci(_observe(spark, sf_dir, _LOCUS, "orders")).select("k", "line", *_six("log_vs_non_te", "log_vs_artifact", "log_score"))


_PRIMING = _KEY | {
    "element_start": "CAST((l_suppkey * 13) % 30 AS INT)", "element_end": "CAST(300 + (l_partkey * 3) % 400 AS INT)", "element_length": "CAST(300 + (l_partkey * 3) % 400 + (l_orderkey % 3) * 4 AS INT)", "identity": "0.5 + CAST(l_orderkey % 51 AS DOUBLE) / 100",
    "family": _pick("l_orderkey", _q("L1", "Alu", "SVA", "pseudogene", "HERV")), "inverted": "l_partkey % 5 = 0", "tsd_len": "CAST((l_orderkey + l_linenumber) % 17 AS INT)", "tsd_mismatches": "CAST(l_partkey % 3 AS INT)",
    "t_tract": "CAST(l_orderkey % 13 AS INT)", "polya_len": "CAST(l_partkey % 30 AS INT)", "a_share": "CAST(l_orderkey % 11 AS DOUBLE) / 10", "t_share": "CAST(l_partkey % 8 AS DOUBLE) / 10", "repeat_share": "CASE WHEN l_partkey % 4 = 0 THEN 0.3 ELSE 0.0 END",
    "n_alt": "CAST(l_orderkey % 23 AS INT)", "n_ref": "CAST(l_partkey % 19 AS INT)",
}


def _priming_rows() -> list[tuple]:
    return [(m, prior, present, mean) for m, (prior, present, mean) in mechanism.MECHANISMS.items()]


_PRIMING_SQL = f"""
WITH o AS ({_select(_PRIMING, _ORDERS_SQL)}), mech AS (SELECT * FROM {_values(_priming_rows(), "t(mech, prior, present, mean)")}), cell AS (SELECT r, exp(-pow(ln(r) - ln(15000.0), 2) / (2 * 0.64)) / r AS w FROM ({_SPAN})),
lens AS (SELECT len, (SELECT sum(w * greatest(0.0, r - len - 100) / r) / sum(w) FROM cell) AS s FROM (SELECT DISTINCT element_end - element_start AS len FROM o)),
chance AS (SELECT tau, b, sum(exp(lgamma(tau + 1) - lgamma(j + 1) - lgamma(tau - j + 1) + j * ln(3) - tau * ln(4))) AS u FROM (SELECT DISTINCT tsd_len AS tau, tsd_mismatches AS b FROM o WHERE tsd_len > 0), range(20) t(j) WHERE j <= b AND j <= tau GROUP BY 1, 2),
x AS (SELECT o.*, lens.s, n_alt + n_ref AS n, (1 - repeat_share) * coalesce(u, 1) + repeat_share AS p_null, least(0.45, 0.02 + 0.30 * greatest(greatest(0, (greatest(a_share, t_share) - 0.30) / 0.70), repeat_share)) AS eps,
  greatest(1.0, element_length - (element_end - element_start) + 1.0) AS places, least(least(t_tract, polya_len), 10) AS m FROM o JOIN lens ON lens.len = o.element_end - o.element_start LEFT JOIN chance ON tau = tsd_len AND b = tsd_mismatches),
j AS (SELECT x.*, mech.*, upper(family) IN ('ALU', 'SVA', 'PSEUDOGENE') AS trans, element_end >= element_length - 5 AS three, element_start <= 5 AS five FROM x, mech),
a AS (SELECT *, ln(prior)
  + CASE WHEN mech = 'en_independent' THEN ln(1 / greatest(1.0, element_length)) WHEN NOT three THEN ln(1e-4) WHEN mech = 'l1_5p_inverted' THEN (CASE WHEN inverted THEN 0 ELSE ln(0.02) END) WHEN inverted THEN ln(0.02)
      WHEN mech = 'l1_full_length' THEN (CASE WHEN five THEN 0 ELSE ln(0.02) END) WHEN mech = 'l1_5p_truncated' THEN (CASE WHEN five THEN ln(0.02) ELSE 0 END) ELSE 0 END
  + CASE WHEN tsd_len <= 0 THEN ln(greatest(1e-12, 1 - present)) ELSE ln(present) + ln(1 / mean) - tsd_len / mean - ln(greatest(p_null, 1e-300)) END
  + CASE WHEN mech = 'en_independent' THEN 0 WHEN m < 4 THEN ln(0.05) ELSE ln(0.95) - ln(greatest(least(1.0, sqrt(pow(greatest(t_share, 1e-6), m) * pow(greatest(a_share, 1e-6), m))), 1e-300)) END AS v FROM j
  WHERE mech = 'en_independent' OR (mech = 'trans_alu_sva') = trans),
g AS (SELECT rid, max(mx) + ln(sum(exp(v - mx))) - ln(sum(prior)) AS linkage FROM (SELECT *, max(v) OVER (PARTITION BY rid) AS mx FROM a) GROUP BY 1),
c AS (SELECT *, least(greatest(0.5 * s + 0.5 * eps, 1e-12), 1 - 1e-12) AS mu1, least(greatest(s, 1e-12), 1 - 1e-12) AS mu2, least(greatest(identity, 0.61), 0.9995) AS q FROM x),
r AS (SELECT rid, k, line, CASE WHEN n <= 0 THEN 0 ELSE {_LSE2(f"ln(2.0 / 3) + {_BB('n_alt', 'n', 'mu1 * 49', '(1 - mu1) * 49')}", f"ln(1 - 2.0 / 3) + {_BB('n_alt', 'n', 'mu2 * 49', '(1 - mu2) * 49')}")} - {_BB('n_alt', 'n', 'eps * 49', '(1 - eps) * 49')} END AS log_counts,
  CASE WHEN identity < 0.60 THEN ln(0.5) - ln(0.5) - 2.0 ELSE (element_end - element_start) * (q * ln(0.98 / 0.88) + (1 - q) * ln(0.02 / 0.12)) END + ln((CASE WHEN element_end >= element_length - 5 THEN 0.98 ELSE 0 END) + 0.02 / places) + ln(places) AS log_vs_non_te FROM c)
SELECT k, line, {_six_sql("log_counts", "log_vs_non_te")}, (round(linkage + log_counts, 6) + 0.0::DOUBLE)::DOUBLE AS log_vs_artifact FROM r JOIN g USING (rid)"""


@query(_PRIMING_SQL)
def priming_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier model of target-primed insertion: a mixture over the mechanisms that the family allows."""
    return mechanism.evaluate_priming(_observe(spark, sf_dir, _PRIMING, "orders")).select("k", "line", *_six("log_counts", "log_vs_non_te", "log_vs_artifact"))


_HEADERS = "Alu#SINE/Alu L1HS#LINE/L1 x#DNA/DTA y#LTR/RLG MITE1#MITE/DHH L1:L1PA2 hAT-5:Charlie Gypsy-12_LTR iguana i-2 P_elem sat#Satellite u#Unknown/Copia v#Unspecified herv9#LTR/ERV1 SVA_E q#/odd z# zz#DNA tRNA-x Penelope1 5S-deu-L2a".split()
_HEADER = {"k": "p_partkey", "header": _pick("p_partkey", [f"'{h}'" for h in _HEADERS]) + " || ' ' || p_name"}
_SUPER_ROWS = [(name, c) for c, names in taxonomy.SUPERFAMILIES.items() for name in names.split()]
_LABEL_ROWS = [(name, c) for c, names in taxonomy.LABELS.items() for name in names.split()]
_WICKER_ROWS = [(k, *v.split()) for k, v in taxonomy.WICKER.items()]


def _super_sql(name: str) -> str:
    """The class of a superfamily's name: code, whole name, or longest prefix."""
    n = f"lower({name})"
    prefix = f"(SELECT c FROM sup WHERE starts_with({n}, key) AND (length(key) >= 2 OR regexp_matches(substr({n}, length(key) + 1, 1), '[-_.0-9]')) ORDER BY length(key) DESC, key LIMIT 1)"
    return f"coalesce((SELECT c FROM wick WHERE code = upper({name})), (SELECT c FROM sup WHERE key = {n}), {prefix})"


LIBRARY_SQL = f"""
WITH sup AS (SELECT * FROM {_values(_SUPER_ROWS, "t(key, c)")}), lab AS (SELECT * FROM {_values(_LABEL_ROWS, "t(key, c)")}), wick AS (SELECT * FROM {_values(_WICKER_ROWS, "t(code, c, named)")}),
h AS (SELECT k, regexp_extract(header, '^[^ ]+') AS token FROM ({_select(_HEADER, "part")})),
p AS (SELECT token, CASE WHEN contains(token, '#') THEN split_part(token, '#', 1) WHEN contains(token, ':') THEN split_part(token, ':', 2) ELSE token END AS name, CASE WHEN contains(token, '#') THEN substr(token, strpos(token, '#') + 1) ELSE '' END AS r FROM (SELECT DISTINCT token FROM h)),
q AS (SELECT *, CASE WHEN NOT contains(token, '#') OR r = '' THEN 'NA' WHEN NOT contains(r, '/') THEN r WHEN strpos(r, '/') > 1 THEN split_part(r, '/', 1) ELSE 'NA' END AS label, CASE WHEN contains(r, '/') THEN split_part(r, '/', 2) ELSE 'NA' END AS ord,
  CASE WHEN contains(token, '#') THEN (CASE WHEN r = '' THEN name ELSE split_part(r, '/', -1) END) WHEN contains(token, ':') THEN split_part(token, ':', 1) ELSE token END AS fam FROM p),
s AS (SELECT *, CASE WHEN ord <> 'NA' THEN ord WHEN label = 'NA' AND NOT contains(token, '#') AND contains(token, ':') THEN fam ELSE 'NA' END AS superf FROM q),
t AS (SELECT *, CASE WHEN label <> 'NA' THEN (SELECT c FROM lab WHERE key = lower(label)) END AS stated, CASE WHEN superf <> 'NA' THEN nullif({_super_sql("superf")}, 'Unknown') END AS bys, nullif({_super_sql("name")}, 'Unknown') AS byn, (SELECT c FROM wick WHERE code = upper(superf)) AS wc, coalesce((SELECT named FROM wick WHERE code = upper(superf)), superf) AS named FROM s),
u AS (SELECT *, CASE WHEN stated <> 'Unknown' AND stated <> 'NonTE' AND wc IS NOT NULL THEN wc WHEN stated <> 'Unknown' THEN stated ELSE coalesce(bys, byn, 'Unknown') END AS te_class, CASE WHEN stated <> 'Unknown' THEN 'header' WHEN bys IS NOT NULL THEN 'superfamily' WHEN byn IS NOT NULL THEN 'name' ELSE 'none' END AS source,
  CASE WHEN fam = ord AND named <> ord THEN named ELSE fam END AS f FROM t)
SELECT k, name, te_class, named AS superfamily, source, CASE WHEN starts_with(upper(f), 'ALU') THEN 'Alu' WHEN starts_with(upper(f), 'L1') THEN 'L1' WHEN starts_with(upper(f), 'SVA') THEN 'SVA' WHEN starts_with(upper(f), 'HERV') THEN 'HERV' ELSE f END AS family FROM h JOIN u USING (token)"""


@query(LIBRARY_SQL)
def library_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library headers in the classification: stated class, Wicker code, or a superfamily's longest prefix."""
    parts = _observe(spark, sf_dir, _HEADER, "part").select("k", taxonomy.name_parts(F.col("header")).alias("t"))
    return parts.select("k", "t.name", "t.te_class", "t.superfamily", "t.source", "t.family")


@query(f"WITH t AS ({LIBRARY_SQL}) SELECT te_class, source, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM t GROUP BY 1, 2")
def library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library's entries by class and by where the class came from."""
    return taxonomy.library_summary(_observe(spark, sf_dir, _HEADER, "part"), "header").withColumn("share", F.round("share", 9))


_TEXT = "'ACGTTTAAAACCGGTAAAAATTTTGCATGCAAAATAAAGAAACCCATTTTAACGGNNACGTACGTTAACGCTAATATATATGGCAGAAAAAAA'"
_ENDS_OF = {"k": "p_partkey", "s": f"substr({_TEXT}, CAST(1 + p_partkey % 61 AS INT), CAST(4 + p_partkey % 29 AS INT))", "t": f"substr({_TEXT}, CAST(1 + (p_partkey * 7) % 71 AS INT), CAST(1 + p_partkey % 17 AS INT))", "p": "CAST(p_partkey % 400 - 3 AS INT)", "n": "CAST((p_partkey * 3) % 900 - 5 AS INT)"}


@query(f"""
WITH o AS ({_select(_ENDS_OF, "part")}), w AS (SELECT *, right(s, 4) || left(t, 2) AS plus, reverse(translate(regexp_replace(right(s, 2) || left(t, 4), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) AS minus FROM o),
g AS (SELECT *, {" + ".join(f"(substr(plus, {i}, 1) = '{b}')::INT" for i, b in enumerate("TTTTAA", 1))} AS gp, {" + ".join(f"(substr(minus, {i}, 1) = '{b}')::INT" for i, b in enumerate("TTTTAA", 1))} AS gm FROM w),
d AS (SELECT *, gp * ln(0.85 / 0.25) + (6 - gp) * ln(0.05 / 0.25) AS lp, gm * ln(0.85 / 0.25) + (6 - gm) * ln(0.05 / 0.25) AS lm, list_transform(['A', 'C', 'G', 'T'], lambda c: (length(s) - length(replace(s, c, ''))) / length(s)::DOUBLE) AS p4 FROM g)
SELECT k, length(regexp_extract(s, 'A*$'))::INT AS a_run, greatest(length(regexp_extract(s, 'A*$')), length(regexp_extract(s, 'T*$')))::INT AS at_run, length(regexp_extract(reverse(s), '^(A+([^A]A{{3,}})*)'))::INT AS tail,
  (p >= 0 AND n > 0 AND abs(n - p) <= greatest(30, 0.03 * n)) AS reached, CASE WHEN length(t) >= 4 THEN round(greatest(lp, lm), 6) END AS motif, CASE WHEN length(t) >= 4 THEN (CASE WHEN lm > lp THEN '-' ELSE '+' END) END AS strand,
  (substr(s, 1, 1) = 'T')::INT + (substr(s, 2, 1) = 'G')::INT AS tg, ((right(s, 4)[1] = 'C')::INT + (right(s, 4)[2] = 'T')::INT + (right(s, 4)[3] IN ('A', 'G'))::INT + (right(s, 4)[4] IN ('A', 'G'))::INT) AS ctrr,
  (round(least(1.0, greatest(0.0, -list_sum(list_transform(p4, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(4))), 6) + 0.0::DOUBLE)::DOUBLE AS entropy,
  greatest(0, floor((1 - 0.9) * greatest(length(s), length(t)) + 1e-9))::INT AS edits, CASE WHEN n <= 0 THEN 0 ELSE floor(n * 0.37 + 0.5) END::INT AS rounded FROM d""")
def sequence_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tails, ends, the nicked motif and composition of short sequences."""
    o = _observe(spark, sf_dir, _ENDS_OF, "part").withColumn("w", S.nick_motif("s", "t"))
    return o.select(
        "k", S.final_run("s", "A").alias("a_run"), S.final_at_run("s").alias("at_run"), S.tolerant_tail("s", "A", 3).alias("tail"), S.end_reached("p", "n", "n").alias("reached"), F.round("w.log_odds", 6).alias("motif"), F.col("w.strand").alias("strand"),
        S.pattern_matches(F.left("s", F.lit(2)), "TG").alias("tg"), S.pattern_matches(F.right("s", F.lit(4)), "CTRR").alias("ctrr"), (F.round(S.entropy_share("s", F.lit(0), F.length("s")), 6) + F.lit(0.0)).alias("entropy"),
        S.most_edits(F.length("s"), F.length("t"), F.lit(0.9)).alias("edits"), S.rounded_share("n", F.lit(0.37)).alias("rounded"),
    )


_CODON = {"k": "p_partkey", "s": f"substr({_TEXT}, CAST(1 + p_partkey % 61 AS INT), CAST(14 + p_partkey % 29 AS INT)) || CASE WHEN p_partkey % 9 = 0 THEN repeat('G', 85) WHEN p_partkey % 9 = 1 THEN repeat('AT', 40) ELSE '' END", "t": f"substr({_TEXT}, CAST(1 + p_partkey % 59 AS INT), CAST(14 + p_partkey % 31 AS INT))"}


@query(f"""
WITH o AS ({_select(_CODON, "part")}), w AS (SELECT *, list_filter(list_transform(range(1, length(s) - 3), lambda i: substr(s, i, 5)), lambda x: NOT contains(x, 'N')) AS five, substr(s, 1, 11) AS first, list_transform(['A', 'C', 'G', 'T'], lambda c: length(s) - length(replace(s, c, ''))) AS n4 FROM o),
r AS (SELECT rid, max(n) AS longest FROM (SELECT rid, g, count(*) AS n FROM (SELECT rid, i, c, i - row_number() OVER (PARTITION BY rid, c ORDER BY i) AS g FROM (SELECT rid, unnest(range(1, length(s) + 1)) AS i, unnest(string_split(s, '')) AS c FROM o)) GROUP BY rid, c, g) GROUP BY rid),
x AS (SELECT *, list_sum(n4) AS n, len(list_distinct(five)) / len(five)::DOUBLE AS uniq, list_sum(list_transform(n4, lambda c: CASE WHEN c > 0 THEN -(c / list_sum(n4)::DOUBLE) * log2(c / list_sum(n4)::DOUBLE) ELSE 0 END)) AS bits FROM w JOIN r USING (rid))
SELECT k, round(uniq, 9) AS uniqueness, least(first, reverse(translate(first, 'ACGT', 'TGCA'))) AS canonical, longest::INT AS longest, ((n4[1] + n4[4]) / n::DOUBLE >= 0.90 OR longest >= 80 OR bits < 1.25 OR uniq < 0.35) AS low, round(1 - levenshtein(s, t) / greatest(length(s), length(t))::DOUBLE, 9) AS identity FROM x""")
def sequence_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct k-mers, strands folded, longest runs, the low-complexity veto and edit identity of short sequences."""
    first = F.substring("s", 1, 11)
    return _observe(spark, sf_dir, _CODON, "part").select("k", F.round(seq.kmer_uniqueness("s", 5), 9).alias("uniqueness"), seq.canonical(first).alias("canonical"), seq.longest_run("s").alias("longest"), seq.low_complexity("s").alias("low"), F.round(seq.edit_identity("s", "t"), 9).alias("identity"))


_SPANS_OF = {"k": "l_orderkey", "line": "l_linenumber", "a0": "CAST(l_partkey % 50 AS INT)", "a1": "CAST(l_partkey % 50 + l_linenumber * 4 AS INT)", "b0": "CAST(l_suppkey % 60 AS INT)", "b1": "CAST(l_suppkey % 60 + l_orderkey % 30 AS INT)", "qc": _pick("l_orderkey", _q("", "A", "A|BC", "BC|A|D", "AB")), "token": _pick("l_partkey", _q("A", "B", "BC", "")), "num": _pick("l_suppkey", _q("12", "-7", "+3", "12abc", "", " 5", "0x1"))}


@query(f"""
WITH o AS ({_select(_SPANS_OF, "lineitem")}), x AS (SELECT *, greatest(0, least(a1, b1) - greatest(a0, b0)) AS both_, token <> '' AND list_contains(string_split(qc, '|'), token) AS has FROM o)
SELECT k, line, both_ AS shared, greatest(0, greatest(0, a1 - a0) - both_) AS outside, round(CASE WHEN greatest(a1, b1) - least(a0, b0) > 0 THEN both_::DOUBLE / (greatest(a1, b1) - least(a0, b0)) ELSE 0 END, 9) AS iou,
  CASE WHEN b0 < a0 THEN a0 - b0 WHEN b0 > a1 THEN b0 - a1 ELSE 0 END AS gap, has, CASE WHEN token = '' OR has THEN qc WHEN qc = '' THEN token ELSE qc || '|' || token END AS tokens, CASE WHEN regexp_full_match(num, '[+-]?[0-9]+') THEN num::BIGINT END AS number FROM x""")
def interval_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval arithmetic, token sets and strict numbers."""
    o = _observe(spark, sf_dir, _SPANS_OF)
    return o.select(
        "k", "line", S.overlap_length("a0", "a1", "b0", "b1").alias("shared"), S.outside_length("a0", "a1", "b0", "b1").alias("outside"), F.round(S.interval_iou("a0", "a1", "b0", "b1"), 9).alias("iou"), S.gap_to_point("a0", "a1", "b0").alias("gap"),
        S.has_token("qc", "token").alias("has"), S.append_token("qc", "token").alias("tokens"), S.strict_int("num").alias("number"),
    )


@query("""
WITH c AS (SELECT p_partkey AS k, p_name, list_reduce(list_prepend(14695981039346656037::UBIGINT, list_transform(range(1, 2 * strlen(p_name), 2), lambda i: ('0x' || substr(hex(encode(p_name)), i, 2))::UBIGINT)), lambda h, b: ((xor(h, b)::UHUGEINT * 1099511628211) % 18446744073709551616)::UBIGINT) AS h FROM part)
SELECT k, lpad(lower(to_hex(h)), 16, '0') AS fnv FROM c""")
def name_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of part names."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), S.fnv1a("p_name").alias("fnv"))


_COUNTS = _KEY | {"alt": "CAST(l_orderkey % 40 AS INT)", "ref": "CAST(l_partkey % 60 AS INT)", "x": "CAST(l_suppkey % 11 AS DOUBLE) / 10"}


@query(f"""
WITH o AS ({_select(_COUNTS, "lineitem")}), t AS (SELECT *, alt + ref AS n FROM o)
SELECT k, line, (round(CASE WHEN alt > 0 THEN {_BB("alt", "n", "1.0", "9.0")} - (lgamma(n + 1) - lgamma(alt + 1) - lgamma(n - alt + 1) + alt * ln(0.02) + (n - alt) * ln(0.98)) END, 6) + 0.0::DOUBLE)::DOUBLE AS minority,
  round(CASE WHEN alt > 0 THEN 1 - exp(-alt / 8.0) ELSE 0 END, 9) AS signal, round(12.0 * (0.94 * ln(least(greatest(x, 1e-6), 1 - 1e-6)) + 0.06 * ln(1 - least(greatest(x, 1e-6), 1 - 1e-6))), 6) AS shape FROM t""")
def count_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A minority allele against errors, saturating counts, and a feature's shape."""
    minority = prob.minority_log_bf("alt", "ref")
    return _observe(spark, sf_dir, _COUNTS).select("k", "line", F.when(F.col("alt") > 0, F.round(minority, 6) + F.lit(0.0)).alias("minority"), F.round(policy.count_signal("alt", 8.0), 9).alias("signal"), F.round(prob.beta_shape("x", 0.94, 12.0), 6).alias("shape"))


_SEGMENTS = _KEY | {
    "left_start": "CAST(CASE WHEN l_orderkey % 17 = 0 THEN -1 ELSE l_partkey % 1000 END AS INT)", "left_end": "CAST(l_partkey % 1000 + l_linenumber * 20 - 20 AS INT)", "right_start": "CAST(l_partkey % 1000 + l_linenumber * 20 - 20 + l_suppkey % 130 - 60 AS INT)",
    "right_end": "CAST(l_partkey % 1000 + l_linenumber * 20 + 100 AS INT)", "envelope": "CAST(l_orderkey % 90 AS INT)", "left_len": "CAST(l_orderkey % 90 AS INT)", "right_len": "CAST((l_partkey % 5) * 30 AS INT)", "left_identity": "0.8 + CAST(l_suppkey % 20 AS DOUBLE) / 100", "right_identity": "0.85 + CAST(l_orderkey % 15 AS DOUBLE) / 100",
    "has_insert": "l_partkey % 7 <> 0", "pair_valid": "l_orderkey % 3 <> 0",
}


@query(f"""
WITH o AS ({_select(_SEGMENTS, "lineitem")}), d AS (SELECT *, left_start >= 0 AND left_end >= 0 AND right_start >= 0 AND right_end >= 0 AS there, right_start - left_end AS delta FROM o),
e AS (SELECT *, there AND left_start < left_end AND right_start < right_end AS defined FROM d),
f AS (SELECT *, defined AND ((delta < 0 AND -delta BETWEEN 3 AND 50) OR delta BETWEEN 0 AND 50) AS canon FROM e), g AS (SELECT *, defined AND NOT canon AND envelope > 0 AND abs(delta) <= envelope AS near, pair_valid AND has_insert AND ((left_len > 0) <> (right_len > 0)) AS one FROM f),
h AS (SELECT *, CASE WHEN canon THEN (CASE WHEN delta < 0 THEN 'TSD' WHEN delta = 0 THEN 'BLUNT' ELSE 'SMALL_DEL' END) WHEN near THEN 'NONCANONICAL' ELSE 'NONE' END AS boundary_type, CASE WHEN canon OR near THEN abs(delta) ELSE 0 END AS boundary_len,
  CASE WHEN one THEN (CASE WHEN left_len > 0 THEN left_len ELSE right_len END) ELSE least(left_len, right_len) END AS sl, CASE WHEN one THEN (CASE WHEN left_len > 0 THEN left_identity ELSE right_identity END) ELSE least(left_identity, right_identity) END AS si FROM g)
SELECT k, line, boundary_type, boundary_len, CASE WHEN NOT there THEN 'REJECT_BOUNDARY_MISSING_REF_SEGMENTS' WHEN NOT defined THEN 'REJECT_BOUNDARY_INVALID_REF_SEGMENTS' WHEN canon THEN 'PASS_BOUNDARY_' || boundary_type WHEN near THEN 'PASS_BOUNDARY_NONCANONICAL_CONSISTENT' WHEN delta < 0 THEN 'REJECT_BOUNDARY_TSD_RANGE' ELSE 'REJECT_BOUNDARY_DEL_RANGE' END AS boundary_qc,
  round(CASE boundary_type WHEN 'BLUNT' THEN 1.0 WHEN 'TSD' THEN least(1.2, greatest(-2.0, 1.2 - 0.5 * pow((ln(boundary_len) - ln(12.0)) / 0.7, 2))) WHEN 'SMALL_DEL' THEN least(0.8, greatest(0.2, 0.8 - boundary_len / 80.0)) WHEN 'NONCANONICAL' THEN 0.25 ELSE -2.0 END, 6)::DOUBLE AS boundary_score,
  (round(0.5 * least(2.0, greatest(-2.0, (sl - 50.0) / 25.0)) + 0.5 * least(2.0, greatest(-2.0, (si - 0.90) / 0.05)) - CASE WHEN one THEN 0.5 WHEN left_len <= 0 OR right_len <= 0 THEN 1.0 ELSE 0 END - CASE WHEN pair_valid THEN 0 ELSE 1.5 END, 6) + 0.0::DOUBLE)::DOUBLE AS segmentation_score FROM h""")
def boundary_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The junction's geometry and the split into flanks and insert."""
    o = policy.boundary(_observe(spark, sf_dir, _SEGMENTS))
    c = F.col
    o = o.withColumn("segmentation_score", policy.segmentation_score(c("left_len"), c("right_len"), c("left_identity"), c("right_identity"), c("has_insert"), c("pair_valid")))
    return o.select("k", "line", "boundary_type", "boundary_len", "boundary_qc", *_six("boundary_score", "segmentation_score"))


_CASE = _KEY | {
    "alt_reads": "CAST(l_orderkey % 25 AS INT)", "alt_split": "CAST(CASE WHEN l_partkey % 9 = 0 THEN -1 ELSE l_partkey % 5 END AS INT)", "alt_indel": "CAST(CASE WHEN l_partkey % 9 = 0 THEN -1 ELSE l_suppkey % 7 END AS INT)", "alt_left_clip": "CAST(CASE WHEN l_partkey % 9 = 0 THEN -1 ELSE l_orderkey % 4 END AS INT)",
    "alt_right_clip": "CAST(CASE WHEN l_partkey % 9 = 0 THEN -1 ELSE l_linenumber % 4 END AS INT)", "ref_reads": "CAST(l_partkey % 22 AS INT)", "gq": "CAST(l_suppkey * 3 % 100 AS INT)", "af": "CAST(l_orderkey % 11 AS DOUBLE) / 10", "existence_score": "CAST(l_suppkey * 3 % 100 AS DOUBLE) / 20 - 1",
    "has_insert": "l_orderkey % 8 <> 0", "insert_len": "CAST(CASE WHEN l_orderkey % 8 <> 0 THEN 50 + l_partkey % 3000 ELSE 0 END AS INT)", "pair_valid": "l_partkey % 4 <> 0", "has_left": "l_orderkey % 6 <> 0", "has_right": "l_suppkey % 5 <> 0", "segmentation_score": "CAST(l_linenumber AS DOUBLE) / 2 - 2",
    "aligned": "l_orderkey % 5 <> 1", "te_qc": _pick("(l_orderkey + l_linenumber)", _q(policy.PASS_FULL, policy.PASS_FAMILY, policy.PASS_UNKNOWN, policy.LOW_IDENTITY, policy.NO_ALIGNMENT, "OTHER")), "family": _pick("l_partkey", _q("L1", "Alu", "UNKNOWN", "ERV1", "hAT")), "subfamily": _pick("l_suppkey", _q("L1HS", "UNKNOWN", "NA", "AluYa5")),
    "identity": "0.4 + CAST(l_orderkey % 61 AS DOUBLE) / 100", "coverage": "CAST(l_partkey % 21 AS DOUBLE) / 20", "family_margin": "CAST(l_suppkey % 9 AS DOUBLE) / 20", "model_label": _pick("(l_partkey + l_linenumber)", _q("TE_MODEL_IN_DISTRIBUTION", "TE_MODEL_EDGE", "TE_MODEL_OUTLIER", "TE_MODEL_UNAVAILABLE")), "model_score": "CAST(l_orderkey % 9 AS DOUBLE) / 8",
    "confidence": _pick("l_linenumber", _q("HIGH", "MEDIUM", "LOW", "NA")), "residual_share": "CAST(l_orderkey % 13 AS DOUBLE) / 15", "masked_share": "CAST(l_partkey % 10 AS DOUBLE) / 12", "te_class": _pick("l_partkey", _q("LINE", "SINE", "Unknown", "LTR", "DNA")),
    "geometry_defined": "l_suppkey % 6 <> 0", "canonical_pass": "l_suppkey % 6 <> 0 AND l_orderkey % 4 <> 0", "evidence_consistent": "l_suppkey % 6 <> 0 AND (l_orderkey % 4 <> 0 OR l_partkey % 2 = 0)", "boundary_type": _pick("l_orderkey", _q("NONE", "TSD", "BLUNT", "SMALL_DEL")), "boundary_score": "CAST(l_orderkey % 7 AS DOUBLE) / 3 - 1",
    "clip_pass": "l_partkey % 3 = 0", "clip_full": "CAST(l_orderkey % 3 AS INT)", "clip_left": "CAST(l_suppkey % 3 AS INT)", "clip_right": "CAST(l_linenumber % 3 AS INT)", "te_evidence": "CAST(l_orderkey % 37 AS DOUBLE) / 6 - 2", "non_te_evidence": "CAST(l_partkey % 23 AS DOUBLE) / 10 - 1.5", "artifact_evidence": "CAST(l_suppkey % 19 AS DOUBLE) / 10 - 1",
    "path_confidence": "CAST(l_partkey % 11 AS DOUBLE) / 10", "unexplained_bp": "CAST(l_partkey % 400 AS INT)",
}
_U = lambda x: f"least(1.0, greatest(0.0, {x}))"
_CL = lambda x, lo, hi: f"least({hi}, greatest({lo}, {x}))"
_SIG = lambda n, s: f"(CASE WHEN {n} <= 0 THEN 0 ELSE 1 - exp(-{n} / {s}) END)"
_CASE_SQL = f"""o AS ({_select(_CASE, "lineitem")}),
b AS (SELECT *, greatest(0, alt_reads) AS alt, greatest(0, ref_reads) AS ref, (alt_split >= 0 OR alt_indel >= 0 OR alt_left_clip >= 0 OR alt_right_clip >= 0) AS broken, pair_valid AND has_insert AND (has_left <> has_right) AS one,
  pair_valid AND has_left AND has_right AND geometry_defined AND (canonical_pass OR evidence_consistent) AS closed, CASE WHEN clip_pass THEN clip_full + least(clip_left, clip_right) ELSE 0 END AS clips FROM o),
a AS (SELECT *, CASE WHEN broken THEN greatest(0, alt_split) + greatest(0, alt_indel) ELSE alt_reads END AS precise, CASE WHEN broken THEN least(greatest(0, alt_left_clip), greatest(0, alt_right_clip)) ELSE alt_reads END AS bilateral, CASE WHEN one THEN greatest(0.25, segmentation_score) ELSE segmentation_score END AS seg FROM b)"""
_STATE_ROWS = [(s, base, *shape, COMP.get("retro", 0.0), COMP.get("ltr", 0.0), COMP.get("dna", 0.0), COMP.get("unknown", 0.0), i) for i, (s, (base, shape)) in enumerate(policy.STATES.items()) for COMP in [policy.COMPATIBLE.get(s, {})]]
_SHAPE_COLS = [f"{k}{i}" for i in range(6) for k in ("u", "z")]


@query(f"""
WITH {_CASE_SQL}, f0 AS (SELECT *, sqrt({_SIG("(precise + bilateral + clips)", "4.0")} * CASE WHEN alt > 0 THEN {_U("(precise + bilateral + clips) / alt::DOUBLE")} ELSE 0 END) AS x2, {_U("identity")} AS x0, {_U("gq / 60.0")} AS x3,
  {_U(f"greatest(CASE WHEN alt + ref > 0 THEN ref / (alt + ref)::DOUBLE ELSE 0 END, 0.60 * {_SIG('ref', '8.0')}, CASE WHEN one AND ref > 0 THEN 0.35 ELSE 0 END)")} AS x5,
  CASE WHEN (lower(family) IN ('', 'unknown', 'na', 'none') AND lower(subfamily) IN ('', 'unknown', 'na', 'none')) OR te_class = 'Unknown' THEN 'unknown' WHEN te_class IN ('LINE', 'SINE') THEN 'retro' WHEN te_class = 'LTR' THEN 'ltr' WHEN te_class = 'DNA' THEN 'dna' ELSE 'other' END AS kind FROM a),
f1 AS (SELECT *, {_U(f"0.35 * {_SIG('alt', '8.0')} + 0.30 * x2 + 0.20 * {_U('(seg + 1) / 3')} + 0.15 * {_U('af')}")} AS x1,
  {_U("greatest(CASE WHEN NOT has_insert OR model_label = 'TE_MODEL_OUTLIER' THEN 1.0 ELSE 0 END, CASE WHEN model_label = 'TE_MODEL_EDGE' THEN 0.45 ELSE 0 END, CASE WHEN NOT geometry_defined AND NOT one THEN 0.35 ELSE 0 END, CASE WHEN geometry_defined AND NOT canonical_pass AND NOT evidence_consistent THEN 0.5 ELSE 0 END, CASE WHEN confidence = 'LOW' THEN 0.35 ELSE 0 END, 0.80 * x5)")} AS x4 FROM f0),
f2 AS (SELECT *, {_CL("0.30 * x0 + 0.25 * x1 + 0.20 * x2 + 0.15 * x3 + CASE WHEN kind = 'unknown' THEN 0 ELSE 0.10 END - 0.30 * x4 - 0.10 * x5", "0.02", "0.98")} AS act FROM f1),
st AS (SELECT * FROM {_values(_STATE_ROWS, f"t(state, base, {', '.join(_SHAPE_COLS)}, retro, ltr, dna, unk, ord)")}),
l AS (SELECT rid, k, line, x2, x5, state, ord, ends_with(state, '_te') AS te, base + ln(act / (1 - act)) * CASE WHEN ends_with(state, '_te') THEN 0.55 ELSE -0.20 END
  + CASE WHEN state = 'degraded_unknown_te' THEN (CASE WHEN kind = 'unknown' THEN 0.40 WHEN x0 < 0.75 THEN 0.20 ELSE 0 END) ELSE CASE kind WHEN 'retro' THEN retro WHEN 'ltr' THEN ltr WHEN 'dna' THEN dna WHEN 'unknown' THEN unk ELSE 0 END END
  + {" + ".join(f"z{i} * (u{i} * ln({_CL(f'x{i}', '1e-6', '1 - 1e-6')}) + (1 - u{i}) * ln(1 - {_CL(f'x{i}', '1e-6', '1 - 1e-6')}))" for i in range(6))} AS v FROM f2, st),
m AS (SELECT *, max(v) OVER (PARTITION BY rid) AS mx FROM l),
g AS (SELECT any_value(k) AS k, any_value(line) AS line, arg_max(state, {{'v': v, 'o': -ord}}) AS latent_mechanism, sum(CASE WHEN te THEN exp(v - mx) END) / sum(exp(v - mx)) AS te_share, sum(CASE WHEN NOT te THEN exp(v - mx) END) / sum(exp(v - mx)) AS lfdr,
  sum(CASE WHEN NOT te THEN exp(v - mx + 0.95 + 1.65 * (1 - x2) + 0.55 * x5) END) / (sum(CASE WHEN NOT te THEN exp(v - mx + 0.95 + 1.65 * (1 - x2) + 0.55 * x5) END) + sum(CASE WHEN te THEN exp(v - mx - 0.95 - 2.60 * (1 - x2) - 0.75 * x5) END)) AS worst_lfdr FROM m GROUP BY rid)
SELECT k, line, latent_mechanism, {_six_sql("te_share", "lfdr", "worst_lfdr")}, CASE WHEN worst_lfdr <= 0.1 THEN 'PASS_TE_LFDR' ELSE 'TE_LFDR_HIGH' END AS lfdr_qc FROM g""")
def latent_mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six mechanisms' posterior and its worst case."""
    return policy.latent_mechanism(policy.latent_features(_observe(spark, sf_dir, _CASE))).select("k", "line", "latent_mechanism", *_six("te_share", "lfdr", "worst_lfdr"), "lfdr_qc")


@query(f"""
WITH {_CASE_SQL}, s0 AS (SELECT *, {_CL(f"0.65 * {_CL('ln(alt + 1) - ln(ref + 1)', '-2.0', '2.0')} + 0.45 * {_CL('ln(precise + bilateral + 1)', '0.0', '2.0')} + {_CL('(gq - 20.0) / 40.0', '0.0', '1.5')}", "-2.0", "3.0")} AS st, {_CL("seg", "-2.0", "2.0")} AS sg,
  {_CL(f'''CASE te_qc WHEN '{policy.PASS_FULL}' THEN 1.2 + 3.0 * ({_U("identity")} - 0.78) + 1.4 * ({_U("coverage")} - 0.72) + least(1.0, 2.0 * {_U("family_margin")}) WHEN '{policy.PASS_FAMILY}' THEN 0.65 + 2.2 * ({_U("identity")} - 0.68) + 1.0 * ({_U("coverage")} - 0.55) + least(0.7, 1.5 * {_U("family_margin")})
    WHEN '{policy.PASS_UNKNOWN}' THEN -0.45 + 1.9 * ({_U("identity")} - 0.55) + 0.9 * ({_U("coverage")} - 0.70) + least(0.45, {_U("family_margin")}) WHEN '{policy.LOW_IDENTITY}' THEN -0.85 + 1.4 * ({_U("identity")} - 0.50) + 0.6 * ({_U("coverage")} - 0.40) ELSE CASE WHEN aligned THEN -1.5 ELSE -2.0 END END
    + CASE model_label WHEN 'TE_MODEL_IN_DISTRIBUTION' THEN 0.55 + {_CL("model_score", "0.0", "0.5")} WHEN 'TE_MODEL_EDGE' THEN -0.25 WHEN 'TE_MODEL_OUTLIER' THEN -1.0 ELSE 0 END + CASE confidence WHEN 'LOW' THEN -0.65 WHEN 'MEDIUM' THEN -0.20 WHEN 'HIGH' THEN 0.25 ELSE 0 END - 0.8 * {_U("residual_share")} - 0.3 * {_U("masked_share")}''', "-3.0", "3.0")} AS sq,
  CASE WHEN closed THEN 1.0 WHEN one AND has_insert THEN -0.35 WHEN geometry_defined AND evidence_consistent THEN 0.25 ELSE -1.0 END AS bd, te_qc = '{policy.PASS_UNKNOWN}' OR family = 'UNKNOWN' OR subfamily = 'UNKNOWN' AS unk FROM a),
s1 AS (SELECT *, CASE WHEN has_insert THEN 0 ELSE 1.6 END + CASE WHEN one THEN 1.1 ELSE 0 END + CASE WHEN NOT geometry_defined OR (NOT canonical_pass AND NOT evidence_consistent) THEN 0.9 ELSE 0 END
  + CASE WHEN unk THEN 0.45 * {_CL("(0.62 - " + _U("identity") + ") / 0.16", "0.0", "1.0")} + 0.20 * {_CL("(0.90 - " + _U("coverage") + ") / 0.40", "0.0", "1.0")} + 0.15 * {_CL("(0.05 - " + _U("family_margin") + ") / 0.05", "0.0", "1.0")} + CASE confidence WHEN 'LOW' THEN 0.5 WHEN 'MEDIUM' THEN 0.2 ELSE 0 END ELSE 0 END
  + CASE WHEN precise = 0 AND bilateral = 0 THEN 0.5 ELSE 0 END + least(1.0, ref * 0.08) AS cx FROM s0),
s2 AS (SELECT *, -0.25 + st + 0.75 * sg + sq + bd - 0.35 * cx AS lt, 0.10 + 0.85 * st + 0.60 * sg - 0.75 * sq + CASE WHEN has_insert THEN 0.25 ELSE -0.75 END AS ln_, -0.10 + cx - 0.25 * st - 0.15 * sg - 0.35 * greatest(sq, 0) AS la FROM s1),
s3 AS (SELECT *, exp(lt - greatest(lt, ln_, la)) AS et, exp(ln_ - greatest(lt, ln_, la)) AS en, exp(la - greatest(lt, ln_, la)) AS ea FROM s2),
s4 AS (SELECT *, et / (et + en + ea) AS te_posterior, en / (et + en + ea) AS non_te_posterior, ea / (et + en + ea) AS artifact_posterior, lt - la AS te_vs_artifact, lt - ln_ AS te_vs_non_te FROM s3)
SELECT k, line, {_six_sql("te_posterior", "non_te_posterior", "artifact_posterior", "te_vs_artifact", "te_vs_non_te")},
  CASE WHEN te_posterior >= CASE WHEN closed THEN 0.65 ELSE 0.72 END AND te_vs_artifact >= CASE WHEN closed THEN 0.75 ELSE 1.25 END AND te_vs_non_te >= CASE WHEN unk THEN 0.55 ELSE 0.25 END THEN 'PASS_TE_POSTERIOR' ELSE 'NO_TE_POSTERIOR' END AS posterior_qc FROM s4""")
def local_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element, other insertion or artifact: three scores and their shares."""
    return policy.local_posterior(_observe(spark, sf_dir, _CASE)).select("k", "line", *_six("te_posterior", "non_te_posterior", "artifact_posterior", "te_vs_artifact", "te_vs_non_te"), "posterior_qc")


@query(f"""
WITH {_CASE_SQL}, c0 AS (SELECT *, has_insert AND NOT pair_valid AND (has_left <> has_right) AS solo, greatest(0, alt_split) + greatest(0, alt_indel) + least(greatest(0, alt_left_clip), greatest(0, alt_right_clip)) + clips AS reads FROM a),
c1 AS (SELECT *, CASE WHEN alt <= 0 OR reads <= 0 THEN 0 ELSE sqrt({_SIG("reads", "4.0")} * {_U("reads / alt::DOUBLE")}) END AS ind, {_U(f"greatest(CASE WHEN alt + ref > 0 THEN ref / (alt + ref)::DOUBLE ELSE 0 END, 0.60 * {_SIG('ref', '8.0')}, CASE WHEN solo AND ref > 0 THEN 0.35 ELSE 0 END)")} AS ref_conflict,
  CASE WHEN NOT aligned AND te_qc <> '{policy.LOW_IDENTITY}' THEN 0 ELSE {_U(f'''0.48 * {_U("identity")} + 0.32 * {_U("coverage")} + 0.20 * {_U("family_margin * 4")} + CASE te_qc WHEN '{policy.PASS_FULL}' THEN 0.15 WHEN '{policy.PASS_FAMILY}' THEN 0.08 WHEN '{policy.PASS_UNKNOWN}' THEN -0.08 WHEN '{policy.LOW_IDENTITY}' THEN -0.25 ELSE 0 END
    + CASE model_label WHEN 'TE_MODEL_IN_DISTRIBUTION' THEN 0.12 + 0.10 * {_U("model_score")} WHEN 'TE_MODEL_EDGE' THEN -0.10 WHEN 'TE_MODEL_OUTLIER' THEN -0.45 ELSE 0 END + CASE confidence WHEN 'HIGH' THEN 0.08 WHEN 'LOW' THEN -0.12 ELSE 0 END - 0.20 * {_U("residual_share")}''')} END AS sq,
  CASE WHEN has_insert THEN {_U('''0.20 + CASE WHEN pair_valid AND has_left AND has_right THEN 0.35 WHEN pair_valid THEN 0.20 WHEN has_left <> has_right THEN 0.10 ELSE 0 END + CASE WHEN has_left <> has_right THEN 0.05 ELSE 0 END + CASE WHEN geometry_defined AND canonical_pass THEN 0.35 WHEN geometry_defined AND evidence_consistent THEN 0.22 WHEN NOT geometry_defined THEN -0.10 ELSE 0 END
    + CASE boundary_type WHEN 'TSD' THEN 0.15 WHEN 'BLUNT' THEN 0.05 WHEN 'SMALL_DEL' THEN 0.05 ELSE 0 END''')} ELSE 0 END AS bd FROM c0),
c2 AS (SELECT *, {_U(f"0.45 * {_SIG('alt', '8.0')} + 0.30 * ind + 0.15 * {_U('gq / 60.0')} + 0.10 * {_U('af')}")} AS ev,
  {_U("greatest(0.80 * ref_conflict, CASE WHEN has_insert THEN 0 ELSE 1.0 END, CASE model_label WHEN 'TE_MODEL_OUTLIER' THEN 0.90 WHEN 'TE_MODEL_EDGE' THEN 0.45 ELSE 0 END, CASE WHEN geometry_defined AND NOT canonical_pass AND NOT evidence_consistent THEN 0.55 ELSE 0 END, CASE WHEN confidence = 'LOW' THEN 0.35 ELSE 0 END)")} AS artifact_context FROM c1),
c3 AS (SELECT *, -0.75 + 3.0 * ev - 2.2 * ref_conflict AS e, -1.0 + 4.0 * ind - 1.2 * ref_conflict AS i, -1.4 + 4.2 * sq - artifact_context AS s, -0.7 + 2.4 * bd - 0.7 * ref_conflict AS b_, -3.0 * ref_conflict - 0.8 * artifact_context AS r, {_CL("te_evidence - greatest(non_te_evidence, artifact_evidence)", "-4.0", "5.0")} AS t,
  0.18 + 0.45 * (1 - {_U("path_confidence")}) + 0.30 * CASE WHEN insert_len > 0 THEN {_U("unexplained_bp / insert_len::DOUBLE")} ELSE 1.0 END AS w FROM c2),
c4 AS (SELECT *, e + i + s + 0.9 * t + b_ + r AS lower_te_vs_artifact, 0.4 * e + 0.7 * i + s + 0.9 * t + 0.85 * b_ + 0.35 * r AS lower_te_vs_non_te, ((0.25 + 0.30 * (1 - ev)) + (0.30 + 0.45 * (1 - ind)) + (0.25 + 0.40 * (1 - sq)) + w + (0.20 + 0.35 * (1 - bd)) + (0.20 + 0.50 * ref_conflict)) / 6 AS ambiguity FROM c3),
c5 AS (SELECT *, 1.25 / greatest(1e-12, 1.25 + exp({_CL("least(lower_te_vs_artifact, lower_te_vs_non_te) - ambiguity", "-60.0", "60.0")}) * greatest({_CL("0.05 * (1 - 0.7 * artifact_context)", "0.005", "0.05")}, 1e-12)) AS robust_lfdr FROM c4)
SELECT k, line, {_six_sql("ref_conflict", "artifact_context", "lower_te_vs_artifact", "lower_te_vs_non_te", "ambiguity", "robust_lfdr")}, CASE WHEN robust_lfdr <= 0.1 THEN 'PASS_TE_LFDR' ELSE 'TE_LFDR_HIGH' END AS robust_qc FROM c5""")
def evidence_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six blocks' lower factors, their ambiguity, and the robust rate under the prior of the context."""
    return policy.robust_lfdr(policy.certificate(_observe(spark, sf_dir, _CASE))).select("k", "line", *_six("ref_conflict", "artifact_context", "lower_te_vs_artifact", "lower_te_vs_non_te", "ambiguity", "robust_lfdr"), "robust_qc")


@query(f"""
WITH {_CASE_SQL}, h AS (SELECT *, NOT has_insert OR te_qc = '{policy.NO_ALIGNMENT}' OR NOT ok AS veto_u, NOT has_insert OR NOT aligned OR te_qc = '{policy.PASS_UNKNOWN}' OR NOT ok AS veto_r, CASE model_label WHEN 'TE_MODEL_IN_DISTRIBUTION' THEN 0.75 + {_CL("model_score", "0.0", "0.5")} WHEN 'TE_MODEL_OUTLIER' THEN {_CL("model_score", "-1.0", "-0.5")} ELSE 0 END AS mo,
  CASE WHEN ref_reads = 0 AND alt_reads >= 3 THEN greatest(0, existence_score) ELSE existence_score END AS ex0, CASE WHEN NOT geometry_defined AND one THEN 0 ELSE boundary_score END AS bs
  FROM (SELECT *, CASE confidence WHEN 'LOW' THEN residual_share <= 0.5 AND masked_share <= 0.65 WHEN 'MEDIUM' THEN residual_share <= 0.65 AND masked_share <= 0.80 ELSE true END AS ok FROM a)),
i AS (SELECT *, CASE WHEN pair_valid AND has_insert AND mo >= 0.75 AND alt_reads > 0 AND alt_reads >= ref_reads THEN greatest(0, ex0) ELSE ex0 END AS ex FROM h),
j AS (SELECT rid, k, line, unnest([{{'kind': 'REFERENCE', 'o': 0, 'total': -greatest(existence_score, 0) - 0.5 * greatest(seg, 0), 'veto': false}}, {{'kind': 'NON_TE_INSERTION', 'o': 1, 'total': ex + 0.7 * seg - 0.4 * greatest(mo, 0), 'veto': false}},
  {{'kind': 'TE_UNKNOWN', 'o': 2, 'total': ex + 0.8 * seg + mo + 0.2 * bs, 'veto': veto_u}}, {{'kind': 'TE_RESOLVED', 'o': 3, 'total': ex + 0.8 * seg + mo + 0.2 * bs, 'veto': veto_r}}]) AS x FROM i),
n AS (SELECT rid, k, line, x.kind AS kind, x.total AS total, row_number() OVER (PARTITION BY rid ORDER BY CASE WHEN x.veto THEN -1e9 ELSE x.total END DESC, x.o DESC) AS place FROM j)
SELECT any_value(k) AS k, any_value(line) AS line, max(CASE WHEN place = 1 THEN kind END) AS best, max(CASE WHEN place = 2 THEN kind END) AS runner_up, (round(max(CASE WHEN place = 1 THEN total END), 6) + 0.0::DOUBLE)::DOUBLE AS total FROM n GROUP BY rid""")
def hypothesis_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four hypotheses ranked, with their vetoes."""
    r = policy.rank_hypotheses(_observe(spark, sf_dir, _CASE))
    return r.select("k", "line", F.col("ranked")[0]["kind"].alias("best"), F.col("ranked")[1]["kind"].alias("runner_up"), (F.round(F.col("ranked")[0]["total"], 6) + F.lit(0.0)).alias("total"))


@query()
def joint_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole decision; its comparison of explanations is no total order, so it has no SQL and is held against a plain one."""
    return policy.decide(_observe(spark, sf_dir, _CASE)).select("k", "line", "best_explanation", "explanation_alone", "final_qc", "decision", "emit_te", "emit_unknown", "emit_evidence", "emit_structural", *_six("structural_log_evidence"))


_INSERTS = {
    "k": "p_partkey", "insert": f"substr({_TEXT}, CAST(1 + p_partkey % 31 AS INT), CAST(20 + p_partkey % 41 AS INT)) || repeat('A', CAST(p_partkey % 14 AS INT))", "strand": _pick("p_partkey", _q("+", "+", "NA", "-")), "consensus_start": "CAST(p_partkey % 60 AS INT)", "consensus_end": "CAST(p_size * 12 AS INT)", "element_length": "CAST(p_size * 12 + p_partkey % 70 AS INT)",
    "core_start": "CAST(p_partkey % 5 - 1 AS INT)", "core_end": "CAST(p_partkey % 60 AS INT)",
}


@query(f"""
WITH o AS ({_select(_INSERTS, "part")}), s AS (SELECT *, CASE WHEN strand = '-' THEN reverse(translate(regexp_replace(insert, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) ELSE insert END AS q FROM o),
t AS (SELECT *, length(q) AS n, length(regexp_extract(reverse(q), '^(A+([^A]A{{3,}})*)')) AS ta, length(regexp_extract(reverse(q), '^(T+([^T]T{{3,}})*)')) AS tt FROM s),
u AS (SELECT *, CASE WHEN (CASE WHEN strand IN ('+', '-') THEN ta ELSE greatest(ta, tt) END) < 6 THEN 0 ELSE (CASE WHEN strand IN ('+', '-') THEN ta ELSE greatest(ta, tt) END) END AS tail, CASE WHEN core_start >= 0 AND core_start < core_end AND core_end <= n THEN substr(q, core_start + 1, core_end - core_start) ELSE q END AS core FROM t),
v AS (SELECT *, left(core, 20) AS fst, reverse(translate(regexp_replace(right(core, 20), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) AS lst FROM u)
SELECT k, tail::INT AS polya_len, (CASE WHEN core_end >= 0 AND core_end <= n THEN greatest(0, n - tail - core_end) ELSE -1 END)::INT AS transduction_len, element_length > 0 AND abs(consensus_start) <= greatest(30, 0.03 * element_length) AS five_whole, element_length > 0 AND abs(element_length - consensus_end) <= greatest(30, 0.03 * element_length) AS three_whole,
  CASE WHEN length(core) >= 4 THEN (core[1] = 'T')::INT + (core[2] = 'G')::INT ELSE -1 END AS ltr_start, CASE WHEN length(core) >= 4 THEN (core[-2] = 'C')::INT + (core[-1] = 'A')::INT ELSE -1 END AS ltr_end,
  CASE WHEN length(core) >= 4 THEN (core[1] = 'T')::INT + (core[2] = 'C')::INT ELSE -1 END AS helitron_start, CASE WHEN length(core) >= 4 THEN (core[-4] = 'C')::INT + (core[-3] = 'T')::INT + (core[-2] IN ('A', 'G'))::INT + (core[-1] IN ('A', 'G'))::INT ELSE -1 END AS helitron_end,
  round(CASE WHEN length(core) >= 40 THEN len(list_filter(range(1, 21), lambda i: fst[i] = lst[i])) / 20.0 ELSE -1 END, 6)::DOUBLE AS tir_identity FROM v""")
def element_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hallmarks of inserts in their element's orientation."""
    o = structure.measure_element(_observe(spark, sf_dir, _INSERTS, "part"))
    return o.select("k", "polya_len", "transduction_len", "five_whole", "three_whole", "ltr_start", "ltr_end", "helitron_start", "helitron_end", F.round("tir_identity", 6).alias("tir_identity"))
