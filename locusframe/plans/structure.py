"""What an insert shows of the element's own structure, and the chain that explains its sequence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import prob, scalars as S, seq
from .taxonomy import MECHANISM, class_of_superfamily

# Fixed values of the measures: least tail, its interruptions, and the probe of inverted repeats.
LEAST_TAIL, RESUME, TIR_PROBE = 6, 3, 20


def known_class(te_class: Column, superfamily: Column) -> Column:
    """A class of the vocabulary, else that of the superfamily, else Unknown."""
    return F.when(te_class.isin(*MECHANISM), te_class).otherwise(F.coalesce(class_of_superfamily(superfamily), F.lit("Unknown")))


def measure_element(df: DataFrame) -> DataFrame:
    """Adds the hallmarks of an insert: polya_len, transduction_len, five_whole, three_whole, ltr_start, ltr_end, helitron_start, helitron_end, tir_identity.

    Columns: insert, strand, consensus_start, consensus_end, element_length,
    core_start, core_end (in the element's orientation; -1 where unknown). The
    tail is measured on the whole insert, the ends on its core.
    """
    c = F.col
    s = S.oriented("insert", "strand")
    known = c("strand").isin("+", "-")
    df = df.withColumn("_s", s)
    tail = F.when(known, S.tolerant_tail("_s", "A", RESUME)).otherwise(F.greatest(S.tolerant_tail("_s", "A", RESUME), S.tolerant_tail("_s", "T", RESUME)))
    df = df.withColumn("polya_len", F.when(tail < LEAST_TAIL, 0).otherwise(tail))
    n = F.length("_s")
    cored = (c("core_start") >= 0) & (c("core_start") < c("core_end")) & (c("core_end") <= n)
    df = df.withColumn("_core", F.when(cored, F.substring(c("_s"), c("core_start") + 1, c("core_end") - c("core_start"))).otherwise(c("_s")))
    long_enough, wide = F.length("_core") >= 4, F.length("_core") >= 2 * TIR_PROBE
    first, last = F.left(c("_core"), F.lit(TIR_PROBE)), seq.reverse_complement(F.right(c("_core"), F.lit(TIR_PROBE)))
    probe = lambda part, pattern: F.when(long_enough, S.pattern_matches(part, pattern)).otherwise(-1)
    df = df.withColumns({
        "transduction_len": F.when((c("core_end") >= 0) & (c("core_end") <= n), F.greatest(F.lit(0), n - c("polya_len") - c("core_end"))).otherwise(-1),
        "five_whole": S.end_reached("consensus_start", F.lit(0), "element_length"), "three_whole": S.end_reached("consensus_end", "element_length", "element_length"),
        "ltr_start": probe(F.left(c("_core"), F.lit(2)), "TG"), "ltr_end": probe(F.right(c("_core"), F.lit(2)), "CA"),
        "helitron_start": probe(F.left(c("_core"), F.lit(2)), "TC"), "helitron_end": probe(F.right(c("_core"), F.lit(4)), "CTRR"),
        "tir_identity": F.when(wide, S.place_identity(first, last)).otherwise(-1.0),
    })
    return df.drop("_s", "_core")


# The status that a reason stands for, and the states' emissions.
STATUS = {
    "TE_LIBRARY_UNAVAILABLE": "UNAVAILABLE", "EMPTY_INSERT_SEQUENCE": "EMPTY", "INSERT_SEQ_TOO_SHORT": "TOO_SHORT", "NO_TE_ALIGNMENT_SHORTLIST": "NO_CANDIDATE", "NO_TE_ALIGNMENT_MATCH": "NO_CANDIDATE",
    "NO_TE_ALIGNMENT": "NO_CANDIDATE", "PASS_INSERT_TE_ALIGNMENT": "RESOLVED", "PASS_INSERT_TE_ALIGNMENT_FAMILY_ONLY": "FAMILY_ONLY", "PASS_INSERT_TE_ALIGNMENT_CLIP_SIDES": "RESOLVED",
    "PASS_INSERT_TE_ALIGNMENT_CLIP_SIDES_FAMILY_ONLY": "FAMILY_ONLY", "PASS_INSERT_TE_ALIGNMENT_UNKNOWN": "UNKNOWN_TE", "TE_ALIGNMENT_LOW_IDENTITY": "NON_TE_LIKE", "TE_ALIGNMENT_LOW_QUERY_COVERAGE": "NON_TE_LIKE",
    "TE_ALIGNMENT_UNINFORMATIVE": "NON_TE_LIKE",
}
POLY_EACH, POLY_OPEN, TRANS_EACH, TRANS_ENTROPY, TRANS_OPEN = 1.28, -3.0, 0.06, 0.55, -1.6


def _unit(x: Column) -> Column:
    return prob.clamp(x, 0.0, 1.0)


def _logistic(x: Column) -> Column:
    return F.when(x >= 40, 1.0).when(x <= -40, 0.0).otherwise(prob.logistic(x))


def explain_sequence(df: DataFrame) -> DataFrame:
    """Adds the decode of an insert as element core, transduction, tail and low complexity.

    Columns: insert, te_qc, family, subfamily, identity, coverage, residual_share,
    masked_share, family_margin, second_score, model_label, model_score, te_class,
    te_strand. Adds status, unexplained_bp, low_complexity_bp, edit_distance,
    poly_posterior, transduction_posterior, te_evidence, non_te_evidence,
    artifact_evidence, path_confidence and path (start-end:kind:label, or NA).
    """
    c = F.col
    strand_known = c("te_strand").isin("+", "-")
    no_tail = c("te_class").isin(*(k for k, m in MECHANISM.items() if m not in ("tprt", "unknown")))
    status = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv)), c("te_qc")), F.lit("AMBIGUOUS"))
    label = lambda x, other: F.when(x.isNull() | x.isin("", "NA"), other).otherwise(x)
    df = df.withColumns({"_s": F.when(strand_known, S.oriented("insert", "te_strand")).otherwise(F.coalesce("insert", F.lit(""))), "status": status})
    df = df.withColumns({
        "_n": F.length("_s"), "_complex": F.greatest(F.lit(0.0), c("residual_share") - c("masked_share")), "_te": c("status").isin("RESOLVED", "FAMILY_ONLY", "UNKNOWN_TE", "AMBIGUOUS"),
        "_family": F.when(c("status") == "UNKNOWN_TE", "UNKNOWN").otherwise(label(c("family"), "UNKNOWN")), "_sub": F.when(c("status").isin("FAMILY_ONLY", "UNKNOWN_TE"), "UNKNOWN").otherwise(label(c("subfamily"), "UNKNOWN")),
    })
    df = df.withColumns({
        "unexplained_bp": S.rounded_share("_n", "_complex"), "low_complexity_bp": S.rounded_share("_n", "masked_share"),
        "edit_distance": S.rounded_share("_n", F.greatest(F.lit(0.0), 1 - c("identity")) * F.greatest(F.lit(0.0), c("coverage"))),
        "_core": F.when((c("_n") > 0) & c("_te"), F.greatest(F.lit(1), F.least(c("_n"), S.rounded_share("_n", "coverage")))).otherwise(0),
    })
    rest = F.greatest(F.lit(0), c("_n") - c("_core"))
    run = F.when(no_tail, 0).otherwise(F.least(rest, F.when(strand_known, S.final_run("_s", "A")).otherwise(S.final_at_run("_s"))))
    df = df.withColumn("_poly", run).withColumn("_between", F.greatest(F.lit(0), rest - c("_poly")))
    identity, coverage, masked, complex_ = _unit(c("identity")), _unit(c("coverage")), _unit(c("masked_share")), _unit(c("_complex"))
    low = F.lit(-math.inf)
    entropy = S.entropy_share("_s", "_core", c("_core") + c("_between"))
    df = df.withColumns({
        "_poly_score": F.when(no_tail, low).otherwise(c("_poly") * POLY_EACH + POLY_OPEN),
        "_trans_score": F.when(no_tail, low).otherwise(c("_between") * TRANS_EACH * (entropy - TRANS_ENTROPY) + TRANS_OPEN + 0.6 * identity),
    })
    df = df.withColumns({"poly_posterior": _logistic(c("_poly_score")), "transduction_posterior": _logistic(c("_trans_score"))})
    model = F.when(c("model_label") == "TE_MODEL_IN_DISTRIBUTION", 0.35 + 0.25 * _unit(c("model_score"))).when(c("model_label") == "TE_MODEL_EDGE", -0.15).when(c("model_label") == "TE_MODEL_OUTLIER", -0.85).otherwise(0.0)
    doubt = F.when(c("status") == "UNKNOWN_TE", 0.45).when(c("status") == "FAMILY_ONLY", 0.25).otherwise(0.0)
    te = -1.10 + 2.00 * identity + 2.45 * coverage + 0.55 * _unit(c("family_margin") * 4) + 0.55 * c("poly_posterior") + 0.35 * c("transduction_posterior") + model - 1.25 * complex_ - 0.55 * masked - doubt - F.when(c("_te"), 0.0).otherwise(2.0)
    non_te = -0.25 + 1.65 * complex_ + 0.75 * _unit(c("residual_share")) - 1.25 * coverage - 0.85 * identity - 0.25 * c("poly_posterior")
    artifact = -0.10 + 1.10 * masked + F.when(c("model_label") == "TE_MODEL_OUTLIER", 1.25).otherwise(0.0) + F.when(c("te_qc") == "TE_ALIGNMENT_LOW_IDENTITY", 0.65).otherwise(0.0) - 0.95 * coverage - 0.75 * identity
    df = df.withColumns({"te_evidence": te, "non_te_evidence": non_te, "artifact_evidence": artifact})
    df = df.withColumn("path_confidence", _logistic(c("te_evidence") - F.greatest("non_te_evidence", "artifact_evidence")))

    poly_from = c("_n") - c("_poly")
    has_trans = (c("_between") > 0) & (c("_trans_score") > 0) & (c("_core") < poly_from)
    after_trans = F.when(has_trans, poly_from).otherwise(c("_core"))
    has_poly = (c("_poly") > 0) & (c("_poly_score") > 0) & (after_trans < c("_n"))
    after_poly = F.when(has_poly, c("_n")).otherwise(after_trans)
    piece = lambda start, end, kind, label_: F.format_string(f"%d-%d:{kind}:%s", start.cast("int"), end.cast("int"), label_)
    core_label = F.when(c("status") == "UNKNOWN_TE", "UNKNOWN/UNKNOWN").otherwise(F.concat_ws("/", "_family", "_sub"))
    pieces = F.array_compact(F.array(
        piece(F.lit(0), c("_core"), "TE_CORE", core_label), F.when(has_trans, piece(c("_core"), poly_from, "TRANSDUCTION", F.lit("HIGH_COMPLEXITY_TAIL"))),
        F.when(has_poly, piece(F.greatest(after_trans, poly_from), c("_n"), "POLYA", F.concat(F.lit("POLY_"), F.right(c("_s"), F.lit(1))))),
        F.when((masked > 0.20) & (after_poly < c("_n")), piece(after_poly, c("_n"), "LOW_COMPLEXITY", F.lit("MASKED_RESIDUAL"))),
    ))
    df = df.withColumn("path", F.when(c("_te") & (c("_n") > 0), F.array_join(pieces, ",")).otherwise("NA"))
    return df.drop("_s", "_n", "_complex", "_te", "_family", "_sub", "_core", "_poly", "_between", "_poly_score", "_trans_score")
