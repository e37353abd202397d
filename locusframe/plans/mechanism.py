"""Mechanism likelihood ratios of a locus, as columns over its observation.

An observation has te_class, superfamily, identity, aligned_len, element_start,
element_end, element_length, polya_len, five_prime_complete,
three_prime_complete, tsd_len, tsd_mismatches, tsd_seq, local_a_frac,
local_repeat_frac and tsd_empirical_null. The duplication models are a small
dimension joined by longest prefix, with the class as the fallback.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import prob, seq
from ..operators import kmers

# Duplications by superfamily prefix and by class: present, modal length, spread, mean length, motif.
SUPERFAMILY_TSD = {
    "tcmar": (0.95, 2, 0.2, 0.0, "TA"), "tc1": (0.95, 2, 0.2, 0.0, "TA"), "mariner": (0.95, 2, 0.2, 0.0, "TA"), "hat": (0.95, 8, 0.2, 0.0, ""), "piggybac": (0.95, 4, 0.2, 0.0, "TTAA"),
    "mule": (0.90, 9, 0.4, 0.0, ""), "mudr": (0.90, 9, 0.4, 0.0, ""), "cmc": (0.90, 3, 0.2, 0.0, ""), "enspm": (0.90, 3, 0.2, 0.0, ""), "cacta": (0.90, 3, 0.2, 0.0, ""), "pif": (0.90, 3, 0.2, 0.0, "TAA"),
    "harbinger": (0.90, 3, 0.2, 0.0, "TAA"), "merlin": (0.90, 9, 0.4, 0.0, ""), "p": (0.90, 8, 0.2, 0.0, ""), "transib": (0.90, 5, 0.2, 0.0, ""), "kolobok": (0.90, 4, 0.2, 0.0, ""), "sola": (0.90, 4, 0.5, 0.0, ""),
    "maverick": (0.90, 6, 0.2, 0.0, ""), "polinton": (0.90, 6, 0.2, 0.0, ""), "crypton": (0.05, 0, 0.2, 0.0, ""), "erv": (0.95, 5, 0.4, 0.0, ""), "gypsy": (0.95, 5, 0.3, 0.0, ""), "copia": (0.95, 5, 0.3, 0.0, ""),
    "pao": (0.95, 5, 0.4, 0.0, ""), "bel": (0.95, 5, 0.4, 0.0, ""), "dirs": (0.05, 0, 0.2, 0.0, ""), "ngaro": (0.05, 0, 0.2, 0.0, ""), "helitron": (0.05, 0, 0.2, 0.0, ""),
}
CLASS_TSD = {
    "LINE": (0.90, 0, 0.2, 15.0, ""), "SINE": (0.85, 0, 0.2, 12.0, ""), "Retroposon": (0.85, 0, 0.2, 12.0, ""), "PLE": (0.70, 0, 0.2, 10.0, ""), "LTR": (0.95, 5, 0.4, 0.0, ""), "DNA": (0.90, 8, 0.6, 0.0, ""),
    "RC": (0.05, 0, 0.2, 0.0, ""), "Unknown": (0.60, 0, 0.2, 10.0, ""), "NonTE": (0.05, 0, 0.2, 0.0, ""),
}
TAIL_PRESENT, TAIL_MEAN = 0.85, 25.0
MODEL = "struct<present:double,modal:int,spread:double,mean:double,motif:string>"


def with_duplication_model(df: DataFrame) -> DataFrame:
    """Adds ``tsd_model``: the longest superfamily prefix (one letter only before a non-letter), else the class."""
    spark: SparkSession = df.sparkSession
    table = spark.createDataFrame([(k, v) for k, v in SUPERFAMILY_TSD.items()], f"key string, model {MODEL}")
    classes = F.broadcast(spark.createDataFrame([(k, v) for k, v in CLASS_TSD.items()], f"te_class string, _class {MODEL}"))  # nine rows
    # A letter after a one-letter key would make it another name: pad such names so that the key cannot match.
    name = F.lower(F.trim(F.coalesce("superfamily", F.lit(""))))
    keyed = df.withColumn("_key", F.when(name.rlike("^p[a-z]") & ~name.rlike("^(pif|piggybac|pao|polinton)"), F.concat(F.lit("~"), name)).otherwise(name))
    found = kmers.prefix_lookup(keyed, "_key", table, "key", "model", F.lit(None).cast(MODEL))
    return found.join(classes, "te_class", "left").withColumn("tsd_model", F.coalesce("model", "_class", class_model("Unknown"))).drop("_key", "model", "_class")


def class_model(te_class: str) -> Column:
    """The duplication model of a class as a constant."""
    present, modal, spread, mean, motif = CLASS_TSD[te_class]
    return F.struct(F.lit(present).alias("present"), F.lit(modal).alias("modal"), F.lit(spread).alias("spread"), F.lit(mean).alias("mean"), F.lit(motif).alias("motif"))


def log_p_length(model: Column, tau: Column) -> Column:
    """ln P(duplication of a length): geometric, or a modal length with a floor."""
    present = F.greatest(model["present"], F.lit(1e-6))
    geometric = F.log(model["present"]) - F.log(model["mean"]) - tau / model["mean"]
    p = F.when(tau == model["modal"], 1 - model["spread"]).when(F.abs(tau - model["modal"]) == 1, model["spread"] / 2 * 0.9).otherwise(model["spread"] * 0.1 / 50)
    return F.when(tau <= 0, F.log(F.greatest(1 - model["present"], F.lit(1e-6)))).when(model["mean"] > 0, geometric).when(model["modal"] <= 0, F.log(present) - math.log(50.0)).otherwise(F.log(model["present"]) + F.log(p))


def chance_duplication(tau: Column, mismatches: Column, repeat_share: Column) -> Column:
    """Chance that flanks look duplicated over ``tau`` bases, blended to 1 where the place is a repeat."""
    terms = F.transform(F.sequence(F.lit(0), F.greatest(mismatches, F.lit(0))), lambda j: F.exp(prob.log_choose(tau, j) + j * math.log(3.0) - tau * math.log(4.0)))
    unique = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    share = F.least(F.greatest(repeat_share, F.lit(0.0)), F.lit(1.0))
    return F.when(tau <= 0, 1.0).otherwise((1 - share) * unique + share)


def tsd_term(model: Column, tau: Column, mismatches: Column, sequence: Column, repeat_share: Column, empirical: Column) -> Column:
    """The duplication under its model against chance, at least as likely as shifted positions measure."""
    return duplication_term(model, tau, sequence, measured_chance(tau, mismatches, repeat_share, empirical))


def measured_chance(tau: Column, mismatches: Column, repeat_share: Column, empirical: Column) -> Column:
    """Chance of a duplication, at least what shifted positions measure where they do."""
    return F.greatest(chance_duplication(tau, mismatches, repeat_share), F.when(empirical > 0, empirical).otherwise(0.0))


def duplication_term(model: Column, tau: Column, sequence: Column, chance: Column) -> Column:
    """``tsd_term`` with the chance at hand."""
    upper = F.upper(sequence)
    asked = (F.length(model["motif"]) > 0) & (F.length(model["motif"]) == tau) & (F.length(sequence) > 0)
    hit = (model["motif"] == upper) | (model["motif"] == seq.reverse_complement(upper))
    motif = F.when(asked, F.when(hit, prob.robust(tau * math.log(4.0), 0.9)).otherwise(F.lit(math.log(1 - 0.9)))).otherwise(0.0)
    return F.when(tau <= 0, log_p_length(model, F.lit(0))).otherwise(log_p_length(model, tau) - F.log(F.greatest(chance, F.lit(1e-300))) + motif)


def tail_term(polya: Column, a_share: Column, weight: float) -> Column:
    """A tail of a length against the place's own A content."""
    f = F.least(F.greatest(a_share, F.lit(0.05)), F.lit(0.95))
    a = F.greatest(polya, F.lit(0))
    chance = a * F.log(f) + F.log(1 - f)
    tail = F.when(a == 0, math.log(1 - TAIL_PRESENT)).otherwise(math.log(TAIL_PRESENT / TAIL_MEAN) - a / TAIL_MEAN)
    return prob.robust(tail - chance, weight)


def ends_term(start: Column, end: Column, length: Column, five: Column, three: Column, weight: float) -> Column:
    """Both ends of an element that inserts whole, against a uniform placement."""
    n = F.greatest(F.lit(1.0), length - (end - start) + 1.0)
    one = lambda complete: F.when(complete, prob.robust(F.log(n), weight)).otherwise(F.lit(math.log(1 - weight)))
    return F.when((length <= 0) | (end <= start) | (n <= 1), 0.0).otherwise(one(five) + one(three))


# Weights of the hallmarks, agreement at real ends, and the prior of classes for an unknown one.
W_TAIL, W_MOTIF, W_TERMINI, W_TIR, W_ENDS = 0.85, 0.60, 0.80, 0.70, 0.80
TERMINUS, TIR, NO_HIT, NOT_TE = 0.95, 0.90, 0.05, 0.01
CLASS_PRIOR = {"LINE": 0.30, "SINE": 0.20, "LTR": 0.30, "DNA": 0.15, "RC": 0.05}
TPRT, NICKED = ("LINE", "SINE", "Retroposon", "PLE"), ("LINE", "SINE", "Retroposon")


def anchoring_term(start: Column, end: Column, length: Column, independent: float = 0.02) -> Column:
    """An element whose 3' end is whole, as reverse transcription from it leaves, against a uniform placement."""
    n = F.greatest(F.lit(1.0), length - (end - start) + 1.0)
    whole = F.when(end >= length - 5, 1 - independent).otherwise(0.0)
    return F.log(whole + independent / n) + F.log(n)


def termini_term(o: dict[str, Column], te_class: str) -> Column:
    """The ends that mark a class, against chance; 0 where they were not measured."""
    if te_class == "LTR":
        return F.when(o["ltr_start"] >= 0, prob.robust(prob.agreement_log_ratio(o["ltr_start"] + o["ltr_end"], F.lit(4), TERMINUS, 0.25), W_TERMINI)).otherwise(0.0)
    if te_class == "RC":
        return F.when(o["helitron_start"] >= 0, prob.robust(prob.agreement_log_ratio(o["helitron_start"] + o["helitron_end"], F.lit(6), TERMINUS, 0.30), W_TERMINI)).otherwise(0.0)
    if te_class == "DNA":
        return F.when(o["tir_identity"] >= 0, prob.robust(prob.agreement_log_ratio(F.rint(o["tir_identity"] * 20), F.lit(20), TIR, 0.25), W_TIR)).otherwise(0.0)
    return F.lit(0.0)


def motif_term(log_odds: Column) -> Column:
    """The nicked motif at the junction; 0 where it was not evaluated."""
    return F.when(log_odds.isNull(), 0.0).otherwise(prob.robust(log_odds, W_MOTIF))


def counts_term(o: dict[str, Column]) -> Column:
    """Reads for and against, at the error rate of the place."""
    return prob.log_bf_counts(o["n_alt"], o["n_ref"], F.greatest(F.lit(1), o["insert_len"]).cast("double"), prob.local_error_rate(o["a_share"], o["t_share"], o["repeat_share"]))


def _internal_term(o: dict[str, Column], te_class: str) -> Column:
    """What the insert itself shows for a class."""
    total = termini_term(o, te_class)
    if te_class in TPRT:
        end = F.when(o["three_whole"], o["element_length"]).otherwise(o["element_end"])
        placed = (o["element_length"] > 0) & (o["element_end"] > o["element_start"])
        anchored = F.when(placed, anchoring_term(F.least(o["element_start"], end - 1), end, o["element_length"])).otherwise(0.0)
        return total + anchored + tail_term(o["polya_len"], o["a_share"], W_TAIL)
    if te_class in ("LTR", "DNA"):
        return total + ends_term(o["element_start"], o["element_end"], o["element_length"], o["five_whole"], o["three_whole"], W_ENDS)
    return total


def linkage_term(o: dict[str, Column], te_class: Column | str, model: Column) -> Column:
    """What ties an insert to its place: the duplication, and the nicked motif for the classes that nick."""
    chance = o["chance"] if "chance" in o else measured_chance(o["tsd_len"], F.greatest(F.lit(0), o["tsd_mismatches"]), o["repeat_share"], o["tsd_chance"])
    motif = o["motif"] if "motif" in o else motif_term(o["motif_log_odds"])
    tsd = duplication_term(model, o["tsd_len"], F.coalesce(o["tsd_seq"], F.lit("")), chance)
    if isinstance(te_class, str):
        return tsd + motif if te_class in NICKED else tsd
    return tsd + F.when(te_class.isin(*NICKED), motif).otherwise(0.0)


#: Columns of an observation.
OBSERVED = (
    "te_class superfamily identity aligned_len element_start element_end element_length polya_len five_whole three_whole ltr_start ltr_end tir_identity helitron_start helitron_end "
    "tsd_len tsd_mismatches tsd_seq motif_log_odds n_alt n_ref insert_len a_share t_share repeat_share tsd_chance"
).split()


def score_loci(observations: DataFrame) -> DataFrame:
    """Adds log_vs_non_te, log_vs_artifact, log_score (the smaller) and e_value to observations (columns ``OBSERVED``).

    A locus whose best match is no element, or that nothing aligned to, has no
    hallmark terms; an unknown class is a mixture over the classes it could be.
    """
    df = with_duplication_model(observations)
    o = {c: F.col(c) for c in OBSERVED}
    o["polya_len"], o["tsd_mismatches"] = F.greatest(F.lit(0), o["polya_len"]), F.greatest(F.lit(0), o["tsd_mismatches"])
    classes = ("LINE", "SINE", "Retroposon", "PLE", "LTR", "DNA", "RC")
    df = df.withColumns({"_chance": measured_chance(o["tsd_len"], o["tsd_mismatches"], o["repeat_share"], o["tsd_chance"]), "_motif": motif_term(o["motif_log_odds"]), "_span": prob.spanning_share(F.greatest(F.lit(1), o["insert_len"])), "_eps": prob.local_error_rate(o["a_share"], o["t_share"], o["repeat_share"])})
    o |= {"chance": F.col("_chance"), "motif": F.col("_motif")}
    df = df.withColumns({"_sequence": prob.te_identity_log_bf(o["identity"], o["aligned_len"]), "_counts": prob.log_bf_counts_at(o["n_alt"], o["n_ref"], F.col("_span"), F.col("_eps")), "_own_linkage": linkage_term(o, o["te_class"], F.col("tsd_model")), "_unaligned": linkage_term(o, "Unknown", class_model("Unknown"))})
    df = df.withColumns({f"_in_{c}": _internal_term(o, c) for c in classes} | {f"_out_{c}": linkage_term(o, c, class_model(c)) for c in CLASS_PRIOR})
    mixed = {side: prob.log_sum_exp(*(F.col(f"_{side}_{c}") + math.log(w) for c, w in CLASS_PRIOR.items())) for side in ("in", "out")}
    own = F.lit(0.0)
    for c in classes:
        own = F.when(o["te_class"] == c, F.col(f"_in_{c}")).otherwise(own)
    known = o["te_class"].isin(*classes)
    bare = (o["aligned_len"] <= 0) | (o["identity"] <= 0)
    not_te = o["te_class"] == "NonTE"
    vs_non_te = F.when(not_te, F.least(F.col("_sequence"), F.lit(0.0)) + math.log(NOT_TE)).when(bare, math.log(NO_HIT)).otherwise(F.col("_sequence") + F.when(known, own).otherwise(mixed["in"]))
    vs_artifact = F.when(not_te, F.col("_counts")).when(bare, F.col("_counts") + F.col("_unaligned")).otherwise(F.col("_counts") + F.when(known, F.col("_own_linkage")).otherwise(mixed["out"]))
    df = df.withColumns({"log_vs_non_te": vs_non_te, "log_vs_artifact": vs_artifact})
    df = df.withColumn("log_score", F.least("log_vs_non_te", "log_vs_artifact")).withColumn("e_value", F.exp(F.least("log_score", F.lit(700.0))))
    return df.drop("tsd_model", "_chance", "_motif", "_span", "_eps", "_sequence", "_counts", "_own_linkage", "_unaligned", *(f"_in_{c}" for c in classes), *(f"_out_{c}" for c in CLASS_PRIOR))


# The earlier model of target-primed reverse transcription, by mechanism.

# Priors of the mechanisms, and their duplications (present, mean length).
MECHANISMS = {
    "l1_5p_truncated": (0.50, 0.90, 15.0), "trans_alu_sva": (0.33, 0.30, 12.0), "l1_5p_inverted": (0.10, 0.30, 12.0), "l1_full_length": (0.05, 0.25, 12.0), "en_independent": (0.02, 0.02, 10.0),
}
YOUNG, AMBIENT, GENOME_SHARE = 0.98, 0.88, 0.50


def young_copy_term(length: Column, identity: Column) -> Column:
    """A young element copy against some other piece of the genome."""
    q = F.least(F.greatest(identity, F.lit(0.61)), F.lit(0.9995))
    per_base = q * math.log(YOUNG / AMBIENT) + (1 - q) * math.log((1 - YOUNG) / (1 - AMBIENT))
    return F.when(identity < 0.60, math.log(1 - GENOME_SHARE) - math.log(GENOME_SHARE) - 2.0).otherwise(length * per_base)


def duplication_by_mechanism(tau: Column, mechanism: str, chance: Column) -> Column:
    """The duplication's length under a mechanism against chance; without one, the mechanism's own chance of none."""
    _, present, mean = MECHANISMS[mechanism]
    there = math.log(present) - math.log(mean) - tau / mean
    return F.when(tau <= 0, math.log(max(1e-12, 1 - present))).otherwise(there - F.log(F.greatest(chance, F.lit(1e-300))))


def priming_term(matches: Column, polya: Column, t_share: Column, a_share: Column, mechanism: str) -> Column:
    """The tail that anneals to a T-tract at the nick: one event, seen from both sides, over ten bases at most."""
    if mechanism == "en_independent":
        return F.lit(0.0)
    k = F.least(F.least(matches, polya), F.lit(10))
    kept = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1.0))
    chance = F.least(F.lit(1.0), F.sqrt(F.pow(kept(t_share), k) * F.pow(kept(a_share), k)))
    return F.when(k < 4, math.log(0.05)).otherwise(math.log(0.95) - F.log(F.greatest(chance, F.lit(1e-300))))


def geometry_term(start: Column, end: Column, length: Column, mechanism: str, inverted: Column) -> Column:
    """ln of the ends seen, given a mechanism: near impossible where it cannot make them."""
    three, five, odd = end >= length - 5, start <= 5, F.lit(math.log(0.02))
    if mechanism == "en_independent":
        return -F.log(F.greatest(F.lit(1.0), length))
    fits = {"l1_5p_inverted": inverted, "l1_full_length": ~inverted & five, "l1_5p_truncated": ~inverted & ~five, "trans_alu_sva": ~inverted}[mechanism]
    return F.when(~three, math.log(1e-4)).when(fits, 0.0).otherwise(odd)


def allows_family(mechanism: str, family: Column) -> Column:
    """Whether a mechanism can make copies of a family."""
    in_trans = F.upper(family).isin("ALU", "SVA", "PSEUDOGENE")
    if mechanism == "en_independent":
        return F.lit(True)
    return in_trans if mechanism == "trans_alu_sva" else ~in_trans


def evaluate_priming(df: DataFrame) -> DataFrame:
    """Adds log_vs_non_te, log_vs_artifact and log_counts by the earlier model, a mixture over the mechanisms that the family allows.

    Columns: element_start, element_end, element_length, identity, family,
    inverted, tsd_len, tsd_mismatches, t_tract, polya_len, a_share, t_share,
    repeat_share, n_alt, n_ref.
    """
    c = F.col
    start, end, length = c("element_start"), c("element_end"), c("element_length").cast("double")
    df = df.withColumns({"_chance": chance_duplication(c("tsd_len"), c("tsd_mismatches"), c("repeat_share")), "_span": prob.spanning_share((end - start).cast("double")), "_eps": prob.local_error_rate(c("a_share"), c("t_share"), c("repeat_share"))})
    parts = {}
    for m, (prior, _, _) in MECHANISMS.items():
        term = math.log(prior) + geometry_term(start, end, length, m, c("inverted")) + duplication_by_mechanism(c("tsd_len"), m, c("_chance")) + priming_term(c("t_tract"), c("polya_len"), c("t_share"), c("a_share"), m)
        parts[f"_m_{m}"] = F.when(allows_family(m, c("family")), term).otherwise(F.lit(-math.inf))
    allowed = sum((F.when(allows_family(m, c("family")), prior).otherwise(0.0) for m, (prior, _, _) in MECHANISMS.items()), F.lit(0.0))
    counts = prob.log_bf_counts_at(c("n_alt"), c("n_ref"), c("_span"), c("_eps"))
    df = df.withColumns(parts | {"log_counts": counts})
    linkage = prob.log_sum_exp(*(c(x) for x in parts)) - F.log(allowed)
    return df.withColumns({"log_vs_non_te": young_copy_term(end - start, c("identity")) + anchoring_term(start, end, length), "log_vs_artifact": linkage + c("log_counts")}).drop(*parts, "_chance", "_span", "_eps")
