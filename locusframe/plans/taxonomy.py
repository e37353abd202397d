"""Library entries in the classification of elements: by their stated class, a Wicker code, or a superfamily's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import seq

# Labels by class as they stand after the # (lower case).
LABELS = {
    "LINE": "line", "SINE": "sine", "Retroposon": "retroposon", "PLE": "ple", "LTR": "ltr", "DNA": "dna mite tir", "RC": "rc helitron", "Unknown": "unknown unspecified na other",
    "NonTE": "satellite simple_repeat low_complexity trna rrna snrna scrna srprna rna artefact artifact segmental",
}
# Superfamilies by class (lower case).
SUPERFAMILIES = {
    "LINE": "l1 l2 cr1 rte rex rex-babar dong-r4 r1 r2 r4 i jockey tad1 proto1 proto2 crack nimb kiri vingi tx1 line dualen ingi cre rtex l1-tx1 rte-bovb",
    "SINE": "alu sine mir b2 b4 id trna-core-rte trna-rte trna-core trna-l2 trna-deu trna-v 5s-deu-l2 5s 7sl ceph deu sine1 sine2 sine3",
    "Retroposon": "sva retroposon", "PLE": "penelope ple poseidon",
    "LTR": "erv herv ervk ervl ervl-malr erv1 gypsy copia pao bel-pao bel dirs ngaro viper caulimovirus ltr retrovirus malr",
    "DNA": "dna hat tcmar tc1 mariner pif harbinger pif-harbinger cmc enspm cmc-enspm cacta mule mudr mule-mudr mutator piggybac merlin p transib kolobok zisupton academ ginger sola novosib zator dada is3eu crypton maverick polinton mite tir tc2 tigger pogo fot1 isrm11 tcmar-isrm11 isl2eu pif-isl2eu",
    "RC": "helitron rc helentron", "NonTE": "satellite simple_repeat low_complexity trna rrna snrna scrna srprna artefact", "Unknown": "unknown na",
}
# Wicker codes with class and superfamily.
WICKER = {
    "RLG": "LTR Gypsy", "RLC": "LTR Copia", "RLB": "LTR Bel-Pao", "RLR": "LTR Retrovirus", "RLE": "LTR ERV", "RLX": "LTR Unknown", "RYD": "LTR DIRS", "RYN": "LTR Ngaro", "RYV": "LTR Viper", "RPP": "PLE Penelope",
    "RIR": "LINE R2", "RIT": "LINE RTE", "RIJ": "LINE Jockey", "RIL": "LINE L1", "RII": "LINE I", "RIX": "LINE Unknown", "RST": "SINE tRNA", "RSL": "SINE 7SL", "RSS": "SINE 5S", "RSX": "SINE Unknown",
    "DTT": "DNA TcMar", "DTA": "DNA hAT", "DTM": "DNA MULE", "DTE": "DNA Merlin", "DTR": "DNA Transib", "DTP": "DNA P", "DTB": "DNA PiggyBac", "DTH": "DNA PIF-Harbinger", "DTC": "DNA CACTA", "DTX": "DNA Unknown",
    "DYC": "DNA Crypton", "DHH": "RC Helitron", "DMM": "DNA Maverick", "DXX": "DNA Unknown",
}
MECHANISM = {"LINE": "tprt", "SINE": "tprt", "Retroposon": "tprt", "PLE": "tprt", "LTR": "integrase", "DNA": "transposase", "RC": "rolling_circle", "Unknown": "unknown", "NonTE": "unknown"}
_COLLAPSED = (("ALU", "Alu"), ("L1", "L1"), ("SVA", "SVA"), ("HERV", "HERV"))


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def _inverted(groups: dict[str, str]) -> dict[str, str]:
    return {name: te_class for te_class, names in groups.items() for name in names.split()}


def _clean(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.coalesce(label, F.lit(""))), r"[?]+$", ""))


def class_of_label(label: Column) -> Column:
    """The class that a stated label names, or null."""
    return F.element_at(_table(_inverted(LABELS)), F.lower(_clean(label)))


def class_of_superfamily(name: Column) -> Column:
    """The class of a superfamily or element: a Wicker code, the whole name, or the longest prefix.

    A prefix of one letter counts only before a divider or a digit.
    """
    known = _inverted(SUPERFAMILIES)
    keys = F.array(*(F.lit(k) for k in sorted(known, key=lambda k: (-len(k), k))))
    table = _table(known)

    def found(n: Column) -> Column:
        fits = F.filter(keys, lambda k: n.startswith(k) & ((F.length(k) >= 2) | F.substring(n, F.length(k) + 1, F.lit(1)).rlike("[-_.0-9]")))
        return F.when(n != "", F.coalesce(F.split(F.element_at(_table(WICKER), F.upper(n)), " ")[0], F.element_at(table, n), F.element_at(table, F.get(fits, F.lit(0)))))

    return seq.let(F.lower(_clean(name)), found)


def classify(class_label: Column, superfamily: Column, element: Column) -> Column:
    """(te_class, superfamily, source) of an entry; source is header, superfamily, name or none."""
    usable = lambda x: F.when(~F.coalesce(x, F.lit("")).isin("", "NA"), F.nullif(class_of_superfamily(x), F.lit("Unknown")))
    clean = _clean(superfamily)
    facts = F.struct(
        F.when(class_label != "NA", class_of_label(class_label)).alias("stated"), clean.alias("clean"), F.split(F.element_at(_table(WICKER), F.upper(clean)), " ").alias("wicker"),
        usable(superfamily).alias("by_superfamily"), usable(element).alias("by_name"),
    )

    def taxon(x: Column) -> Column:
        says = x["stated"].isNotNull() & (x["stated"] != "Unknown")
        te_class = F.when(says & (x["stated"] != "NonTE") & x["wicker"].isNotNull(), x["wicker"][0]).when(says, x["stated"]).otherwise(F.coalesce(x["by_superfamily"], x["by_name"], F.lit("Unknown")))
        source = F.when(says, "header").when(x["by_superfamily"].isNotNull(), "superfamily").when(x["by_name"].isNotNull(), "name").otherwise("none")
        named = F.coalesce(F.nullif(F.coalesce(x["wicker"][1], x["clean"]), F.lit("")), F.lit("NA"))
        return F.struct(te_class.alias("te_class"), named.alias("superfamily"), source.alias("source"))

    return seq.let(facts, taxon)


def _pieces(token: Column) -> Column:
    """(name, class_label, order_label, family, superfamily) as a header's token spells them."""
    hashed, colon = F.instr(token, "#") > 0, F.instr(token, ":") > 0
    left, head = F.substring_index(token, "#", 1), F.substring_index(token, ":", 1)
    or_else = lambda x, other: F.coalesce(F.nullif(x, F.lit("")), other)

    def after_hash(right: Column) -> Column:
        slash = F.instr(right, "/")
        label = F.when(~hashed | (right == ""), "NA").when(slash == 0, right).when(slash > 1, F.substring_index(right, "/", 1)).otherwise("NA")
        order = F.when(hashed & (slash > 0), or_else(F.substring(right, slash + 1, F.length(right)), F.lit("NA"))).otherwise("NA")
        name = F.when(hashed, or_else(left, token)).when(colon, or_else(F.substring(token, F.length(head) + 2, F.length(token)), token)).otherwise(token)
        last = F.substring_index(right, "/", -1)
        family = F.when(hashed & (right == ""), name).when(hashed & (slash > 0) & (last != ""), last).when(hashed, right).when(colon, head).otherwise(token)
        return F.struct(name.alias("name"), label.alias("label"), order.alias("order"), or_else(family, name).alias("family"), colon.alias("colon"), hashed.alias("hashed"))

    return seq.let(F.when(hashed, F.substring(token, F.length(left) + 2, F.length(token))).otherwise(""), after_hash)


def name_parts(header: Column) -> Column:
    """(name, class_label, order_label, family, family_key, te_class, superfamily, source) of a library header.

    ``name#Class/Superfamily``, ``Family:name`` or a bare name. Families that
    begin with ALU, L1, SVA or HERV collapse to those. An empty header names nothing.
    """

    def classified(p: Column) -> Column:
        superfamily = F.when(p["order"] != "NA", p["order"]).when((p["label"] == "NA") & ~p["hashed"] & p["colon"], p["family"]).otherwise("NA")
        return seq.let(F.struct(p.alias("p"), classify(p["label"], superfamily, p["name"]).alias("t")), lambda x: seq.let(F.when((x["p"]["family"] == x["p"]["order"]) & (x["t"]["superfamily"] != x["p"]["order"]), x["t"]["superfamily"]).otherwise(x["p"]["family"]), lambda family: collapsed(x["p"], x["t"], family)))

    def collapsed(p: Column, t: Column, family: Column) -> Column:
        key, shown = F.upper(family), family
        for prefix, canonical in reversed(_COLLAPSED):
            hit = F.upper(family).startswith(prefix)
            key, shown = F.when(hit, prefix).otherwise(key), F.when(hit, canonical).otherwise(shown)
        return F.struct(p["name"].alias("name"), p["label"].alias("class_label"), p["order"].alias("order_label"), shown.alias("family"), key.alias("family_key"), t["te_class"].alias("te_class"), t["superfamily"].alias("superfamily"), t["source"].alias("source"))

    nothing = F.struct(*(F.lit(x).alias(n) for n, x in (("name", "NA"), ("class_label", "NA"), ("order_label", "NA"), ("family", "NA"), ("family_key", "NA"), ("te_class", "Unknown"), ("superfamily", "NA"), ("source", "none"))))
    return seq.let(F.coalesce(seq.header_token(header), F.lit("")), lambda token: F.when(token == "", nothing).otherwise(seq.let(_pieces(token), classified)))


def library_summary(entries: DataFrame, header: str = "name") -> DataFrame:
    """(te_class, source, n, share) of a library's entries."""
    taxa = entries.select(name_parts(F.col(header)).alias("t")).groupBy("t.te_class", "t.source").agg(F.count(F.lit(1)).alias("n"))
    total = taxa.agg(F.sum("n").alias("_t"))  # one row
    return taxa.crossJoin(F.broadcast(total)).select("te_class", "source", "n", (F.col("n") / F.col("_t")).alias("share"))
