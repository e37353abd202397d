"""Rows that every text operator has to take: nulls, blanks, ties, repeats, long texts, clashing columns."""

import random

WORDS = "the of and that with this from were which there about after stone river cloud garden window paper letter music winter summer bread water light".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) * r.randrange(2) for _ in range(n))


def odd_documents():
    """(doc_id, text, lang, source, n_chars) with every kind of oddity."""
    base = prose(1, 120)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail", "en", "b"), (4, prose(2, 90), None, None), (5, None, "en", "a"), (6, "", "en", "a"),
        (7, " \t\n ", "en", "b"), (8, "One two", "en", "b"), (9, "one TWO", "en", "b"), (10, "123 456 !!!", "en", "a"), (11, "x" * 30_000, "en", "a"), (12, prose(3, 9000), "en", "a"),
        (13, "ünï çødé 中文 😀 text", "fr", "c"), (13, "ünï çødé 中文 😀 text", "fr", "c"), (None, prose(4, 30), "en", "a"),
    ]
    return [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_frame(spark, extra: bool = True):
    df = spark.createDataFrame(odd_documents(), SCHEMA)
    if extra:
        for name in ("size", "shard", "score", "predicted", "n", "node", "u", "v", "c", "g", "id", "b", "h", "at", "frac", "token", "component"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)
