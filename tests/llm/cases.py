"""Rows that every operator has to cope with."""

import random

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
WORD = "x" * 200_000


def documents(spark, extra=True):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from the farm in that other county"
    rng = random.Random(5)
    words = base.split()
    near = " ".join(words * 8)
    rows = [
        (1, near + " end", "en", "src1"),
        (2, near + " end", "en", "src1"),
        (2, near + " end", "en", "src1"),
        (3, near + " fin", "en", "src2"),
        (4, None, "en", "src2"),
        (5, "", "de", None),
        (6, " \t\n ", None, "src3"),
        (7, LONG, "en", "src1"),
        (8, WORD, "de", "src0"),
        (9, "ÄÖ é 漢字 😀 　 zwei", "de", "src0"),
        (10, "two words", "fr", "src5"),
        (11, "Two WORDS", "fr", "src5"),
        (None, "no id here at all", "en", "src4"),
        (None, None, None, None),
        (12, "12 34 ## $$ !!", "es", "odd"),
        (13, "line one is here\nline one is here\n\nline one is here\nother", "en", "src1"),
        *((20 + k, " ".join(rng.choices(words, k=rng.randint(1, 90))), "en", f"src{k % 7}") for k in range(40)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    if extra:
        from pyspark.sql import functions as F

        names = ["score", "predicted", "evidence", "lang_pred", "rejected", "node", "component_id", "part", "start", "key", "_n", "_key", "_row", "family", "n_words", "token_ids", "domain", "n_chars"]
        df = df.withColumns({n: F.lit(f"old {n}") for n in names})
    return df


def table(df):
    return [tuple(r) for r in df.collect()]
