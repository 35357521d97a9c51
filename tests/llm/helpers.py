"""Small tables with every awkward case."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    """(doc_id, text) rows as a documents table; ``extra`` adds columns with names that operators use inside."""
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    if extra:
        for name in ("key", "body", "x_key", "x_text", "x_row", "id", "c", "s", "n", "h", "X_PLAIN"):
            df = df.selectExpr("*", f"'clash' AS {name}")
    return df


def prose(seed, words):
    """Invented words; the same for the same seed."""
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abdeilmnorstu") for _ in range(rnd.randint(2, 9))) for _ in range(words))


def awkward():
    long_text = prose(1, 30_000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, prose(2, 40)), (7, prose(2, 40)),
        (7, prose(2, 40)), (None, prose(2, 40)), (None, None), (8, long_text), (9, long_text + " x"), (10, "x" * 100_000),
        (11, "日本語 テキスト 😀 ß"), (12, "<|endoftext|> a <|endoftext|>"), (13, "12 34 !!! ..."), (7, prose(3, 12)),
    ]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
