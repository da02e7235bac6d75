"""Small document tables with every awkward row."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for themselves.
CLASHES = ("score", "node", "n", "hashes", "shard", "slot", "hilbert", "digest", "line", "row_key", "kept_id", "leak_id", "tie", "part", "ids", "seed", "host", "_task", "label")


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows(seed: int = 1) -> list[tuple]:
    """Nulls, empty, blank and long texts, repeated rows and ids, ties."""
    rng = random.Random(seed)
    a, b = words(rng, 80), words(rng, 120)
    rows = [
        (0, a, "en", "s0", len(a)), (1, b, "de", "s1", len(b)), (2, None, "en", "s0", None), (3, "", None, "s0", 0), (4, " \t\n ", "en", None, 4), (5, "one two", "en", "s0", 7),
        (6, a, "en", "s0", len(a)), (6, a, "en", "s0", len(a)), (7, a + " extra", "en", "s2", 99), (None, b, "fr", "s1", len(b)), (None, None, None, None, None),
        (8, "Zoë naïve — ünïcode 😀 " * 30, "fr", "s3", 1), (9, words(rng, 30_000, 5000), "en", "s0", 1), (10, "\n".join([a, a, "x y"]), "en", "s0", 1), (1, words(rng, 60), "en", "s1", 1),
        (11, "  leading and  double blanks \n\n and lines \r\n end ", "en", "s0", 1), (12, "word " * 200, "en", "s0", 1),
    ]
    return rows


def table(spark, rows=None, extra: bool = False):
    df = spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))
    return df
