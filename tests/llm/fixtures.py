"""Small tables with the awkward cases every operator has to define."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, `key` string, `before` long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(spark, partitions: int = 3):
    """Nulls, blanks, copies, near copies, a very long text, repeated rows, clashing column names."""
    rng = random.Random(5)
    base = words(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "b"),
        (3, " ".join(near), "de", "a"),
        (4, base.upper(), None, "a"),
        (5, None, "en", None),
        (6, "", None, None),
        (7, " \n\t ", "en", "a"),
        (8, "one two", "en", "a"),
        (9, "one two", "en", "b"),
        (10, "One\tTWO\n", "fr", "b"),
        (11, words(rng, 30_000), "en", "a"),
        (12, "x" * 200_000, "en", "b"),
        (13, "same line here\nsame line here\nother line there words go on and on", "en", "a"),
        (14, "a b c d e " * 30, "en", "a"),
        (15, "é ü ß 中文 😀     nbsp inside " + words(rng, 40), "de", "b"),
        (16, words(rng, 50), "en", "b"),
        (16, words(rng, 0) or "repeated id with another text", "en", "b"),
        (17, "twice " + base[:200], "en", "b"),
        (17, "twice " + base[:200], "en", "b"),
        (None, words(rng, 25), "en", "a"),
        (None, None, None, None),
    ]
    rows += [(100 + i, words(rng, rng.randint(5, 60)), "en", rng.choice("abc")) for i in range(120)]
    full = [(i, t, lang, s, len(t) if t else None, 1, "k", 2) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], DOCS)
