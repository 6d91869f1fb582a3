"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", row_hash string, text_hash string, n string, part string, size string, known string"


def words(draw: random.Random, n: int, stem: str = "w", of: int = 400) -> list[str]:
    return [f"{stem}{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]}" for k in (draw.randrange(of) for _ in range(n))]


def frame(spark, rows, extra: bool = False):
    rows = [(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows]
    if extra:
        return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], EXTRA)
    return spark.createDataFrame(rows, SCHEMA)


def awkward(seed: int = 1) -> list[tuple]:
    draw = random.Random(seed)
    base = words(draw, 120)
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, " \t\n", None, "b"), (4, "one", "en", "a"), (5, "one two", "en", "b")]
    rows += [(None, " ".join(base), "en", "a"), (6, " ".join(base), "en", "a"), (6, " ".join(base), "en", "a"), (7, "  ".join(base), None, None)]
    for k in range(8, 40):
        own = list(base)
        for _ in range(draw.randrange(1, 12)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(1000)}"
        rows.append((k, " ".join(own), draw.choice(["en", "fr", None]), draw.choice(["a", "b", "c", None])))
    for k in range(40, 60):
        rows.append((k, " ".join(words(draw, draw.randrange(3, 300))), "fr", draw.choice(["a", "b", "c"])))
    rows.append((60, " ".join(words(draw, 30_000)), "en", "c"))
    return rows
