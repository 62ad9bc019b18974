"""Odd documents for every operator."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta the of and to in is river stone light cloud green paper wind salt north seven quiet open round bread".split()


def prose(seed: int, n: int, per_line: int = 12) -> str:
    draw = random.Random(seed)
    words = [draw.choice(WORDS) + str(draw.randrange(50)) * (draw.random() < 0.5) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + per_line]) for i in range(0, n, per_line))


#: An extra column per name that the operators use inside.
EXTRA = "_text _drops hash first last lines words cid bands h score rank language class_id n labelled"


def documents(spark, rows=None):
    """doc_id, text, lang, source, n_chars and columns of clashing names."""
    if rows is None:
        rows = [
            (1, prose(1, 80), "en"),
            (2, prose(1, 80), "en"),
            (2, prose(1, 80), "en"),
            (3, None, "en"),
            (4, "", None),
            (5, " \n\t", "de"),
            (None, prose(2, 40), "de"),
            (6, prose(3, 30000), "en"),
            (7, "1 2 3 ### !!!", "fr"),
            (8, "日本語 текст ñandú", None),
            (9, prose(1, 80) + "\n" + prose(4, 12), "en"),
        ]
    names = EXTRA.split()
    data = [(d, t, g, "src", None if t is None else len(t), *[7] * len(names)) for d, t, g in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
