"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tessella.llm import phrases


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        text, lang = re.sub("[A-Z]", lambda m: m[0].lower(), text or ""), lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    own = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in own.items():
        if any(g == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in own.items()):
            continue
        score, _, x, y = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), x, y))
    return sorted((lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for r, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


def corpus(seed, n=160):
    draw, rows = random.Random(seed), []
    words = ["the", "The", "of", "a", "é", "x\x00y", "日本", "<b>", "it's", "ÄB", *"pqrstuvw"]
    fixed = ["new york city hall", "the the the the the the the", "of the", "x\x00y \t é"]
    for i in range(n):
        parts = [draw.choice(fixed) if draw.random() < 0.3 else " ".join(draw.choices(words, [9, 5, 7, 5, *[1] * (len(words) - 4)], k=draw.randrange(1, 9))) for _ in range(draw.randrange(8))]
        rows.append((draw.choice([" ", ", ", ".\n", "\t", "\x0b", "!"]).join(parts), [None, "en", "de", "und"][i % 4]))
    return [*rows, (None, "en"), ("", "en"), (" \t,,", "fr"), (rows[0][0], rows[0][1])]


def found(spark, rows, least, top, **options):
    df = spark.createDataFrame([(*r, 7, 7, 7) for r in rows], "text string, lang string, n int, ids int, batch int").repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, least, top, **options).collect())


@pytest.mark.parametrize(("most", "batch_words", "most_sent", "most_pairs"), [(10**6, 1 << 20, 10**6, 10**6), (60, 200, 10**6, 10**6), (12, 50, 3, 10**6), (12, 50, 3, 0)])
def test_plain_counts(spark, most, batch_words, most_sent, most_pairs):
    rows = corpus(1)
    got = found(spark, rows, 8, 40, most=most, batch_words=batch_words, most_sent=most_sent, most_pairs=most_pairs)
    assert got == brute(rows, 8, 40) and len({r[0] for r in got}) == 3 and max(len(r[2].split(" ")) for r in got) == 5


def test_slices_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 7)
    own = phrases._Coder()
    own.add(["one two three, four five", "six"])
    words, counts, codes = own.batch(False)
    assert [words[c].as_py() if c >= 0 else None for c in codes] == [None, "one", "two", "three", None, "four", "five"]
    own.add(["seven"])
    words, _, codes = own.batch(True)
    assert [words[c].as_py() if c >= 0 else None for c in codes] == [None, "six", None, "seven"] and own.batch(True) is None


def test_long_text_and_empty_tables(spark):
    rows = [("a b c " * 60_000, "en"), ("b c a, " * 300, None)]
    assert found(spark, rows, 100, 10) == brute(rows, 100, 10)
    assert found(spark, [], 100, 10) == [] == found(spark, [("a b", "en")], 100, 10)


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    draw = random.Random(3)
    rows = [tuple(draw.randrange(10**15, 10**16) for _ in range(2)) + tuple(draw.randrange(10**14, 10**15) for _ in range(2)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = df.select("a", "n", "l", "r", phrases.score(*[F.col(c).cast("decimal(20,0)") for c in "anlr"]).alias("s")).collect()
    assert all(r["s"] == 1000 * r["a"] * r["n"] // (r["l"] * r["r"]) for r in got) and dict(df.dtypes)["a"] == "bigint"
