"""Distances to the language references against plain Python."""

import math
import random
from collections import Counter, defaultdict

import regex

from tessella.llm import quality

from .cases import WORDS, prose


def distance(p, q):
    out = 0.0
    for x, y in zip(p, q, strict=True):
        for a in (x, y):
            if a > 0:
                out += a * math.log(2 * a / (x + y)) / 2
    return math.sqrt(max(out, 0) / math.log(2))


def classes(t):
    n = [len(regex.findall(c, t)) for c in (r"\p{Ll}", r"\p{Lu}", r"\p{N}", r"[\p{P}\p{S}]", r"[\x20\x09-\x0D]")]
    return [*n, len(t) - sum(n)]


def brute(rows):
    words = {i: regex.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, _ in rows}
    count, chars, total = defaultdict(Counter), defaultdict(lambda: [0] * 6), Counter()
    for i, t, lang in rows:
        for key in {("lang", lang), ("all", None)}:
            count[key].update(words[i])
            chars[key] = [a + b for a, b in zip(chars[key], classes(t or ""), strict=True)]
            total[key] += len(words[i])
    out = {}
    for i, t, lang in rows:
        key = ("lang", lang) if lang is not None and total[("lang", lang)] >= quality.LEAST_REFERENCE_WORDS else ("all", None)
        ranked = sorted(count[key].items(), key=lambda x: (-x[1], x[0].encode()))
        best = [w for w, _ in ranked[: quality.COMMON]]
        ref = [count[key][w] / total[key] for w in best]
        own = Counter(words[i])
        mine = [own[w] / max(1, len(words[i])) for w in best]
        all_chars = max(1, sum(chars[key]))
        dc = distance([x / max(1, len(t or "")) for x in classes(t or "")], [x / all_chars for x in chars[key]]) if len(t or "") >= quality.LEAST_CHARS_COMPARED else None
        dw = distance([*mine, 1 - sum(mine)], [*ref, 1 - sum(ref)]) if len(words[i]) >= quality.LEAST_WORDS_COMPARED else None
        out[i] = dc, dw
    return out


def corpus():
    draw, rows = random.Random(5), []
    long = [w + "ification" for w in WORDS]  # common words of any length count
    for i in range(120):
        own = (WORDS, long, WORDS + long)[i % 3]
        weights = [1.35**k for k in range(len(own))]
        text = " ".join(draw.choices(own, weights, k=draw.randrange(60, 400)))
        rows.append((i, text.title() + " 12 — é\n3" if i % 5 == 0 else text, ("en", "xx", "*", None)[i % 4]))
    return [*rows, (900, None, "en"), (901, "", "*"), (902, "only " * 150, "rare")]


def test_distances_equal_plain_python(spark):
    rows = corpus()
    found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == len(rows)  # a language named * is one like others
    want = brute(rows)
    for r in found:
        for own, name in zip(want[r["doc_id"]], ("chars_distance", "words_distance"), strict=True):
            assert (own is None) == (r[name] is None) and (own is None or abs(own - r[name]) < 2e-6), (r, own)
        far = (want[r["doc_id"]][0] or 0) > quality.MOST_CHARS_DISTANCE or (want[r["doc_id"]][1] or 0) > quality.MOST_WORDS_DISTANCE
        assert r["kept"] == (not r["base_failed"] and not far)
    assert any(r["kept"] for r in found) and any(not r["kept"] and not r["base_failed"] for r in found)


def test_the_method_decides(spark):
    """Documents that the base rules pass and the distances reject; with limits out of reach they stay."""
    clean = [(i, " ".join(random.Random(i).choices(WORDS, k=300)), "en") for i in range(40)]
    odd = [(100, " ".join(f"zz{k}" for k in range(300)), "en"), (101, prose(1, 400).upper(), "en")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")).collect()}
    assert all(not got[i]["base_failed"] and not got[i]["kept"] for i in (100, 101)) and all(got[i]["kept"] for i, *_ in clean)


def test_windows_whose_hashes_share_their_high_bits(spark):
    """Most of a text repeats, so many windows are close in the packed order."""
    own = [f"w{k}" for k in range(3000)]
    text = " ".join([*own[:2000], "x", *own[1000:1500], "y", *own[2000:]])
    (r,) = quality.judge(spark.createDataFrame([(1, text, None)], "doc_id long, text string, lang string")).collect()
    assert r["n_repeat_words"] == 1000


def test_base_columns_need_no_references(spark, sf, monkeypatch):
    from tessella.llm import quality, queries

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = sorted(map(tuple, queries.op4_quality(spark, sf).select(*names).collect()))
    monkeypatch.setattr(quality, "word_references", None)
    found = queries.quality_base(spark, sf)
    assert found.columns == names and sorted(map(tuple, found.collect())) == want
