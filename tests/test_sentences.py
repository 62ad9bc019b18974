"""Learned boundaries: a labelled corpus, the counts of the model, odd texts, and chunks that keep abbreviations whole."""

import random

import pytest
from pyspark.sql import functions as F
from tessella.operators import sentences as module
from tessella.operators.chunking import sentence_chunk_rows, split_text, count_words
from tessella.operators.sentences import learn, sentences, tables

NOUNS = "river stone light cloud paper wind salt north bread road house field water glass night garden winter letter engine bridge".split()
VERBS = "keeps finds leaves carries follows holds makes turns brings moves".split()
STARTS = "the a this every one our its no".split()
SHORT = ["Dr.", "Mr.", "Prof.", "approx.", "e.g.", "Nr.", "St."]
NAMES = ["Miller", "Jones", "Petrov", "Weber", "Silva", "Tanaka"]


def labelled(seed, n, per_text=12):
    """Texts as lists of sentences."""
    draw = random.Random(seed)

    def sentence():
        words = [draw.choice(STARTS).capitalize()]
        for _ in range(draw.randrange(4, 11)):
            kind = draw.random()
            if kind < 0.08:
                words += [draw.choice(["Dr.", "Mr.", "Prof.", "St."]), draw.choice(NAMES)]
            elif kind < 0.13:
                words += [draw.choice("JKLM") + ".", draw.choice(NAMES)]
            elif kind < 0.2:
                words += [draw.choice(["approx.", "e.g.", "Nr."]), str(draw.randrange(1, 90))]
            elif kind < 0.24:
                words.append(f"{draw.randrange(9)}.{draw.randrange(9)}")
            else:
                words.append(draw.choice(NOUNS + VERBS + STARTS))
        words.append(draw.choice(NOUNS + VERBS))
        return " ".join(words) + draw.choice([".", ".", ".", "!", "?", '."'])

    return [[sentence() for _ in range(per_text)] for _ in range(n)]


def ends_of(own):
    at, out = 0, set()
    for s in own[:-1]:
        at += len(s)
        out.add(at)
        at += 1
    return out


def f1(pairs):
    hit, found, true = (sum(len(x) for x in group) for group in zip(*[(a & b, a, b) for a, b in pairs], strict=True))
    return 2 * hit / (found + true)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, " ".join(own), "x") for i, own in enumerate(labelled(1, 250))]
    return learn(spark.createDataFrame(rows, "id long, text string, lang string").repartition(4))


def test_boundaries_of_a_labelled_corpus(model):
    fresh = labelled(2, 80)
    assert {("", x.lower().rstrip(".")) for x in SHORT} <= model.abbreviations
    assert not {("", w) for w in NOUNS + VERBS} & model.abbreviations
    learned = f1([(set(model.ends(" ".join(own))), ends_of(own)) for own in fresh])
    every_stop = f1([({i + 1 for i, c in enumerate(t[:-1]) if c in '.!?"' and t[i + 1] == " "}, ends_of(own)) for own in fresh for t in [" ".join(own)]])
    assert learned >= 0.98 and every_stop < 0.85
    assert [model.split(" ".join(own)) for own in fresh[:3]] == fresh[:3]


def test_odd_texts(spark, model):
    rows = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, " \n", 7), (4, "One. Two! three? \n\n 'Four.' Five... six", 7), (5, "no end", 7)], "id long, text string, sentence_no int")
    got = {}
    for r in sentences(rows, model).orderBy("id", "sentence_no").collect():
        got.setdefault(r["id"], []).append(r["text"])
    assert got == {4: ["One.", "Two!", "three?", "'Four.'", "Five... six"], 5: ["no end"]}
    assert learn(rows.limit(0)).abbreviations == set() and sentences(rows.limit(0), model).count() == 0


def test_scores_are_those_of_the_formula(spark):
    import math

    rows = [("a b x. C x. d x. e f. g h i j k l m n o p q r s t",)]
    made = tables(spark.createDataFrame(rows, "text string"))
    got = {r["type"]: r["score"] for r in made["types"].collect()}
    n, periods = 23, 4
    ll = lambda k, c: -2 * (k * math.log(periods / n) + (c - k) * math.log(1 - periods / n) - k * math.log(0.99) - (c - k) * math.log(0.01))
    assert got["x"] == pytest.approx(ll(3, 3) * math.exp(-1)) and got["f"] == pytest.approx(ll(1, 1) * math.exp(-1)) and set(got) == {"x", "f"}
    (like,) = spark.range(1).select(module.likelihood(F.lit(8), F.lit(10), F.lit(20), F.lit(100))).first()
    far = lambda k, m, p: k * math.log(p) + (m - k) * math.log(1 - p)
    assert like == pytest.approx(-2 * (far(8, 10, 0.2) + far(12, 90, 0.2) - far(8, 10, 0.8) - far(12, 90, 12 / 90)))


def test_languages_are_learned_by_themselves(spark):
    rows = [("Herr bzw. Frau bzw. Kind geht bzw. kommt heute.", "de")] * 30 + [("She said bzw and left.", "en")] * 30
    model = learn(spark.createDataFrame(rows, "text string, lang string"), by=F.col("lang"))
    assert ("de", "bzw") in model.abbreviations and ("en", "bzw") not in model.abbreviations


def test_chunks_do_not_cut_after_abbreviations(spark, model):
    own = labelled(3, 1, 40)[0]
    text = " ".join(own)
    rows = spark.createDataFrame([(1, text)], "id long, text string")
    plain = [r["text"] for r in sentence_chunk_rows(rows, 40, 0).collect()]
    learned = [r["text"] for r in sentence_chunk_rows(rows, 40, 0, model=model).collect()]
    assert any(c.split()[-1] in SHORT for c in plain) and not any(c.split()[-1] in SHORT for c in learned)
    assert " ".join(learned) == text and split_text(text, 40, count_words, model.ends)[0] == own[0]


def test_texts_are_read_once_and_words_counted_as_they_stand(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = spark.createDataFrame([("x. A b",)] * 40, "text string").repartition(2).select(seen.asNondeterministic()("text").alias("text"))
    assert {(r["type"], r["next_type"], r["n"]) for r in module.words(rows).collect()} == {("x", "a", 40), ("a", None, 40), ("b", None, 40)}
    before = read.value
    made = tables(rows)
    assert sorted(map(tuple, made["counts"].select("type", "n", "n_period").collect())) == [("a", 40, 0), ("b", 40, 0), ("x", 40, 40)]
    made["types"].collect(), made["starters"].collect(), made["pairs"].collect()
    assert read.value - before == 40


def test_kinds_that_are_too_large_to_hold_are_joined_whole(spark):
    rows = [(i, None if i == 7 else " ".join(own), "ab"[i % 2] if i % 5 else None) for i, own in enumerate([*labelled(4, 120), *labelled(4, 3)])]
    texts = spark.createDataFrame(rows, "id long, text string, lang string").repartition(3)
    whole, by = learn(texts, by=F.col("lang")), F.col("lang")
    assert not whole.tables and min(len(getattr(whole, kind)) for kind in module.KINDS) > 6
    want = [(i, n, s) for i, t, g in rows for n, s in enumerate(whole.split(t, g))]
    for most in (0, 6):
        model = learn(texts, by=by, most=most)
        large = {kind for kind in module.KINDS if len(getattr(whole, kind)) > most}
        assert set(model.tables) == large and all(model.tables[kind].count() == len(getattr(whole, kind)) for kind in large)
        assert all(getattr(model, kind) == getattr(whole, kind) for kind in module.KINDS if kind not in large)
        assert sorted(map(tuple, sentences(texts, model, by=by).select("id", "sentence_no", "text").collect())) == want
        with pytest.raises(ValueError):
            model.ends("One. Two.")
        model.most = 10_000  # what the texts ask of the tables is held, and they are cut where they lie
        cut = sentences(texts, model, by=by)
        assert sorted(map(tuple, cut.select("id", "sentence_no", "text").collect())) == want
        assert "Join" not in cut._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_by_a_model_that_is_too_large_to_hold(spark):
    texts = spark.createDataFrame([(i, " ".join(own)) for i, own in enumerate(labelled(3, 20, 40))], "id long, text string")
    whole, none = learn(texts), learn(texts, most=0)
    assert set(none.tables) == set(module.KINDS) and not none.abbreviations
    made = [sorted(map(tuple, sentence_chunk_rows(texts, 40, 5, model=m).select("id", "chunk_idx", "text").collect())) for m in (whole, none)]
    assert made[0] == made[1] and len(made[0]) > 20
