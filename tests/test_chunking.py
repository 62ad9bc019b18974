from hypothesis import given, settings
from hypothesis import strategies as st
from tessella.operators.chunking import count_words, sentence_chunk_rows, sentence_chunks, window_chunks


def windows(words, size, overlap):
    out, at = [], 0
    while words:
        out.append(" ".join(words[at : at + size]))
        if at + size >= len(words):
            return out
        at += size - overlap
    return out


def test_window_chunks(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(n))) for i, n in enumerate([0, 1, 9, 10, 11, 17, 18, 100])] + [(99, None), (98, " \n ")]
    got = window_chunks(spark.createDataFrame(rows, "id int, text string"), 10, 3).orderBy("id", "chunk_idx").collect()
    for i, text in rows:
        want = windows((text or "").split(), 10, 3)
        own = [r for r in got if r["id"] == i]
        assert [r["text"] for r in own] == want
        assert all(r["n_chunks"] == len(want) for r in own)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["alpha", "beta.", "gamma,", "delta!\n\n\n", "x" * 30, "你好。"]), max_size=80), st.integers(5, 20), st.integers(0, 4))
def test_sentence_chunks_cover(words, size, overlap):
    text = " ".join(words)
    chunks = sentence_chunks(text, size, overlap)
    assert all(count_words(c) <= size for c in chunks)
    assert all(c == c.strip() and c for c in chunks)
    joined = "".join("".join(chunks).split())
    assert all(w.strip() in joined or len(w) > size for w in words)


def test_sentence_chunk_overlap():
    text = " ".join(f"word{i}." for i in range(100))
    chunks = sentence_chunks(text, 20, 6)
    for a, b in zip(chunks, chunks[1:], strict=False):
        assert a.split()[-3:] == b.split()[:3]


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "one two. three four."), (2, None), (3, "")], "id int, text string")
    got = sentence_chunk_rows(df, 3, 0).orderBy("id", "chunk_idx").collect()
    assert [(r["id"], r["text"]) for r in got] == [(1, c) for c in sentence_chunks("one two. three four.", 3, 0)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word", "Ünï", "x1_y", "日本語", "a.b", "—", "。", "!?", "\n", "\n\n\n", " ", ", ", ". ", "…", "𝒳𝒴", "́", "-"]), max_size=60), st.integers(1, 14), st.integers(0, 13))
def test_counted_parts_equal_the_general_way(parts, size, overlap):
    text = "".join(parts)
    assert sentence_chunks(text, size, min(overlap, size - 1)) == sentence_chunks(text, size, min(overlap, size - 1), lambda t: count_words(t))


def test_texts_are_cut_once_in_bounded_batches(spark):
    import re

    from tessella.operators.sentences import Boundaries, sentences

    df = spark.createDataFrame([(1, "One two. Three four.")], "id int, text string")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    made = [sentence_chunk_rows(df, 3, 0)]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    for found in [*made, sentences(df, Boundaries(set(), set(), set(), set()))]:
        assert len(re.findall("ArrowEvalPython", found._jdf.queryExecution().optimizedPlan().toString())) == 1 and found.count() == 2


def test_embedding_takes_bounded_batches(spark):
    from tessella.operators.embedding import embed

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = embed(spark.range(2500).coalesce(1).selectExpr("id", "'a b' as text"), lambda: lambda texts: [[float(len(texts))]] * len(texts)).agg({"embedding": "max"}).first()[0]
    assert sizes[0] <= 1000
