"""The whole pipeline against its stages in plain Python on a small corpus."""

import random
import re
import sys
from collections import defaultdict

import corpus_pipeline
import zstandard

from tessella.llm import language, packing

from .cases import prose
from .plain_lines import edited
from .test_near import brute

GERMAN = "der und die ist ein nicht wasser stein licht wolke papier wind salz norden sieben still offen rund brot haus schnell über grün".split()


def corpus():
    draw, rows = random.Random(11), []
    shared, items = prose(700, 200, 10), [(k, prose(800 + k, 20 + k, 100)) for k in range(5)]
    for i in range(50):
        german = i % 3 == 0
        text = " ".join(draw.choices(GERMAN, k=90)) if german else prose(i, 90)
        if i % 7 == 1:
            text += "\n" + shared
        if i % 10 == 4:
            text += " " + items[i // 10][1]
        rows.append([i, text, "de" if german else "en"])
    for i in range(50, 60):  # copies and near copies
        words = rows[i - 45][1].split(" ")
        if i % 2:
            words[5] = "changed"
        rows.append([i, " ".join(words), rows[i - 45][2]])
    rows += [[60, None, "en"], [61, "123 !!!", None], [62, "", "de"]]
    return rows, items


def small(part, dictionary):
    how = zstandard.ZstdCompressionParameters.from_level(language.LEVEL, dict_size=len(dictionary), source_size=language.BLOCK, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(part)


def plain_python(rows, items, spark, df):
    known = language.learn(df.select("text", "lang"))
    kept = []
    for i, t, _ in rows:
        plain = re.sub(r"[^a-zäöüß]+", " ", (t or "").lower()).strip().encode()
        if not plain:
            continue
        sizes = sorted(sum(len(small(plain[a : a + language.BLOCK], d)) for a in range(0, len(plain), language.BLOCK)) for d in known.values())
        if sizes[1] - sizes[0] >= language.MARGIN * sizes[1]:
            kept.append((i, t))
    edits = edited(kept)
    edited_rows = [(i, edits[i]) for i, _ in kept]
    single = [(i, t) for i, t in edited_rows if brute(edited_rows)[i][0] == i]
    word = lambda t: re.findall(r"[^\W_]+", t.lower())
    out = []
    for i, t in single:
        w = word(t)
        hit = False
        for _, x in items:
            y = word(x)
            for d in range(1 - len(y), len(w)):
                m = [0 <= d + j < len(w) and w[d + j] == y[j] for j in range(len(y))]
                hit = hit or any(sum(m[a : a + 13]) >= 11 for a in range(len(m) - 12))
        if not hit:
            out.append((i, t))
    return out


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], schema)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = plain_python(rows, items, spark, spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert 20 < len(want) < 55
    bpe = packing.ByteLevelBPE(packing.default_tokenizer())
    tokens = {i: len(ids) for (i, _), ids in zip(want, bpe([t for _, t in want]), strict=True)}
    got, seq = defaultdict(int), defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] += r["length"]
        seq[r["sequence_id"]] += r["length"]
    assert dict(got) == tokens and max(seq.values()) <= packing.CAPACITY


def test_stages_have_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "benchmarks", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and "__spark_entry__" not in vars(sys.modules["corpus_pipeline"])
