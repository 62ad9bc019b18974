"""Byte-level BPE: ids of whole texts by the library, and an exact round trip."""

import hashlib
import random

import pytest

from tessella.llm import bpe

from .cases import documents, prose


@pytest.fixture(scope="module")
def ranks():
    return bpe.Ranks(*bpe.default_ranks())


def test_slices_leave_the_ids(ranks):
    draw = random.Random(1)
    spaces = [" ", "\n", "\t", "\x85", "　", "\x1c", "  "]
    for trial in range(200):
        text = "".join(draw.choice(["ab", "don't", "'s", "12", "!!", "é", "日本", "😀", *spaces, *spaces]) * draw.choice([1, 1, 3]) for _ in range(draw.randrange(60)))
        if trial % 3 == 0:
            text += draw.choice([" ", "\n"]) * draw.randrange(bpe.RUN - 5, bpe.RUN + 5) + draw.choice(["", "x", "!", "\n", "\x1c"]) + text[: draw.randrange(30)]
        own = ranks.encoding.encode_ordinary(text)
        parts = list(bpe.slices(text, draw.choice([1, 5, 50])))
        assert "".join(p for p, _ in parts) == text
        assert [i for p, one in parts for i in (ranks.encoding._encode_single_piece(p) if one else ranks.encoding.encode_ordinary(p))] == own
        assert ranks.encode(text).tolist() == own


def test_texts_too_long_for_the_library_at_once(ranks):
    for text in ("x" + " " * 2_000_000 + "b", "\n" * 1_000_000, "a" * 500_000, prose(1, 400_000)):
        ids = ranks.encode(text)
        assert b"".join(ranks.tokens[i].as_py() for i in ids[:50]) == text.encode()[: sum(len(ranks.tokens[i].as_py()) for i in ids[:50])]
        assert sum(len(ranks.encoding.decode_single_token_bytes(i)) for i in ids) == len(text.encode())


def test_round_trip_of_odd_rows(spark):
    docs = documents(spark)
    back = bpe.decode(bpe.encode(docs, *bpe.default_ranks()), *bpe.default_ranks())
    assert back.columns == [*docs.columns, "ids", "decoded"]
    for r in back.collect():
        assert bytes(r["decoded"]).decode() == (r["text"] or "") and (r["ids"] == []) == (not r["text"])
    assert bpe.encode(docs.limit(0), *bpe.default_ranks()).count() == 0
    lists = spark.createDataFrame([(None,), ([],), ([0, 1],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(lists, *bpe.default_ranks()).collect()] == [None, b"", bpe.ranks_of(*bpe.default_ranks()).encoding.decode_bytes([0, 1])]
    with pytest.raises(Exception, match="an id that"):
        bpe.decode(spark.createDataFrame([([50256],)], "ids array<int>"), *bpe.default_ranks()).collect()


def test_query(spark, sf, ranks):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op11_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ranks.encoding.encode_ordinary(texts[r["doc_id"]])
        own = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), *own)
