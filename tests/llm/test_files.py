"""WARC round trips, extraction by page shape, packing against the library's ids."""

import gzip
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import extraction, packing, warc
from tessella.llm.common import scratch


def test_archive_equals_plain_python(spark, sf):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    last = {}
    for i, b in sorted(pages.items()):
        if len(b) >= 1000:
            last[b] = i
    got = warc.op9_warc(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        b = pages[r["page_id"]]
        to = last.get(b, r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), hashlib.sha1(b).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if to == r["page_id"] else ("revisit", to))


def test_round_trip_of_hard_payloads(spark):
    rows = [(1, "http://a/b", "x\r\n\r\nWARC/1.1\r\n\r\ny" * 100), (2, "http://a/\r\nX: y", ""), (3, None, "é\0日本" * 500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for how in ("gzip", "none"):
        path = scratch(spark)
        warc.write(warc.records(warc.plan_captures(df)), path, how, per_file=4)
        out = {int(r["metadata"]["fields"]["page_id"]): r for r in warc.assemble(warc.read_records(spark, path)).collect()}
        assert {i: bytes(r["response"]["payload"]).decode() for i, r in out.items()} == {i: h for i, _, h in rows}
        assert all(r["response"]["digest_ok"] and r["request"]["record_id"] for r in out.values())


def test_reader_takes_members_and_foreign_digests():
    def record(kind, ident, block, *more):
        return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", *more, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"

    import base64

    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello"
    digest = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    parts = [record("warcinfo", "<i>", b"software: x"), record("response", "<r>", body, f"WARC-Payload-Digest: sha1:{digest}"), record("request", "<q>", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <r>")]
    for raw in (b"".join(parts), b"".join(map(gzip.compress, parts))):
        rows = list(warc.parse(raw, True))
        assert [r[1] for r in rows] == ["warcinfo", "response", "request"]
        assert rows[1][7:9] == (5, True) and rows[1][10] == b"hello" and rows[2][2] == "<r>"


ARTICLE = "The river ran over the stones and the light of the morning was on it, as it is on all of the days of that part of the year when we go there. " * 2


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        (f"<nav><a href=x>Menu</a></nav><article><h1>A&amp;B</h1><p>One\n  two&nbsp;<b>th</b>ree</p></article><footer>F</footer>", "A&B\nOne two three"),
        (f"<div class='ad-box'>Buy this</div><main><p>{ARTICLE}<p>Short.<form>Mail <input></form><div id=comments><p>{ARTICLE}</p></div></main>", f"{ARTICLE.strip()}\nShort."),
        (f"<body><div><p>{ARTICLE}</p><p>In between.</p><p>{ARTICLE}</p></div><ul><li><a>Home</a></li><li><a>About</a></li></ul>", f"{ARTICLE.strip()}\nIn between.\n{ARTICLE.strip()}"),
        ("<article><script>var t='</p><p>x';</script><style>p{}</style><!-- <p>no</p> --><p>a<br>b</p>", "a b"),
        ("<article><p>x &lt;p&gt; &#233; &copy y &am", "x <p> é © y &am"),
        (f"<header>Site</header><article><header><h1>Title</h1></header><aside>Side</aside><p>Body</p></article>", "Title\nBody"),
    ],
)
def test_extraction(html, text):
    assert extraction.extract(html) == text


def test_extraction_of_a_long_page():
    body = "".join(f"<p>{ARTICLE} {i}</p>" for i in range(3000))
    assert extraction.extract(f"<article>{body}</article>").count("\n") == 2999


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by, seq = defaultdict(list), defaultdict(list)
    for r in packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), packing.default_tokenizer(), with_ids=True).collect():
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts.items():
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            own = ids[at : at + r["length"]].tobytes()
            assert (r["start"], r["ids_crc32"], r["doc_tokens"], bytes(r["ids"])) == (at, zlib.crc32(own), len(ids), own)
            at += r["length"]
        assert at == len(ids)
    used = 0
    for pieces in seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        used += at
    assert used > 0.97 * packing.CAPACITY * len(seq)


TEXTS = ["", " ", "a", "a b", "a  b", " a b ", "it's\n\n x\ty", "x \n y", "Ünï çödé ß", "日本語 text", "<|endoftext|> a", "tab\t\tb c", " nbsp a", "a­b", "1 22 333!! ?", "\r\n a\r\n"]


def test_ids_equal_the_library():
    bpe = packing.ByteLevelBPE(packing.default_tokenizer())
    for batch in (TEXTS, TEXTS[::-1], *[[t] for t in TEXTS]):
        for t, ids in zip(batch, bpe(batch), strict=True):
            assert ids.tolist() == [*bpe.whole.encode(t, add_special_tokens=False).ids, 0]


def test_ids_equal_the_library_in_any_script():
    bpe, draw = packing.ByteLevelBPE(packing.default_tokenizer()), np.random.default_rng(4)
    texts = []
    for _ in range(400):
        low = int(draw.integers(33, 0xD000))
        texts.append("".join(chr(int(c)) if draw.random() < 0.8 else draw.choice([" ", "\n", "a", "1", "'s "]) for c in draw.integers(low, low + 300, size=40)))
    assert sum("  " not in t and bool(bpe.plain.fullmatch(t)) for t in texts) > 100
    for t, ids in zip(texts, bpe(texts), strict=True):
        assert ids.tolist() == [*bpe.whole.encode(t, add_special_tokens=False).ids, 0]


def _check(plan, demand, capacity):
    got = Counter()
    for pattern, times in plan:
        assert times > 0 and sum(s * n for s, n in pattern.items()) <= capacity
        for s, n in pattern.items():
            got[s] += n * times
    assert got == Counter({s: n for s, n in demand.items() if n})
    return sum(n for _, n in plan)


@pytest.mark.parametrize("seed", range(8))
def test_cutting_patterns(seed):
    draw = np.random.default_rng(seed)
    capacity = int(draw.integers(20, 256))
    demand = {int(s): int(draw.integers(0, 400)) for s in draw.integers(1, capacity + 1, size=int(draw.integers(1, 60)))}
    used = _check(packing.cutting_patterns(demand, capacity), demand, capacity)
    assert used <= sum(n for _, n in packing.best_fit({s: n for s, n in demand.items() if n}, capacity)) + 1
    assert used >= sum(s * n for s, n in demand.items()) / capacity


def test_known_optimum():
    assert _check(packing.cutting_patterns({45: 97, 36: 610, 31: 395, 14: 211}, 100), {45: 97, 36: 610, 31: 395, 14: 211}, 100) == 453
    assert packing.cutting_patterns({}, 10) == []


def test_knapsack():
    worth, taken = packing.knapsack(np.array([3, 4, 5]), np.array([0.3, 0.45, 0.5]), 11)
    assert worth == pytest.approx(0.3 + 0.9) and taken.tolist() == [1, 2, 0]
