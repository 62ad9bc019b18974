"""Secret scans: fixed patterns, and strings that a primed compressor finds new.

The patterns give the base spans. Beyond them, a long string of letters and digits in a
sensitive context is a candidate: its statement (a line, or a sentence of one) or the one before
has a sensitive word, or the one before is itself a candidate in such a context and nothing
else, as the lines of a key are. Its novelty is the number of bytes that it adds to the
compressed code around it, per character, where the compressor knows a dictionary of common
identifiers and all identifiers of the whole text: a name that the text has elsewhere costs
little, a key nearly its whole entropy. Novel candidates are reported too.

Cases: a null or empty text has no spans; spans of one start stand in the order of KINDS;
candidates that touch a base span are left out; a string that other sensitive statements have
too is judged as if it stood once, and reported each time; one that its own statement or other
text has again is known to the compressor;
repeated rows are scanned alike; long texts are scanned whole; other columns pass through, but
for one named secrets, which is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

#: Kinds in the order that breaks ties of start.
KINDS = ("assign", "access", "hex", "novel")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run is matched whole, so this is a run of 16 or more
_SENSITIVE = re.compile(r"(?i:auth|bearer|credential|private|secret|token|passw|pwd|api.?key|access.?key|signature|session)", re.A)
_WORDS = ("auth", "bearer", "credential", "private", "secret", "token", "passw", "pwd", "key", "signature", "session")
_STATEMENT = re.compile(r"[^\n]*?(?:[.;!?](?=\s)|\n|\Z)")
#: A string with a piece of twelve letters and digits, one of each at least, or of 24 letters: paths, dates, versions and names of words have shorter ones.
_PIECE = r"(?<![A-Za-z0-9])(?:(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{12}|[A-Za-z]{24})"
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*?{_PIECE})[A-Za-z0-9+/_-]{{16,}}={{0,2}}")
_IDENTIFIER = re.compile(r"[A-Za-z0-9+/_-]{3,}")

#: Characters on either side that are compressed with a candidate; what lies further off counts through its identifiers.
AROUND = 400
#: Added bytes per character from which a candidate is new (random hex adds 0.5 to 0.8, base64 0.75 to 0.9), without the bytes that any addition costs.
NOVELTY = 0.55
OVERHEAD = 4

#: Identifiers that code is full of.
IDENTIFIERS = (
    "authorization authentication access_token refresh_token client_id client_secret api_key apikey secret_key "
    "private_key public_key password passwd username user_name session_id csrf_token bearer basic credential "
    "credentials config configuration settings environment variable database connection string endpoint request "
    "response header content-type application/json charset utf-8 https http localhost example 0123456789 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxxxxxxxxxx changeme placeholder undefined function "
    "return import export default const static public private protected class interface import_module get_or_default "
    "signature timestamp version v1 v2 2020 2021 2022 2023 2024 2025 sha256 sha512 base64 md5 hmac "
).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class _Known:
    """Marginal compressed bytes of a string, for one text."""

    def __init__(self, text: str, judged: Counter, identifiers: bytes, level: int):
        names = Counter(_IDENTIFIER.findall(text))
        known = " ".join(n for n, k in names.items() if k > max(judged[n], 1) or not (judged[n] or _CANDIDATE.fullmatch(n)))
        dictionary = zstandard.ZstdCompressionDict(identifiers + b" " + known.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.text = text
        self.coder = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, start: int, end: int, first: int, last: int) -> float:
        """first, last: the statement; outside it the string itself doesn't count as known."""
        t, own = self.text, self.text[start:end]
        first, last = max(first, start - AROUND), min(last, end + AROUND)
        around = (t[max(0, start - AROUND) : first].replace(own, "") + t[first:start] + " " + t[end:last] + t[last : end + AROUND].replace(own, "")).encode()
        own = own.encode()
        return (len(self.coder.compress(around + b" " + own)) - len(self.coder.compress(around)) - OVERHEAD) / len(own)


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end) of the strings in a sensitive context, and those of their statements."""
    out, sensitive = [], False
    for s in _STATEMENT.finditer(text):
        if s.end() == s.start():
            break
        if s[0].isspace():
            continue
        here = _SENSITIVE.search(text, s.start(), s.end()) is not None
        found = [m.span() for m in _CANDIDATE.finditer(text, s.start(), s.end())] if here or sensitive else []
        out += [(*x, s.start(), s.end()) for x in found]
        alone = len(found) == 1 and text[s.start() : s.end()].strip() == text[slice(*found[0])]
        sensitive = here or (sensitive and alone)
    return out


class Novelty:
    def __init__(self, identifiers: bytes = IDENTIFIERS, level: int = 9):
        self.identifiers, self.level = identifiers, level

    def spans(self, text: str, base: list[tuple[int, int, int]], least: float = NOVELTY) -> list[tuple[int, int, int, float]]:
        """(start, rank of the kind, end, novelty) of the candidates that no base span touches."""
        low = text.lower()
        if not any(w in low for w in _WORDS):
            return []
        ends = list(accumulate((e for _, _, e in base), max))
        touched = lambda s, e: (i := bisect_left(ends, s + 1)) < len(base) and base[i][0] < e
        found = [x for x in candidates(text) if not touched(*x[:2])]
        if not found:
            return []
        novelty = _Known(text, Counter(text[s:e].rstrip("=") for s, e, *_ in found), self.identifiers, self.level)
        return [(x[0], 3, x[1], new) for x in found if (new := novelty(*x)) >= least]


def find_secrets(docs: DataFrame, text: str = "text", least: float = NOVELTY) -> DataFrame:
    """docs with `secrets`: array of (kind, start, end, novelty), sorted; code points, end exclusive."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<kind:string,start:long,end:long,novelty:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        novelty = Novelty()
        for texts in batches:
            out = []
            for t in texts:
                base = base_spans(t) if t else []
                more = novelty.spans(t, base, least) if t else []
                found = sorted([(s, k, e, None) for s, k, e in base] + more, key=lambda x: x[:3])
                out.append([{"kind": KINDS[k], "start": s, "end": e, "novelty": v} for s, k, e, v in found])
            yield pd.Series(out, dtype=object)

    return docs.withColumn("secrets", run(F.col(text)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(F.filter("secrets", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
        count("novel").alias("n_novel"),
    )
