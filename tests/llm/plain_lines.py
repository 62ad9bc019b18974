"""Line dedup in plain Python: its own hashes, chunks, runs and removal."""

from __future__ import annotations

import re
from collections import defaultdict

import xxhash

WIDTH, EVERY, LONG, RUN = 2, 2, 50, 50


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words(line: str) -> int:
    return sum(w != "" for w in line.split(" "))


def chunks(lines: list[str]) -> list[tuple[int, int]]:
    """Chunks of several lines, and long lines: a chunk ends where the hash of the last WIDTH line hashes is even."""
    own = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
    long = [words(x) >= LONG for x in lines]
    out, first = [], 0
    for i in range(len(lines)):
        rolled = 42
        for k in range(WIDTH):
            if i >= k:
                rolled = xxhash.xxh64_intdigest(own[i - k].to_bytes(8, "little"), rolled)
        if i + 1 == len(lines) or long[i] or long[i + 1] or _signed(rolled) % EVERY == 0:
            if i > first or long[i]:
                out.append((first, i))
            first = i + 1
    return out


def runs(lines: list[str]) -> list[tuple[int, int]]:
    """All spans of RUN words or more, from a line with words to another, that can't be shortened at one of their ends."""
    full = [i for i, x in enumerate(lines) if words(x)]
    out = set()
    for a, first in enumerate(full):
        n = 0
        for last in full[a:]:
            n += words(lines[last])
            if n >= RUN:
                out.add((first, last))
                break
    for b in range(len(full)):
        n = 0
        for a in range(b, -1, -1):
            n += words(lines[full[a]])
            if n >= RUN:
                out.add((full[a], full[b]))
                break
    for a in range(len(full) - 1):
        if words(lines[full[a]]) >= RUN and full[a + 1] > full[a] + 1:
            out.add((full[a], full[a + 1]))
    return sorted(out)


def edited(rows: list[tuple[int | None, str | None]]) -> dict:
    """doc_id to its text without what occurs earlier, by least doc_id, then text (no two rows of one doc_id here), then line."""
    places = defaultdict(list)
    texts = {i: (t or "").split("\n") for i, t in rows}
    for i, own in texts.items():
        for first, last in {*chunks(own), *runs(own)}:
            piece = "\n".join(own[first : last + 1])
            if re.search(r"[^\W_]", piece):
                places[piece].append((i, first, last))
    gone = defaultdict(set)
    for found in places.values():
        found.sort()
        kept, start, end = found[0]
        for i, first, last in found[1:]:
            gone[i] |= set(range(max(first, end + 1) if i == kept else first, last + 1))
    return {i: "\n".join(x for k, x in enumerate(texts[i]) if k not in gone[i]) if gone[i] else t for i, t in rows}
