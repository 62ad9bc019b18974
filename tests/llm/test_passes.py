"""The two passes over blocks: against plain Python on random pages, on labelled pages, and without them."""

import random
import re
import time
from html.parser import HTMLParser

import pytest

from tessella.llm import extraction
from tessella.llm.extraction import extract

PLAIN = "The river ran along the stone and the light of the north was in the paper of the house for all to see. "
LONG = PLAIN * 2
KEYWORDS = "cheap stone light cloud green paper wind salt north quiet bread table chair window door garden lamp carpet shelf mirror curtain pillow"


class Read(HTMLParser):
    """Blocks of pages of div, p, h2, li and a: text, characters in links, element."""

    def __init__(self):
        super().__init__()
        self.blocks, self.stack, self.now, self.linked, self.link = [], [], "", 0, False

    def cut(self):
        text = " ".join(self.now.split())
        if text:
            self.blocks.append((text, self.linked, self.stack[-1] if self.stack else ""))
        self.now, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
        else:
            self.cut()
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        else:
            self.cut()
            self.stack.pop()

    def handle_data(self, data):
        self.now += data
        if self.link:
            self.linked += len(" ".join(data.split()))


def brute(page, article):
    reader = Read()
    reader.feed(page)
    found = reader.blocks
    stops = [[w in extraction.STOP_WORDS for w in re.findall(r"[a-z]+", t.lower())] for t, _, _ in found]
    listed = sum(map(sum, stops)) >= 0.01 * sum(map(len, stops))
    first = []
    for (t, linked, tag), own in zip(found, stops, strict=True):
        if linked > len(t) / 2:
            first.append(None if tag == "p" else False)
        elif tag == "h2" or len(t) < 70:
            first.append(None)
        elif not listed:
            first.append(True if len(t) >= 140 else None)
        else:
            first.append(True if sum(own) >= (0.03 if len(t) >= 140 else 0.1) * len(own) else None)
    out = []
    for i, label in enumerate(first):
        if label is None:
            near = sorted((abs(i - j), not first[j]) for j in range(len(first)) if first[j] is not None)
            after = [first[j] for j in range(i + 1, len(first)) if first[j] is not None]
            if not near:
                label = article
            elif found[i][2] == "h2" and after:
                label = after[0]
            else:
                label = not near[0][1]
        if label:
            out.append(found[i][0])
    return "\n".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_random_pages_equal_plain_python(seed):
    draw, out = random.Random(seed), []
    for _ in range(draw.randrange(1, 25)):
        kind = draw.randrange(7)
        tag = draw.choice(["p", "div", "li"])
        text = [LONG, PLAIN, "By A Writer", KEYWORDS, KEYWORDS[:90], "More", PLAIN[:70]][kind]
        if draw.random() < 0.3:
            text = f"<a href='/x'>{text}</a> {'and ' * draw.randrange(3)}"
        out.append(f"<h2>{text}</h2>" if draw.random() < 0.15 else f"<{tag}>{text}</{tag}>")
    body = "\n".join(out)
    assert extract(f"<body>{body}</body>") == brute(body, False)
    assert extract(f"<body><p>{LONG}</p><article>{body}</article></body>") == brute(body, True)


#: Pages and their main text, as a reader would mark it.
LABELLED = {
    "no article element": (
        f"<body><div><a href=/>Home</a> <a href=/n>News</a></div><div>You are here</div><h2>Weather</h2><div>By A Writer</div><div>{LONG}</div><div>Rain.</div><div>{LONG}</div>"
        f"<h2>Most read</h2><ul><li><a href=/1>Ten things about stones</a></li><li><a href=/2>Bread and salt</a></li></ul><div>Page made in 2024</div></body>",
        ["Weather", "By A Writer", LONG, "Rain.", LONG],
    ),
    "links inside the article": (
        f"<body><article><h1>Weather</h1><p>{LONG}</p><p><a href=/map>See the map</a></p><p>{LONG}</p><h2>Read on</h2><ul><li><a href=/1>Ten things about stones</a></li><li><a href=/2>Bread and salt</a></li></ul></article></body>",
        ["Weather", LONG, "See the map", LONG],
    ),
    "keywords below a page of plain blocks": (
        f"<body><div><div>{LONG}</div><div>By A Writer</div><div>{LONG}</div></div><div><a href=/t>All tags of this site</a></div><div>{KEYWORDS}</div><div><a href=/u>All places of this site</a></div></body>",
        [LONG, "By A Writer", LONG],
    ),
    "a language without stop words": ("<body><div><a href=/>Дом</a></div><div>{0}</div><div>Да.</div><div>{0}</div></body>".format("Река течёт вдоль тихого камня, и свет севера лежит на бумаге дома. " * 3), ["Река течёт вдоль тихого камня, и свет севера лежит на бумаге дома. " * 3, "Да."] + ["Река течёт вдоль тихого камня, и свет севера лежит на бумаге дома. " * 3]),
}


@pytest.mark.parametrize("name", LABELLED)
def test_labelled_pages_need_the_passes(name, monkeypatch):
    page, want = LABELLED[name]
    want = "\n".join(" ".join(x.split()) for x in want)
    assert extract(page) == want
    lists_alone = [b.text for b in extraction.blocks(page) if not b.bad]
    assert "\n".join(lists_alone) != want
    monkeypatch.setattr(extraction, "_inherit", lambda seen, labels, alone: [bool(x) for x in labels])
    assert extract(page) != want  # without the second pass


def test_formulas_stay():
    assert extract(f"<article><p>{LONG}<math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>") == f"{LONG}x=2"


@pytest.mark.parametrize("part", ["<div></b>", "<a ", "<div><a href='x", "<p", "</div>", "<header>", "<div class=sidebar><article>", "<!--", "&", "<i></div>"])
def test_broken_markup_takes_linear_time(part):
    took = []
    for n in (20000, 80000):
        t = time.perf_counter()
        extract(f"<p>{LONG}</p>" + part * n)
        took.append(time.perf_counter() - t)
    assert took[1] < 12 * took[0] + 0.3


def test_what_never_ends():
    assert extract(f"<p>{LONG}</p><!-- a comment {LONG}") == LONG.strip()
    assert extract(f"<article><p>{LONG}</p>tail <b") == f"{LONG.strip()}\ntail <b"
