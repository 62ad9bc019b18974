"""HTML extraction by two passes over a page's blocks.

A block is the text between block-level tags. Pass one looks at each alone: blocks in menus,
headers, footers, sidebars, notices, adverts, forms and comments (by element, role, class or
id) are bad; so are blocks of links, but for a paragraph, which may be one link; long or
middling blocks that are dense in stop words are good; the others (headings, short ones, link
paragraphs, long ones that hardly have a stop word) are undecided. A page whose blocks as a
whole have next to no stop words is in a language without a list here; there length alone
makes good. Pass two gives an undecided block the label of its nearest decided neighbours, good
if they differ at equal distance; a heading that of the next decided block, as it belongs to
what follows. Both passes run inside articles too: where a page marks its article (article or
main elements with text), only what is inside can be good, neighbours are those inside, and
blocks with no decided neighbour are good.

A class that says what a page has (`has-sidebar`, `with-comments`) marks nothing, nor does one in
an article that has other words beside (`related-work`). Text of figures, of `noscript` and of media that
can't play is text of the page. An article
suspends the marks of classes, ids and roles on what holds it, as layouts bear such names
(`header-fixed`), but not those of navigation, asides, footers, forms and comments. Of a
page's articles those within the fewest marks count, of those with a block that pass one finds
good if there are any, so teasers in a marked box beside the article stay out.

Cases: null or empty html, or a page without good blocks, gives an empty text; broken markup
is read as far as it goes (an end tag closes the nearest open element of its name, one without
such an element nothing; an unclosed one ends with what holds it; a tag or comment that never
ends, nothing after it being closed, is text or a comment to the end); repeated rows are read
alike; very long pages are read whole, in time linear in them; other columns pass through, but
for one named main_text, which is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

#: HTML element names by what they mean here.
RAW = frozenset("script style template iframe textarea title".split())
SKIPPED = frozenset("nav aside footer form button select dialog menu head fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription sidebar rail menu nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments disqus respond replies "
    "reply share sharing social related recommended widget pagination pager login signup search contentinfo "
    "complementary form".split()
)
#: Words that a class or id in an article may have beside a mark; with others, as in `related-work`, it is a name of content.
PLAIN = frozenset(
    "area bar block body bottom box button card cell code col column container content desktop field fields group head "
    "heading icon icons inline inner item items label left link links list main mobile module outer panel post posts right "
    "row section slot small text title top unit view wrap wrapper".split()
)
#: Frequent words of some languages.
STOP_WORDS = frozenset(
    "the of and to in a is that it was for on are as with his they at be this have from or had by not but what all "
    "were we when your can said there use an each which she do how their if will der die und das den von zu mit sich "
    "des auf ist im dem nicht ein eine als auch es an er so dass kann wie bei nach aus oder le la les de des et un une "
    "du en que qui dans est pour au par sur pas plus ne se ce il sont aux avec el los las y del se por con una su para "
    "como al lo mas pero sus ha o este si di che non sono della per il da dos em os nao uma het van een niet".split()
)
LONG, SHORT = 140, 70
LINKS = 0.5
#: Least shares of stop words: in a middling block, in a long one, and on a page whose language is listed.
STOPS, STOPS_LONG, STOPS_PAGE = 0.1, 0.03, 0.01

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")
_HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HAS = frozenset("has with no without".split())
#: Words of a mark that an article inside doesn't suspend.
KEPT = frozenset("nav navbar navigation menu aside footer form comment comments disqus respond replies reply".split())


class Block:
    __slots__ = ("bad", "inside", "linked", "stops", "suspended", "tag", "text", "words")

    def __init__(self, text: str, linked: int, tag: str, bad: bool, inside: bool, suspended: int):
        self.text, self.linked, self.tag, self.bad, self.inside, self.suspended = text, linked, tag, bad, inside, suspended
        words = () if bad else _LETTERS.findall(text.lower())
        self.words, self.stops = len(words), sum(map(STOP_WORDS.__contains__, words))


def _marks(attributes: str, inside: bool) -> set[str]:
    """Words that mark what isn't the article. inside: in an article only names of nothing but marks and plain words count."""
    found = set()
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            words = _WORD.findall(_HUMPS.sub(" ", name).lower())
            if (len(words) < 2 or words[0] not in _HAS) and not (inside and any(w not in MARKS and w not in PLAIN for w in words)):
                found.update(w for w in words if w in MARKS)
    return found


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; blocks without text are left out."""
    out: list[Block] = []
    parts: list[str] = []
    linked = links = bad = inside = breaks = suspended = stray = free = 0
    stack: list[tuple[str, int, int, int, int, int]] = []  # name, whether it is bad, an article, marks it suspends, whether it is a head, menu or header, whether an article suspends it
    opened: Counter = Counter()
    tag, at, end = "", 0, len(page)
    last = page.rfind(">") + 1  # no tag ends beyond

    def flush() -> None:
        nonlocal linked, parts
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, linked, tag, bad > 0, inside > 0, suspended))
            parts = []
        linked = 0

    def pop() -> str:
        nonlocal bad, inside, suspended, stray, free
        name, b, i, s, h, f = stack.pop()
        opened[name] -= 1
        bad, inside, suspended, stray, free = bad - b + s, inside - i, suspended - s, stray - h, free - f
        return name

    def text(upto: int) -> None:
        nonlocal linked, breaks
        if upto > at:
            part = page[at:upto]
            parts.append(part)
            if not part.isspace():
                breaks = 0
                if links:
                    linked += len(_SPACE.sub(" ", unescape(part)).strip())

    while at < end:
        m = _TAG.search(page, at, last) if at < last else None
        if m is None:
            stop = page.find("<!--", at)
            text(end if stop < 0 else stop)
            break
        text(m.start())
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW and not closing:
            if not m[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*+>?", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
            breaks += 1
            if breaks > 1:
                flush()
        block = name in BLOCKS
        if block:
            flush()
            links, breaks = 0, 0
        if name in VOID:
            continue
        if closing:
            if opened[name]:
                while pop() != name:
                    pass
            if block:
                tag = stack[-1][0] if stack else ""
            continue
        if block and stack and stack[-1][0] == "p":
            pop()
        article = name in ("article", "main")
        while article and stray:  # left open before the article
            pop()
        marks = _marks(m[3], inside > 0) if m[3] and name not in ("html", "body", "main") else set()
        hard = (name in SKIPPED) or (name == "header" and not inside)
        skip = hard or (bool(marks) and not (article and not inside and "comment" not in m[3].lower()))
        if block or skip:
            # all marks that are still in force, or none if one of them stays
            frees = bad if article and not skip and bad + suspended == free else 0
            may = int(skip and not hard and not marks & KEPT)
            head = int(skip and name in ("head", "nav", "header"))
            stack.append((name, int(skip), int(article), frees, head, may))
            opened[name] += 1
            bad, inside, suspended, stray, free = bad + skip - frees, inside + article, suspended + frees, stray + head, free + may
            if block:
                tag = name
    flush()
    return out


def _decide(b: Block, listed: bool = True) -> bool | None:
    """Pass one: good, bad or undecided. listed: whether stop words tell anything in the page's language."""
    if b.bad:
        return False
    if b.linked / len(b.text) > LINKS:
        return None if b.tag == "p" else False
    if b.tag in HEADINGS or len(b.text) < SHORT:
        return None
    least = STOPS_LONG if len(b.text) >= LONG else STOPS
    if listed:
        return True if b.stops >= least * b.words else None
    return True if len(b.text) >= LONG else None


def _inherit(seen: list[Block], labels: list[bool | None], alone: bool) -> list[bool]:
    """Pass two. alone: the label of blocks without a decided neighbour."""
    far = len(seen) + 1
    before, after = [(far, alone)] * len(seen), [(far, alone)] * len(seen)
    for near, order in ((before, range(len(seen))), (after, range(len(seen) - 1, -1, -1))):
        away, last = far, alone
        for i in order:
            away += 1
            if labels[i] is not None:
                away, last = 0, labels[i]
            near[i] = (min(away, far), last)
    out = []
    for b, label, (x, left), (y, right) in zip(seen, labels, before, after, strict=True):
        if label is None:
            if b.tag in HEADINGS and y < far:
                label = right
            else:
                label = left or right if x == y else left if x < y else right
        out.append(label)
    return out


def main_blocks(found: list[Block]) -> list[str]:
    stops, words = sum(b.stops for b in found), sum(b.words for b in found)
    listed = stops >= STOPS_PAGE * words
    articles = [b for b in found if b.inside and not b.bad]
    least = min((b.suspended for b in [b for b in articles if _decide(b, listed)] or articles), default=0)
    for b in found:
        b.bad = b.bad or b.suspended > least
    marked = any(b.inside and not b.bad for b in found)
    seen = [b for b in found if b.inside and not b.bad] if marked else found
    labels = _inherit(seen, [_decide(b, listed) for b in seen], marked)
    return [b.text for b, label in zip(seen, labels, strict=True) if label]


def extract(page: str | None) -> str:
    return "\n".join(main_blocks(blocks(page))) if page else ""


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `main_text`."""

    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in batches:
            yield pd.Series([extract(x) for x in found], dtype=object)

    return pages.withColumn("main_text", run(F.col(html)))


def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
