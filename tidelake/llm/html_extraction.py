"""Operator 11, main text of web pages by two-pass block rules.

A page is read once from front to back: tags part its text into blocks, character references are decoded, white
space inside a block becomes one space. Then

1. each block is judged on its own: what stands in a menu, header, footer, sidebar, notice, advert, form, script,
   style or in readers' comments (by element, role, class or id) is dropped, and so is what mostly consists of links;
   a long block with enough stop words is good, a long one without them is bad, and everything else is undecided;
2. an undecided block takes the label of its nearest decided neighbours. A heading asks the block after it first;
   between a good and a bad one at equal distance, stop words speak for good. A page without any decided block
   keeps its undecided ones.

``article`` and ``main`` are evidence as well: a long block of an article is good whatever its words, one good
neighbour is enough there, and a page that has an article with text keeps nothing outside it.

Blocks, their labels and the joined text of a page stay in one task; nothing is shuffled. Work is in proportion to
the page's length, however broken its markup: each unclosed quote, comment or element is searched for once.

Defined results: a null or empty page has an empty text; repeated rows each get a row; a null page_id or url stays
null; very long pages are read whole; an empty table gives an empty result; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is that it for was on are as with at be this from have or by not but which an when will "
    "der die das und ist nicht ein eine zu den von mit sich auf für dem des auch es im als wird bei aus nach wie "
    "le la les et est une un du des que qui dans pour pas sur au avec par plus ce il elle sont mais ou son se "
    "el los las y en por con para una del al lo como más su pero sus este entre cuando muy sin sobre también hay".split()
)
# Elements of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE_TAGS = frozenset("span b i em strong small ins label font u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt".split())
#: Elements that are no part of an article, wherever they stand; those of SOFT_TAGS end where an article begins.
HARD_TAGS = frozenset("footer aside noscript template object svg math canvas audio video select button dialog datalist".split())
SOFT_TAGS = frozenset("nav menu form header".split())
#: Words of class, id and role that say the same.
HARD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion aside sidebar complementary comment comments "
    "commentlist disqus respond reply replies discussion related recommended recommendations teaser widget footer contentinfo colophon "
    "share sharing social newsletter subscribe subscription popup modal overlay hidden".split()
)
SOFT_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar pager pagination skip search login signup register cookie cookies consent gdpr "
    "notice notices alert dialog form copyright legal disclaimer imprint banner masthead topbar".split()
)
#: These words name a page's header outside of an article, and an article's own one inside.
HEADER_WORDS = frozenset("header banner masthead".split())

SHORT_CHARS, LONG_CHARS = 70, 140
MANY_STOP_WORDS, FEW_STOP_WORDS, MANY_LINKS = 0.15, 0.05, 0.5

GOOD, BAD, UNDECIDED = 1, 0, -1

_TAG = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
_WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("parts", "linked", "section", "heading", "dropped")

    def __init__(self, section: int, heading: bool, dropped: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.section, self.heading, self.dropped = section, heading, dropped


def _aversion(tag: str, attributes: str, inside_article: bool) -> int:
    """0: may be main text, 1: not unless an article begins inside, 2: not at all."""
    if tag in HARD_TAGS:
        return 2
    soft = tag in SOFT_TAGS and not (tag == "header" and inside_article)
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return 2
        if name == "style" or tag in ("html", "body", "main"):
            continue
        for item in value.split():
            words = {w.lower() for w in _NAME_PART.findall(item)}
            if words & {"has", "with", "no", "without"}:  # tells of something elsewhere
                continue
            if words & HARD_WORDS:
                return 2
            soft |= bool(words & (SOFT_WORDS - HEADER_WORDS)) or (bool(words & HEADER_WORDS) and not inside_article)
    return int(soft)


class Page:
    """Reads markup into blocks. The stack holds what is open of blocks and of dropped inline elements: (tag, aversion, section, link)."""

    def __init__(self, html: str):
        self.html, self.blocks = html, []
        self.stack: list[tuple[str, int, int, bool]] = []
        self.open: Counter[str] = Counter()
        self.aversion, self.section, self.link = 0, 0, False
        self.no_more: set[str] = set()  # quotes and marks that don't occur any more
        self.block = Block(0, False, False)
        self._read()
        self._part(False)

    def _find(self, mark: str, at: int) -> int:
        found = -1 if mark in self.no_more else self.html.find(mark, at)
        if found < 0:
            self.no_more.add(mark)
        return found

    def _tag_end(self, at: int) -> int:
        """Where the tag ends. A quote counts after an equals sign, and if it is closed."""
        while m := _QUOTE_OR_END.search(self.html, at):
            if m[0] == ">":
                return m.start()
            k = m.start() - 1
            while self.html[k].isspace():
                k -= 1
            closed = self._find(m[0], m.end()) if self.html[k] == "=" else -1
            at = max(closed, m.start()) + 1
        return -1

    def _part(self, heading: bool) -> None:
        """A new block begins."""
        if self.block.parts:
            self.blocks.append(self.block)
        self.block = Block(self.section, heading, self.aversion > 0)

    def _text(self, text: str) -> None:
        if text:
            text = unescape(text) if "&" in text else text
            self.block.parts.append(text)
            if self.link:
                self.block.linked += len(text.strip())

    def _push(self, tag: str, attributes: str) -> None:
        self.stack.append((tag, self.aversion, self.section, self.link))
        self.open[tag] += 1
        if tag in ("article", "main"):
            own = _aversion(tag, attributes, False)
            self.aversion = max(own, self.aversion if self.aversion > 1 else 0)
            self.section = max(self.section, 2 if tag == "article" else 1)
        else:
            self.aversion = max(self.aversion, _aversion(tag, attributes, self.section > 0))

    def _pop(self, tag: str) -> None:
        """Closes the innermost element of that name with all that is open in it; each was opened once."""
        while self.open[tag]:
            name, self.aversion, self.section, self.link = self.stack.pop()
            self.open[name] -= 1
            if name == tag:
                break

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK_TAGS:
            if self.stack and self.stack[-1][0] == "p":
                self._pop("p")
            if tag in ("li", "dt", "dd", "td", "th", "tr", "option") and self.stack and (top := self.stack[-1][0]) in (tag, *{"dt": ("dd",), "dd": ("dt",), "td": ("th",), "th": ("td",)}.get(tag, ())):
                self._pop(top)
            if tag not in ("hr", "html", "body", "head"):
                self._push(tag, attributes)
            self._part(tag in HEADINGS)
        elif tag == "a":
            self.link = True
        elif tag == "br":
            self._text(" ")
        elif self.open[tag] or tag in HARD_TAGS or (tag in INLINE_TAGS and attributes and _aversion(tag, attributes, self.section > 0)):
            if not attributes.endswith("/"):
                self._push(tag, attributes)
                self._part(False)

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        elif self.open[tag]:
            self._pop(tag)
            self._part(False)
        elif tag in BLOCK_TAGS:
            self._part(False)

    def _read(self) -> None:
        html, at, seen = self.html, 0, 0
        while m := _TAG.search(html, at):
            mark = m[0]
            if mark == "<!--":
                end = self._find("-->", m.start() + 2)
                stop = len(html) if end < 0 else end + 3
            else:
                end = self._tag_end(m.end())
                if end < 0:  # no tag, as it never ends
                    break
                stop = end + 1
            self._text(html[seen : m.start()])
            at = seen = stop
            if mark[1] in "!?":
                continue
            if mark[1] == "/":
                self._end(mark[2:].lower())
                continue
            tag, attributes = mark[1:].lower(), html[m.end() : end]
            if tag in RAW_TAGS:
                close = self._raw_end(tag, stop)
                at = seen = len(html) if close < 0 else close
            else:
                self._start(tag, attributes)
        self._text(html[seen:])

    def _raw_end(self, tag: str, at: int) -> int:
        """Where the end tag of a script, a style or the like begins."""
        mark = f"</{tag}"
        if mark in self.no_more:
            return -1
        m = re.compile(re.escape(mark) + r"(?=[\s/>])", re.I).search(self.html, at)
        if not m:
            self.no_more.add(mark)
        return m.start() if m else -1


def _label(text: str, linked: int, section: int) -> int:
    """Pass one: a block by its own length, links and stop words."""
    if linked > MANY_LINKS * len(text):
        return BAD
    if len(text) < SHORT_CHARS:
        return BAD if not section and text.startswith("©") else UNDECIDED
    words = [w.lower() for w in _WORD.findall(text)]
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if len(text) < LONG_CHARS:
        return UNDECIDED
    return GOOD if section or stops >= MANY_STOP_WORDS else BAD if stops < FEW_STOP_WORDS else UNDECIDED


def _nearest(labels: list[int], step: int) -> list[tuple[float, int]]:
    """For each block the distance to the next decided one in that direction, and its label."""
    out, far, label = [], float("inf"), UNDECIDED
    for x in labels[::step]:
        far += 1
        out.append((far, label))
        if x != UNDECIDED:
            far, label = 0, x
    return out[::step]


def _settled(labels: list[int], headings: list[bool], prose: list[bool], article: bool) -> list[int]:
    """Pass two: undecided blocks inherit."""
    out = []
    for own, heading, words, (before, left), (after, right) in zip(labels, headings, prose, _nearest(labels, 1), _nearest(labels, -1), strict=True):
        if own != UNDECIDED:
            out.append(own)
        elif left == right:
            out.append(GOOD if left == UNDECIDED else left)
        elif heading and right != UNDECIDED:
            out.append(right)
        elif before == after or article:
            out.append(GOOD if words or article else BAD)
        else:
            out.append(left if before < after else right)
    return out


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by one space."""
    read = [(b, " ".join("".join(b.parts).split())) for b in Page(html or "").blocks]
    read = [(b, text) for b, text in read if text]
    kept = [(b, text) for b, text in read if not b.dropped]
    section = max((b.section for b, _ in kept), default=0)
    if section:  # what stands outside is no part of the article; dropped neighbours inside say nothing about it
        kept = [(b, text) for b, text in kept if b.section == section]
        labels = [_label(text, b.linked, section) for b, text in kept]
    else:
        kept = read
        labels = [BAD if b.dropped else _label(text, b.linked, 0) for b, text in kept]
    decided = any(x != UNDECIDED and not b.dropped for x, (b, _) in zip(labels, kept, strict=True))
    if section or not decided:
        labels = [UNDECIDED if x == BAD and b.dropped else x for x, (b, _) in zip(labels, kept, strict=True)]
    prose = [any(w.lower() in STOP_WORDS for w in _WORD.findall(text)) for _, text in kept]
    labels = _settled(labels, [b.heading for b, _ in kept], prose, section > 0)
    return " ".join(text for (b, text), label in zip(kept, labels, strict=True) if label == GOOD and not b.dropped)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), 500):
            part = batch.slice(a, 500)
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            lengths = pa.array(map(len, texts), pa.int64())
            yield pa.record_batch([part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extracted, "page_id bigint, url string, text string, n_chars bigint")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op11_html_extraction": op11_html_extraction}
ORACLES = {
    # The given tables' pages hold their text in one article of p, h1, b and br; what SQL can say of them.
    "op11_html_extraction": r'''
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages),
        b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS x FROM a),
        c AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g') AS x FROM b),
        d AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&#x27;', chr(39), 'g') AS x FROM c),
        e AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(x, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM d)
        SELECT page_id, url, text, length(text) AS n_chars FROM e''',
}
