"""Main text of web pages by line-block distribution.

Markup is stripped so that each block element leaves one line, and elements that the page itself declares to be menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments leave none. Lengths of text outside
links are summed over sliding windows of lines. Main text surges where a window reaches SURGE and dives where a window
holds nothing; everything between the two points stays, short lines and links included. Where article or main elements
hold most of the text, they are the region and its two ends are theirs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, small_batches, table

#: Lines summed in a window.
WINDOW = 3
#: A surge starts a text region where a window reaches this many characters outside links.
SURGE = 80
_words = lambda s: frozenset(s.split())
#: Removed elements that part a page: text on their two sides belongs to regions of their own.
_PARTING = _words("head header nav footer")
_DROP = _PARTING | _words("title script style noscript template menu aside form button select textarea iframe")
_VOID = _words("area base basefont br col embed frame hr img input keygen link meta param source track wbr")
_BLOCK = _words("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul")
#: What a start tag ends: the open element, up to the nearest of the elements that bound the search.
_ENDS = {"li": (_words("li"), _words("ol ul menu dir")), "option": (_words("option"), _words("select datalist")), "tr": (_words("tr td th"), _words("table"))}
_ENDS |= dict.fromkeys(("dt", "dd"), (_words("dt dd"), _words("dl")))
_ENDS |= dict.fromkeys(("td", "th"), (_words("td th"), _words("table tr")))
_ENDS |= dict.fromkeys(("thead", "tbody", "tfoot"), (_words("thead tbody tfoot"), _words("table")))
_P = (_words("p"), _words("button table td th caption object template"))
_NO_P_END = _words("body caption dd dt head html legend li tbody td tfoot th thead title tr")
_HEAD_CONTENT = _words("title meta link base script style noscript template")
#: End tags don't look beyond these.
_SCOPE = _words("table td th caption template html")
#: Elements whose end tag may be left out, so that their end by another tag says nothing.
_OPTIONAL_END = _words("p li dt dd td th tr thead tbody tfoot option head body html")
#: Names of classes and ids that declare what is removed. A name counts if all its parts are known and one is of the
#: first list; so "main-header-less" or "has-sidebar" says nothing.
_NAMES = _words("ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr header masthead menu menus modal nav navbar navigation navigations newsletter notice notices popup promo promos promotion promotions related replies reply respond share sharing sidebar sidebars social sponsor sponsored sponsors subscribe subscription widget widgets")
_BESIDE = _words("area bar block bottom box container global inner item items left links list main outer page pages panel primary right row secondary section site slot top unit wrap wrapper thread user users reader readers form count bar buttons icons overlay dialog text posts articles stories") | frozenset("0123456789")
_OWN = _words("header masthead banner")  # inside an article these are its own
_ROLES = _words("navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar toolbar")
_PART_ROLES = _words("navigation banner contentinfo")
_HEADING = _words("h1 h2 h3 h4 h5 h6")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]")


def _declared(name: str) -> set[str]:
    """The removal words of one class or id, empty if a part of it is unknown."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    found = {p for p in parts if p in _NAMES}
    return found if found and all(p in _NAMES or p in _BESIDE for p in parts) else set()


class _Lines(HTMLParser):
    """Lines of (text, characters outside links, inside an article or main); None where a removed element parts the page.

    Open elements are kept on a stack, so that an element whose end tag is missing ends with the next element that
    implies its end, or with what holds it. `open_ends` has the numbers of the removed elements that ended with what
    held them; told these beforehand, the parser ends each at the first paragraph or heading inside, or keeps them."""

    CDATA_CONTENT_ELEMENTS = ("script", "style", "iframe", "noframes", "noembed", "xmp")

    def __init__(self, unclosed: frozenset[int] = frozenset(), keep: bool = False):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool] | None] = []
        self.held: list[str] = []
        self.plain = 0
        self.stack: list[list] = []  # [tag, removed, starts an inside, number]
        self.removed = self.inside = self.links = self.number = 0
        self.heading = 0
        self.unclosed, self.keep = unclosed, keep
        self.open_ends: set[int] = set()

    def end_line(self) -> None:
        if self.held:
            text = _SPACE.sub(" ", "".join(self.held)).strip()
            if text:
                self.lines.append((text, self.plain, self.inside > 0))
            self.held, self.plain = [], 0

    def _pop(self, named: bool = False) -> None:
        tag, removed, inside, number = self.stack.pop()
        if tag in _BLOCK and not self.removed:
            self.end_line()
        self.removed -= removed
        self.inside -= inside
        self.links -= tag == "a"
        self.heading -= tag in _HEADING
        if removed and not named and tag not in _OPTIONAL_END:
            self.open_ends.add(number)

    def _end_open(self, tags: frozenset[str], bounds: frozenset[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i][0]
            if tag in tags:
                while len(self.stack) > i:
                    self._pop()
                return
            if tag in bounds:
                return

    def _remove(self, tag: str, attrs) -> tuple[bool, bool]:
        """(whether the element goes, whether it parts the page)."""
        if tag in _DROP:
            return not (tag == "header" and self.inside), tag in _PARTING
        if not attrs or tag in ("html", "body", "article", "main") and "comment" not in str(attrs):
            return False, False
        a = {k: v or "" for k, v in attrs if k in ("class", "id", "role")}
        if a.get("role", "").lower() in _ROLES:
            return True, a["role"].lower() in _PART_ROLES
        found = set().union(*(_declared(n) for k in ("class", "id") for n in a.get(k, "").split()))
        if self.inside:
            found -= _OWN
        return bool(found), False

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            if not self.removed:
                self.held.append(" ")
            return
        self.number += 1
        stack = self.stack
        if stack and stack[-1][0] == "title":
            self._pop()
        if stack and stack[-1][0] == "head" and tag not in _HEAD_CONTENT:
            self._pop()
        if self.removed and self.unclosed and (tag == "p" or tag in _HEADING):
            i = next((i for i, e in enumerate(stack) if e[1] and e[3] in self.unclosed), len(stack))
            while len(stack) > i:
                self._pop()
        if tag in _BLOCK and tag not in _NO_P_END:
            self._end_open(*_P)
        if tag in _ENDS:
            self._end_open(*_ENDS[tag])
        if tag in _VOID:
            if tag == "hr" and not self.removed:
                self.end_line()
            return
        goes, parts = (False, False) if self.removed else self._remove(tag, attrs)
        goes = goes and not (self.keep and self.number in self.unclosed)
        if not self.removed and (goes or tag in _BLOCK):
            if tag in _BLOCK:
                self.end_line()
            if goes and parts and not self.inside:
                self.end_line()
                self.lines.append(None)
        inside = tag in ("article", "main") and not goes and not self.removed
        stack.append([tag, goes, inside, self.number])
        self.removed += goes
        self.inside += inside
        self.links += tag == "a"
        self.heading += tag in _HEADING

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes void elements only

    def handle_endtag(self, tag):
        if tag in ("br", "p") and (tag == "br" or not any(e[0] == "p" for e in self.stack)):
            if not self.removed:
                self.end_line() if tag == "p" else self.held.append(" ")
            return
        for i in range(len(self.stack) - 1, -1, -1):
            own = self.stack[i][0]
            if own == tag:
                if tag not in _BLOCK and any(e[0] in _BLOCK for e in self.stack[i + 1 :]):
                    if not self.stack[i][1]:  # an inline element that ends inside a block begun after it
                        self.links -= tag == "a"
                        del self.stack[i]
                        return
                while len(self.stack) > i + 1:
                    self._pop()
                self._pop(named=True)
                return
            if own in _SCOPE and tag not in ("table", "body", "html", "article", "main"):
                return

    def parse_marked_section(self, i, report=1):
        """The end of what starts with <![ at i: CDATA ends at ]]>; everything else, and CDATA without that end, at the
        next >, as in browsers. The library refuses unknown and unnamed sections, and ends some far below."""
        cdata = self.rawdata[i + 3 : i + 9].lower() == "cdata["
        end = self.rawdata.find("]]>", i) if cdata else -1
        return end + 3 if end >= 0 else self.parse_bogus_comment(i, report)

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self._pop()
        if not self.removed:
            self.held.append(data)
            if not self.links or self.heading:
                self.plain += len(data.strip())


def _read(page: str, unclosed: frozenset[int] = frozenset(), keep: bool = False) -> _Lines:
    parser = _Lines(unclosed, keep)
    parser.feed(page)
    parser.close()
    while parser.stack:
        parser._pop()
    parser.end_line()
    return parser


def _regions(lines: list) -> list[tuple[int, int, int, int]]:
    """(start, end, weight, highest window) of each stretch of lines from a surge to a dive, without links at its ends.

    blocks[i] is the sum of the characters outside links over lines i to i + WINDOW - 1 of one part of the page. A
    surge is the first window of SURGE characters after a dive, or the highest window of a part without one."""
    out, at = [], 0
    for end in [i for i, x in enumerate(lines) if x is None] + [len(lines)]:
        plain = [x[1] for x in lines[at:end]]
        blocks = [sum(plain[i : i + WINDOW]) for i in range(len(plain))]
        surge = min(SURGE, max(blocks, default=0))
        i = 0
        while i < len(blocks):
            if blocks[i] >= surge > 0:
                to = i
                while to < len(blocks) and blocks[to] > 0:
                    to += 1
                own = [j for j in range(i, to) if plain[j]]
                out.append((at + own[0], at + own[-1] + 1, sum(plain[i:to]), max(blocks[i:to])))
                i = to
            else:
                i += 1
        at = end + 1
    return out


def main_text(page: str) -> str:
    """The main text of one page; empty if there is none. Malformed markup is read as far as it makes sense: a removed
    element that is never closed ends at the first paragraph or heading in it, and is kept if nothing else is left."""
    parser = _read(page)
    if unclosed := frozenset(parser.open_ends):
        parser = _read(page, unclosed)
        if not any(parser.lines):
            parser = _read(page, unclosed, keep=True)
    texts = [x for x in parser.lines if x]
    inside = [x for x in texts if x[2]]
    if 2 * sum(len(x[0]) for x in inside) > sum(len(x[0]) for x in texts):
        return "\n\n".join(x[0] for x in inside)
    regions = _regions(parser.lines)
    best = max((r[2] for r in regions), default=0)
    # a part of the page that never surges is text only if it is the largest
    kept = [r for r in regions if r[3] >= SURGE or r[2] == best]
    return "\n\n".join(x[0] for a, b, _, _ in kept for x in parser.lines[a:b])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, pages in chunks(batch, "html"):
            texts = [main_text(p) for p in pages.to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html; other columns are ignored).

    Null or empty html gives an empty text with n_chars 0; null ids and urls pass through; equal pages and repeated rows
    are extracted once each; a very long page is handled alone in its worker; an empty table gives no rows. Of regions
    that tie for the largest, all stay."""
    return small_batches(pages).select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; see extract()."""
    return extract(table(spark, sf_dir, "pages"))
