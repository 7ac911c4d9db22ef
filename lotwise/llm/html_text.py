"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element gives a line.  Lines inside elements that are
no content by their tag, role, class or id (menus, headers, footers, sidebars, notices,
adverts, forms, comments of readers) count as blank; text of links counts for nothing.  The
lengths of ``SPAN`` lines in a row are summed.  Text surges where a sum reaches ``SURGE`` and
dives where it falls to zero; the lines between, with the shorter ones that touch them, are the
main text.

Where the page names an element its article, the article sets the level: its lines are text,
but parts whose class or id has a word of ``_WEAK`` have to surge themselves; and text outside
of it has to surge higher than any of the article's own windows.
"""
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import common

SPAN, SURGE = 3, 80

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s<>/\"']*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)/?>|<(/?)([a-zA-Z][^\s<>/\"']*+)([^<>]*)>|<[!?][^>]*>",
    re.S)
# elements whose content is no text of the page; unclosed ones hide nothing, but raw text runs to the end of the page
_RAW = frozenset("script style textarea iframe".split())
_HIDDEN = _RAW | frozenset("title noscript template svg math object canvas select".split())
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_ENDS = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.I) for tag in _HIDDEN - _RAW}
_CUT_OFF = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+(?![a-z])")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILER_TAGS = frozenset("nav header footer aside form button dialog menu".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_BOILER_TOKENS = frozenset(("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion promotions banner banners nav navbar navigation menu menus "
                            "header masthead topbar footer bottombar sidebar sidebars aside breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay "
                            "newsletter subscribe subscription signup login signin share sharing social related recommended recommendations widget widgets comment comments disqus respond reply replies discussion "
                            "pagination pager toolbar tags copyright legal disclaimer outbrain taboola").split())
_CONTENT_TAGS = frozenset(("article", "main"))
# elements that an opening tag of the same kind closes
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NOT_THE_ARTICLE = frozenset("ad ads advert sponsored promo comment comments reply replies related teaser recommended sidebar".split())
_HEADLINE_TOKENS = frozenset("header masthead tags".split())
# words that inside an article may as well name a part of it
_WEAK = frozenset("widget widgets alert modal overlay popup toolbar tags legal disclaimer copyright".split())
_TRANSPARENT = frozenset("p b i em strong span".split())
NOTHING, SOFT, HARD, WEAK = 0, 1, 2, 3


def _boiler(tag: str, attributes: str, content: bool) -> int:
    """Whether an element is boilerplate: HARD by what it is, SOFT by what its class or id says, WEAK if that is open inside an article."""
    weak = NOTHING
    if tag in _BOILER_TAGS:
        # the headline of an article may stand in a header of its own
        return NOTHING if tag == "header" and content else HARD
    if not attributes.strip() or tag in ("html", "head", "body"):
        return NOTHING
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        low = value.lower()
        if name == "role" and low in _BOILER_ROLES or name == "hidden" or name == "aria-hidden" and low == "true" or name == "style" and "display:none" in low.replace(" ", ""):
            return HARD
        if name in ("class", "id"):
            tokens = {token.lower() for token in _TOKEN.findall(value)}
            known = _NOT_THE_ARTICLE if tag in _CONTENT_TAGS else _BOILER_TOKENS - _HEADLINE_TOKENS if content else _BOILER_TOKENS
            said = known & tokens
            if content and tag not in _CONTENT_TAGS and said and said <= _WEAK:
                weak = WEAK
            elif said:
                return SOFT
    return weak


def _is_content(tag: str, attributes: str) -> bool:
    return tag in _CONTENT_TAGS or any(name.lower() in ("role", "itemprop") and "".join(values).lower() in ("main", "article", "articlebody") for name, *values in _ATTRIBUTE.findall(attributes))


class _Hidden:
    """Where hidden elements of a page end; each kind is looked for once."""

    def __init__(self, page: str):
        self.page, self.ends, self.open = page, {}, set()

    def end(self, tag: str, start: int, after: int) -> int | None:
        """The end of an element that starts at ``start``; None if it is not closed."""
        if tag in _RAW:
            close = None if tag in self.open else _CLOSE[tag].search(self.page, after)
            if close is None:
                self.open.add(tag)
                return len(self.page)
            return self._behind(close.end())
        if tag not in self.ends:
            pairs, opened = {}, []
            for mark in _ENDS[tag].finditer(self.page):
                if not mark[1]:
                    opened.append(mark.start())
                elif opened:
                    pairs[opened.pop()] = mark.end()
            self.ends[tag] = pairs
        end = self.ends[tag].get(start)
        return None if end is None else self._behind(end)

    def _behind(self, at: int) -> int:
        return self.page.find(">", at) + 1 or len(self.page)


def lines(page: str) -> list[tuple[str, int, int, int, int]]:
    """Per block of text: the text, its length without links, the depth of boilerplate and of named content around it, and the weak element it is in."""
    found: list[tuple[str, int, int, int, int]] = []
    parts: list[str] = []
    plain = links = hard = soft = content = weak = at = 0
    stack: list[tuple[str, int, int, int, int]] = []  # tag, and the counts outside of it
    places: defaultdict[str, list[int]] = defaultdict(list)  # depths of the open elements of a tag
    walls: list[int] = []  # depths of the open elements that are not transparent

    def close_line() -> None:
        nonlocal plain
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((text, plain, hard + soft, content, weak))
            parts.clear()
        plain = 0

    def push(tag: str, kind: int, named: bool) -> None:
        nonlocal hard, soft, content, weak
        places[tag].append(len(stack))
        if tag not in _TRANSPARENT:
            walls.append(len(stack))
        stack.append((tag, hard, soft, content, weak))
        if named and not kind and not content:
            soft = 0  # a wrapper whose class has such a word may hold the article
        hard += kind == HARD
        soft += kind == SOFT
        content += named and kind in (NOTHING, WEAK)
        if kind == WEAK and not weak:
            weak = at  # the outermost one; 0 is none

    def pop(upto: int) -> None:
        nonlocal hard, soft, content, weak
        if len(stack) > upto:
            _, hard, soft, content, weak = stack[upto]
            while len(stack) > upto:
                places[stack.pop()[0]].pop()
            while walls and walls[-1] >= upto:
                walls.pop()

    def put(text: str) -> None:
        nonlocal plain
        parts.append(text)
        if not links:
            plain += len(text.strip())

    hidden = _Hidden(page)
    while mark := _MARKUP.search(page, at):
        if mark.start() > at:
            put(page[at: mark.start()])
        at = mark.end()
        tag = (mark[2] or mark[5] or "").lower()
        if not tag:
            continue
        closing, attributes = mark[1] or mark[4], mark[3] or mark[6] or ""
        if tag in _HIDDEN and not closing and not (tag in ("svg", "math") and mark[0].endswith("/>")):
            end = hidden.end(tag, mark.start(), at)
            if end is not None:
                close_line()
                at = end
                continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            kind = NOTHING if closing or tag in _EMPTY else _boiler(tag, attributes, content > 0)
            if kind in (SOFT, HARD):
                close_line()
                push(tag, kind, False)
            elif closing and stack and stack[-1][0] == tag:
                close_line()
                pop(len(stack) - 1)
            continue
        close_line()
        links = 0
        if closing:
            if places[tag]:
                pop(places[tag][-1])
            continue
        if tag in _EMPTY:
            continue
        if tag in _SELF_CLOSING:
            depth = max((places[kind][-1] for kind in _SELF_CLOSING[tag] if places[kind]), default=-1)
            if depth >= 0 and depth >= (walls[-1] if walls else 0):
                pop(depth)
        push(tag, _boiler(tag, attributes, content > 0), _is_content(tag, attributes))
    if at < len(page):
        cut = _CUT_OFF.search(page, at)
        put(page[at: cut.start()] if cut else page[at:])
    close_line()
    return found


def _surges(sizes: list[int], span: int, least: float | None, surge: int = SURGE) -> list[int]:
    """Indexes of the lines between a surge to ``least`` (null: to ``surge``, or the highest there is) and its dive."""
    sums = [sum(sizes[i: i + span]) for i in range(len(sizes))]
    least = min(surge, max(sums, default=0)) if least is None else least
    kept, i = [], 0
    while i < len(sizes):
        if not sizes[i]:
            i += 1
            continue
        end = i  # up to the dive: the next ``span`` lines have no text
        while end < len(sizes) and sums[end]:
            end += 1
        if max(sums[i:end]) >= least:
            kept += [j for j in range(i, end) if sizes[j]]
        i = end
    return kept


def main_text(page: str | None, span: int = SPAN, surge: int = SURGE) -> str:
    """The main text's blocks, joined by newlines; empty if the page has none.  A null page is an empty one."""
    rows = lines(page or "")
    inside = [bool(content and not boiler) for _, _, boiler, content, _ in rows]
    sizes = [0 if boiler else plain for _, plain, boiler, _, _ in rows]
    if not any(inside):
        return "\n".join(rows[i][0] for i in _surges(sizes, span, None, surge))
    article, rest = [i for i, own in enumerate(inside) if own], [i for i, own in enumerate(inside) if not own]
    kept = []
    for weak, lot in groupby(article, key=lambda i: rows[i][4]):
        part = list(lot)
        kept += [part[j] for j in _surges([sizes[i] for i in part], span, surge)] if weak else part
    lengths = [len(rows[i][0]) for i in kept]
    higher = max((sum(lengths[i: i + span]) for i in range(len(lengths))), default=0) + 1
    for _, lot in groupby(enumerate(rest), key=lambda pair: pair[1] - pair[0]):
        part = [i for _, i in lot]
        kept += [part[j] for j in _surges([sizes[i] for i in part], span, max(surge, higher))]
    return "\n".join(rows[i][0] for i in sorted(kept))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.slices(whole, 2, 4 << 20):
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    Null and empty pages have an empty text; repeated rows have equal results.  Other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return common.arrow_map(rows, _extract, "page_id long, url string, text string, n_chars long")
