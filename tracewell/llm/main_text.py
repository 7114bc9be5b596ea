"""Main text of web pages by line-block distribution.

1. Markup is stripped in one pass over the tags. A block element's text is a line; where more than two block borders lie
   between two texts, empty lines stand for the rest, so that nesting leaves gaps as it does in pretty-printed source (not
   within article elements, where nesting says nothing). What elements' names or roles mark as a menu, header, footer,
   sidebar or form gives one empty line; within an article it goes without one, as adverts and reader comments do.
2. A line weighs as many characters as it has outside links; headings and lines within articles weigh all of theirs. Lines
   that a whole class or id marks as boilerplate weigh nothing; nor do, on a page with article or main elements, those outside.
3. The weights are summed over a sliding window of WINDOW lines: the distribution of line blocks. A surge is where a block
   passes THRESHOLD characters, or half of the page's largest block if that is less; the text begins at the first line of
   weight there, and reaches back over lines of weight that follow one another. A dive is where the blocks reach zero. The
   lines between each surge and its dive are kept, but for marked ones.

So menus, adverts and lists of links before, after and between the running text go by their weights; within an article
nothing is dropped but adverts, comments and what elements mark.

If marked classes, ids and forms leave no text at all, they are not believed and only elements' names and roles count.

Defined results: null and empty pages, and those without text, give the empty text; of repeated pages each gives its own;
pages are read whole, however long, in time linear in their length; other columns are ignored. Unclosed tags close with
their parents; an unclosed script, style or comment runs to the end; an attribute's unclosed quote ends at the next `>`.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 3
THRESHOLD = 86  # characters in a window that begin a stretch

_SPACE = re.compile(r"\s+")
# The last branch takes tags without quotes whole; others are read attribute by attribute.
_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*)(>|\Z)?", re.S)
# HTML's attribute syntax: quotes count only where a value begins.
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(=?[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+)?+", re.S)
# Elements of HTML by their part in a page.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
_DROPPED = {"nav", "footer", "aside", "form", "button", "select", "option", "head", "svg", "canvas", "object", "dialog", "menu", "label", "fieldset", "audio", "video", "map", "datalist"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ZONES = {"article", "main"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
# Whole classes and ids of boilerplate, alone or with a word for the page in front; and those that say so as any part of a name.
_MARKED = re.compile(
    r"(?:(?:site|page|global|main|top|bottom)[_-])?(?:header|footer|nav|navigation|menu|banner|notice|masthead|topbar|toolbar|search|login|signup|share|sharing|social|related|recommended|widget|copyright|pagination|pager|overlay|comment|comments|respond|replies|promo|skip-link|subscribe|side)",
    re.I,
)
_MARKED_PART = re.compile(r"(?:.*[_-])?(?:ads?|advert|adverts|advertisement|advertising|adbox|sponsor|sponsored|cookies?|consent|gdpr|newsletter|popup|navbar|sidebar|breadcrumbs?|comments|disqus)(?:[_-].*)?", re.I)
_UNMARKED = {"article", "main", "body", "html", "h1"}
_END = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in _RAW}


@dataclass
class Line:
    text: str
    own: int  # characters that weigh
    article: bool
    marked: bool = False  # by a class or id, as boilerplate


_GAP = Line("", 0, False)
_PLAIN_BLOCKS = {"p", "blockquote", "pre", "figure", "figcaption", "table"} | _HEADINGS  # an article's own, whatever their class


def attributes_of(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag from the end of its name on, and where the tag ends."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        at = m.end()
        if not m[1]:
            break
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found, at + 1 if page[at : at + 1] == ">" else max(page.find(">", at) + 1, at + 1)


def _noisy(name: str, found: dict[str, str], in_article: bool, marks: bool) -> bool:
    """Whether an element is left out by its name, role or invisibility, or in an article as an advert or comments."""
    if name in _DROPPED and (marks or name != "form") or (name == "header" and not in_article):
        return True
    if not found or name in _UNMARKED:
        return False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    if found.get("role", "").lower() in _ROLES:
        return True
    return marks and in_article and name not in _PLAIN_BLOCKS and any(_MARKED_PART.fullmatch(x) for x in _names(found))


def _names(found: dict[str, str]) -> list[str]:
    return [x for k in ("class", "id") for x in found.get(k, "").split()]


def _marked(name: str, found: dict[str, str]) -> bool:
    return bool(found) and name not in _UNMARKED and any(_MARKED.fullmatch(x) or _MARKED_PART.fullmatch(x) for x in _names(found))


def lines_of(page: str, marks: bool = True) -> list[Line]:
    """The lines of a page, boilerplate left out; `marks`: whether classes, ids and forms may mark it."""
    out: list[Line] = []
    parts: list[str] = []
    own = breaks = 0
    stack: list[tuple[str, bool, bool]] = []  # open elements, and whether they are noise or marked
    open_: dict[str, int] = {}  # how many elements of each name are open
    noise = marked = links = headings = articles = 0
    at, n = 0, len(page)

    def end_line() -> None:
        nonlocal parts, own, breaks
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                if out and not articles:
                    out.extend([_GAP] * min(breaks - 2, WINDOW))
                out.append(Line(text, own, articles > 0, marked > 0))
                breaks = 0
            parts, own = [], 0
        breaks += 1

    def border() -> None:
        out.extend([_GAP] * WINDOW)

    def close(name: str) -> None:
        nonlocal noise, marked, links, headings, articles
        while True:
            top, bad, said = stack.pop()
            open_[top] -= 1
            noise -= bad
            marked -= said
            links -= top == "a"
            headings -= top in _HEADINGS
            if top in _ZONES:
                articles -= 1
                if not articles:
                    border()
            if bad and not articles:
                out.append(_GAP)
            if top == name:
                return

    while at < n:
        m = _TAG.search(page, at)
        stop = m.start() if m else n
        if stop > at and not noise:
            parts.append(page[at:stop])
            if not links or headings or articles:
                own += len(page[at:stop].strip())
        if not m:
            break
        at = m.end()
        if m[1] is not None and not noise:
            parts.append(html.escape(m[1]))
            own += len(m[1])
        name = m[3]
        if not name:
            continue
        name = name.lower()
        found: dict[str, str] = {}
        empty = m[4].endswith("/")
        if m[5] is None:  # a quote
            found, at = attributes_of(page, m.end(3))
            empty = page[at - 2 : at] == "/>"
        elif m[4] and not m[2]:
            found, _ = attributes_of(page, m.end(3))
        if m[2]:
            if name in _BLOCK and not noise:
                end_line()
            if open_.get(name):
                close(name)
            continue
        if name in _RAW:
            if not empty:
                e = _END[name].search(page, at)
                at = max(page.find(">", e.start()) + 1, e.end()) if e else n
            continue
        if name == "br" and not noise:
            parts.append(" ")
        if name in _BLOCK:
            if not noise:
                end_line()
            if name in _CLOSES_P and open_.get("p"):
                # a block ends an open paragraph, if no other block was opened within it
                for top, *_ in reversed(stack):
                    if top == "p":
                        close("p")
                        break
                    if top in _BLOCK:
                        break
            if name == "li" and stack and stack[-1][0] == "li":
                close("li")
        if name in _VOID or empty:
            continue
        bad = not noise and _noisy(name, found, articles > 0, marks)
        said = marks and not articles and _marked(name, found)
        if bad or (said and not noise and name in _BLOCK):
            end_line()
        if name in _ZONES:
            if not articles:
                border()
            articles += 1
        stack.append((name, bad, said))
        open_[name] = open_.get(name, 0) + 1
        noise += bad
        marked += said
        links += name == "a"
        headings += name in _HEADINGS
    end_line()
    return out


def blocks_of(weights: list[int], window: int = WINDOW) -> list[int]:
    """The distribution: the sum of `window` lines from each one on."""
    return [sum(weights[i : i + window]) for i in range(len(weights))]


def stretches(weights: list[int], window: int = WINDOW, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """[begin, end) of the lines between each surge and its dive."""
    blocks = blocks_of(weights, window)
    n, out, i = len(weights), [], 0
    while i < n:
        if blocks[i] > threshold:
            begin = i
            while not weights[begin]:
                begin += 1
            before = out[-1][1] if out else 0
            while begin > before and weights[begin - 1]:
                begin -= 1
            while i < n and blocks[i]:
                i += 1
            out.append((begin, i))
        i += 1
    return out


def main_text(page: str, threshold: int = THRESHOLD) -> str:
    """The main text; with a negative threshold, the distribution is left out and all lines stay."""
    lines = lines_of(page)
    if not any(x.text and not x.marked for x in lines):
        lines = lines_of(page, marks=False)
    if threshold < 0:
        return "\n".join(x.text for x in lines if x.text)
    zoned = any(x.article for x in lines)
    counts = [not x.marked and (x.article or not zoned) for x in lines]
    weights = [x.own if c else 0 for x, c in zip(lines, counts, strict=True)]
    if not any(weights):  # all text is in links
        weights = [len(x.text) if c else 0 for x, c in zip(lines, counts, strict=True)]
    least = min(threshold, max(blocks_of(weights), default=0) / 2)
    return "\n".join(x.text for a, b in stretches(weights, threshold=least) for x in lines[a:b] if x.text and not x.marked)


def main_text_column(page: Column | str) -> Column:
    """The main text (never null) of a column of HTML."""

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py() or "") for x in pages], pa.string())

    return extract(page)
