"""Main text against a plain version of the distribution, pages of known articles, and markup that breaks rules."""

import random
from html.parser import HTMLParser

import duckdb
import pytest

from tests.llm.conftest import WORDS
from tracewell.llm import entry, main_text

SF = "/root/testdata/sf0.001"
BLOCKS = {"html", "body", "nav", "ul", "li", "div", "article", "main", "section", "header", "footer", "aside", "h1", "h2", "p", "table", "tr", "td"}


class Plain(HTMLParser):
    """Lines of well-formed pages without marked classes: (text, characters outside links, in article)."""

    def __init__(self):
        super().__init__()
        self.lines, self.parts, self.breaks, self.open = [], [], 0, []

    def flush(self):
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            if self.lines and not self.zone():
                self.lines += [("", 0, False)] * max(0, self.breaks - 2)
            self.lines.append((text, sum(len(t.strip()) for t, counts in self.parts if counts or self.zone()), self.zone()))
            self.breaks = 0
        self.parts = []
        self.breaks += 1

    def zone(self):
        return any(x in ("article", "main") for x in self.open)

    def noise(self):
        return any(x in ("nav", "footer", "aside", "script", "style", "title") or (x == "header" and not any(y in ("article", "main") for y in self.open[:i])) for i, x in enumerate(self.open))

    def handle_starttag(self, tag, attrs):
        quiet = self.noise()
        if tag in BLOCKS and not quiet:
            self.flush()
        if tag in ("article", "main") and not self.zone():
            self.lines += [("", 0, False)] * 3
        self.open.append(tag)
        if self.noise() and not quiet and tag not in ("script", "style", "title"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in BLOCKS and not self.noise():
            self.flush()
        quiet = self.noise()
        self.open.pop()
        if quiet and not self.noise() and not self.zone() and tag not in ("script", "style", "title"):
            self.lines.append(("", 0, False))
        if tag in ("article", "main") and not self.zone():
            self.lines += [("", 0, False)] * 3

    def handle_data(self, data):
        if not self.noise():
            self.parts.append((data, "a" not in self.open or "h1" in self.open or "h2" in self.open))


def brute(page, window=3, threshold=86):
    """A line stays if it lies in a run of blocks above zero, not before the first line of weight at the run's first surge, or joined to that by lines of weight."""
    parser = Plain()
    parser.feed(page)
    parser.flush()
    lines = parser.lines
    zoned = any(z for _, _, z in lines)
    w = [x[1] if x[2] or not zoned else 0 for x in lines]
    w = w if any(w) else [len(x[0]) if x[2] or not zoned else 0 for x in lines]
    blocks = [sum(w[i : i + window]) for i in range(len(w))]
    least = min(threshold, max(blocks, default=0) / 2)
    out = []
    for i, (text, _, _) in enumerate(lines):
        if not text or not blocks[i]:
            continue
        first = last = i
        while first and blocks[first - 1]:
            first -= 1
        while last + 1 < len(lines) and blocks[last + 1]:
            last += 1
        surges = [k for k in range(first, last + 1) if blocks[k] > least]
        if not surges:
            continue
        begin = next(k for k in range(surges[0], last + 1) if w[k])
        if i >= begin or all(w[k] for k in range(i, begin)):
            out.append(text)
    return "\n".join(out)


def random_page(rnd):
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    pieces = [
        lambda: f"<p>{say(rnd.randint(1, 40))}</p>", lambda: f"<div>{say(rnd.randint(1, 6))}</div>", lambda: f"<h2>{say(3)}</h2>", lambda: f'<p><a href="/x">{say(3)}</a></p>',
        lambda: "<ul>" + "".join(f'<li><a href="/y">{say(2)}</a></li>' for _ in range(rnd.randint(1, 6))) + "</ul>", lambda: f"<nav>{say(4)}</nav>", lambda: f"<aside>{say(30)}</aside>",
        lambda: f"<div><div><div><p>{say(rnd.randint(1, 30))}</p></div></div></div>", lambda: f"<table><tr><td>{say(2)}</td><td>{say(2)}</td></tr></table>", lambda: f'<h2><a href="/z">{say(2)}</a></h2>',
        lambda: f"<header>{say(5)}</header>", lambda: f"<section>{say(rnd.randint(1, 20))} <b>{say(1)}</b></section>",
    ]
    some = lambda k: "".join(rnd.choice(pieces)() for _ in range(rnd.randint(0, k)))
    inner = "".join(f"<{t}>{some(8)}</{t}>" for t in rnd.sample(["article", "main", "article"], rnd.randint(0, 2)))
    return f"<html><body>{some(6)}{inner}{some(6)}<footer>{say(9)}</footer></body></html>"


def test_against_plain_version():
    rnd = random.Random(4)
    pages = [random_page(rnd) for _ in range(1500)]
    assert [main_text.main_text(p) for p in pages] == [brute(p) for p in pages]
    # the distribution decides: without it, other lines stay
    without = [main_text.main_text(p, threshold=-1) for p in pages]
    assert sum(a != b for a, b in zip(without, map(main_text.main_text, pages), strict=True)) > 300


def test_known_articles():
    """Articles with and without their element, between boilerplate that is marked by elements or classes, or only by its links."""
    rnd = random.Random(5)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    links = lambda: "<ul>" + "".join(f'<li><a href="/{i}">{say(2)}</a></li>' for i in range(6)) + "</ul>"
    around = [
        lambda: f"<nav>{links()}</nav>", lambda: links(), lambda: f'<div class="site-header"><div>{say(12)}</div></div>', lambda: f'<div class="cookie-notice">{say(40)}</div>', lambda: f"<footer>{say(20)}</footer>",
        lambda: f'<div id="comments"><p>{say(40)}</p><p>{say(50)}</p></div>', lambda: f'<div class="box ad">{say(15)}</div>', lambda: f"<form><p>{say(30)}</p></form>", lambda: f"<script>var x = '<p>{say(30)}</p>'</script>",
        lambda: f'<div role="complementary"><p>{say(30)}</p></div>', lambda: f"<style>p {{ {say(9)} }}</style>", lambda: f"<!-- <p>{say(30)}</p> -->",
    ]
    some = lambda: "".join(rnd.choice(around)() for _ in range(rnd.randint(0, 5)))
    for _ in range(300):
        marked = rnd.random() < 0.6
        blocks = [say(rnd.randint(2, 9))] + [say(rnd.randint(1 if marked else 20, 80)) for _ in range(rnd.randint(1, 6))]
        within = [k for k in range(len(around)) if k not in (1, 2)] if marked else range(len(around))  # an article's own lists and headers stay
        inner = "".join(f"<p>{b}</p>" + (around[rnd.choice(within)]() if rnd.random() < 0.2 else "") for b in blocks[1:])
        body = f"<h1>{blocks[0]}</h1>{inner}"
        body = f"<article>{body}</article>" if marked else f'<div class="post-body">{body}</div>'
        assert main_text.main_text(f"<html><body>{some()}{body}{some()}</body></html>") == "\n".join(blocks)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p title=it's>all of this stays</p><p>and this, it's true", "all of this stays\nand this, it's true"), ('<p title="open>one</p> two', "one\ntwo"), ("<p title='a>b' class=x>c</p>", "c"),
        ('<article><div class="post-header"><h2>T</h2></div><section class="related-work"><p>w</p></section></article>', "T\nw"), ('<article><h1><a href="/">In a link</a></h1><p>x</p></article>', "In a link\nx"),
        ("<div class=comments><p>the page has nothing else</p></div>", "the page has nothing else"), ("<form><p>whole page in a form</p></form>", "whole page in a form"), ("<nav>a</nav>", ""),
        ("<article><p>one</p><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul><div><p>Thanks.</p></div></article>", "one\na\nb\nc\nThanks."), ("<article><p>one</p><p><a href=1>link</a></p><p>two</p></article>", "one\nlink\ntwo"),
        ('<article><h2 class="header">Title</h2><p class="related">Some words.</p><p class="share">Shares fell.</p><p>Body</p></article>', "Title\nSome words.\nShares fell.\nBody"), ('<article><p>one</p><div class="ad">buy</div><p>two</p><div id="comments"><p>me too</p></div></article>', "one\ntwo"),
        ("<a href=1>only</a> <a href=2>links</a>", "only links"), ("<p>a<!-->b<!-- c --!>d", "abd"), ("x < y <3", "x < y <3"), ("<p>a&nbsp;&#8364;&copy \t b</p>", "a €© b"), ("<svg><p>n</p></svg>y", "y"),
    ],
)
def test_odd_markup(page, want):
    assert main_text.main_text(page) == want


def test_distribution_decides_on_the_test_pages():
    """Adverts outside articles go by their weight: without the distribution they stay."""
    pages = [r[0] for r in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    assert sum(main_text.main_text(p) != main_text.main_text(p, threshold=-1) for p in pages) > len(pages) / 2


def test_long_pages_take_linear_time():
    for piece in ("<p>some words of text</p>", "<p><b>", "<div>", '<p title="x', "<a href='", "</p>", "<b>x", "<!--", "<![CDATA[x", "<script>", "&amp;"):
        main_text.main_text(piece * (400_000 // len(piece)))


def test_query(spark):
    got = {r.page_id: r for r in entry.op9_main_text(spark, SF).collect()}
    pages = duckdb.sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for page_id, url, page in pages:
        r = got[page_id]
        assert (r.url, r.n_chars) == (url, len(r.text)) and r.text and set(r.asDict()) == {"page_id", "url", "text", "n_chars"}
        assert "track(" not in r.text and "©" not in r.text


def test_empty_and_repeated_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    assert spark.createDataFrame([], schema).select(main_text.main_text_column("html")).count() == 0
    rows = spark.createDataFrame([(1, "u", None, "x", "y"), (1, "u", "<p>a</p>", "x", "y"), (1, "u", "<p>a</p>", "x", "y"), (None, None, "", None, None)], schema)
    assert sorted(r.t for r in rows.select(main_text.main_text_column("html").alias("t")).collect()) == ["", "", "a", "a"]
