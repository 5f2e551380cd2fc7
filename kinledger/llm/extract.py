"""HTML main text by the maximum-scoring subsequence of a page's tokens.

A page is a sequence of words and tags. Words score positive, less in links, and negative
in what is marked as chrome; tags score negative. The weights are log-odds of a kind
of token inside and outside the article, counted on labelled pages; where a page has an
``article`` or ``main`` of its own, so are those of standing in it and beside it. One linear
scan finds the contiguous run with the greatest sum, whose bounds stay as they are. Elements
that hold less than half the sum of a run found without them (teasers) count for nothing.
What is marked as chrome inside the run (menus, asides, forms, adverts, comments) is left out.

Text keeps page order: character references decoded, white space inside a block turned into
one space and trimmed, blocks joined by one space. Null and empty pages give the empty text,
as do pages without a word outside chrome. Very long pages are read whole, in time that grows with their
length however their tags nest. Rows that repeat a page have the same text; a null page_id or url stays
null, and other columns are left out.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter, defaultdict
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template|noscript|iframe|textarea|title|svg|math)\b(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>|<[!?/][^<>]*>?|<[a-zA-Z][^<>]*>?|[^<]+|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|style|aria-hidden|hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are chrome, and words of a class, id or role that say so.
_CHROME_TAGS = frozenset("head nav footer aside form button select dialog menu object".split())
_CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie "
    "cookies dialog disqus discussion footer form gdpr hidden login menu modal nav navbar navigation newsletter notice notices notification overlay pagination "
    "popup promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tags toolbar widget widgets".split()
)
#: Words beside them in a name: ``ad-slot`` is chrome, ``with-sidebar`` isn't.
_BOX_WORDS = frozenset("area bar block bottom box button buttons container inner item items left link links list main outer post posts primary right row secondary section site slot stories top unit wrap wrapper".split())
#: Chrome only outside an article: an article's own header holds its title.
_PAGE_HEADER = frozenset("header masthead topbar".split())
_HOMES = frozenset("article main".split())
_ENDS_P = frozenset("p div ul ol li h1 h2 h3 h4 h5 h6 table section article main aside nav header footer form blockquote pre hr dl".split())


def _says(value: str, words: frozenset) -> bool:
    """Does a whole name in a class, id or role consist of ``words``, and words for boxes."""
    return any(parts & words and parts <= words | _BOX_WORDS for parts in (frozenset(_WORD.findall(x)) for x in value.split()))


def _marks(name: str, attributes: str) -> tuple[bool, bool, bool, str | None]:
    """Is the element chrome with all below it, is it by its names, is it a page header, which home of an article is it."""
    chrome, named, header, home = name in _CHROME_TAGS, False, name in _PAGE_HEADER, name if name in _HOMES else None
    if attributes and name not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role"):
                named |= _says(value, _CHROME_WORDS) and home is None or _says(value, frozenset({"comment", "comments"}))
                header |= _says(value, _PAGE_HEADER)
                home = "main" if key == "role" and value == "main" and home is None else home
            elif key == "itemprop":
                home = "article" if value == "articlebody" and home is None else home
            elif key == "style":
                chrome |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
            elif key == "hidden" or value == "true":
                chrome = True
    return chrome, named, header, home


def tokens(page: str) -> tuple[list[tuple[str, int, str, bool]], list[tuple[str, int, int]]]:
    """(kind, words, text, new block) of each tag and text, and (home, first, last) of each article or
    main outside chrome. Kinds are a tag's name, or word, link, chrome for text."""
    out: list[tuple[str, int, str, bool]] = []
    homes: list[tuple[str, int, int]] = []
    open_: list[tuple[str, bool, str | None, int, bool]] = []  # name, chrome, home, place, chrome with the homes below
    at: dict[str, list[int]] = defaultdict(list)  # where each name stands in open_; "" homes, "#" what isn't inline
    fresh = True

    def shut(i: int) -> None:
        while len(open_) > i:
            name, chrome, home, place, _ = open_.pop()
            for key in (name, *[""] * bool(home), *["#"] * (name not in _INLINE)):
                at[key].pop()
            if home and not chrome:
                homes.append((home, place, len(out)))

    for m in _TOKEN.finditer(page):
        name = m["name"]
        if name is None:
            text = m[0]
            if text[0] == "<" and len(text) > 1 or not text:
                fresh |= m["raw"] is not None and m["raw"].lower() != "svg"
                continue
            text = _html.unescape(text)
            n = len(text.split())
            if n or not fresh:
                out.append(("chrome" if open_ and open_[-1][1] else "link" if at["a"] else "word", n, text, fresh))
                fresh = False
            continue
        name = name.lower()
        fresh |= name not in _INLINE
        out.append((name, 0, "", False))
        if m["close"]:
            # a stray end tag doesn't close an article
            if at[name] and (name in _HOMES or name in ("body", "html") or not at[""] or at[name][-1] >= at[""][-1]):
                shut(at[name][-1])
            continue
        if name in _ENDS_P and at["p"] and at["p"][-1] == at["#"][-1]:
            shut(at["p"][-1])
        if name in _VOID or m["attributes"].endswith("/"):
            continue
        chrome, named, header, home = _marks(name, m["attributes"])
        above = open_[-1] if open_ else ("", False, None, 0, False)
        below = above[4] or chrome or bool(home) and named
        for key in (name, *[""] * bool(home), *["#"] * (name not in _INLINE)):
            at[key].append(len(open_))
        in_home = len(at[""]) > bool(home)
        open_.append((name, below or named or above[1] and not home or header and not in_home, home, len(out), below))
    shut(0)
    return out, homes


#: Labelled pages: the article stands between the two marks. Layouts differ, words don't matter.
LABELLED = (
    '<html><head><title>t</title></head><body><header><a href="/">site name</a></header><nav><ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul></nav>\x02<article><h1>a title of words</h1><p>first paragraph of the text with a number of words in it and <a>one link</a> to follow.</p><p>second paragraph of the text, which goes on for a while and ends here.</p><p>short.</p></article>\x03<footer>all rights <a>legal</a></footer></body></html>',
    '<body><div id="menu"><a>home</a> <a>news</a> <a>sport</a></div><div class="content">\x02<h2>heading words here</h2><p>some text that goes on <b>for long</b> enough to be read as a paragraph.</p><ul><li>an item of a list with words</li><li>another item of the list</li></ul><p>the last paragraph of it, again with words.</p>\x03</div><div class="sidebar"><ul><li><a>related one</a></li><li><a>related two</a></li></ul></div><div>contact us <a>here</a></div></body>',
    '<body><table><tr><td><a>a</a><br><a>b</a><br><a>c</a></td><td>\x02<p>text in a table cell, as old pages have it, with several sentences. here is one more of them.<p>and another paragraph without an end tag that is long enough.\x03</td></tr></table><form><label>search</label><input><button>go</button></form><div><a>terms</a> <a>privacy</a></div></body>',
    '<body><div class="cookie">we use cookies <button>ok</button></div><main>\x02<h1>title</h1><p>opening words of a longer article that has an advert in its middle and goes on after it.</p>\x03<div class="ad">buy this now</div>\x02<p>closing words of the longer article, which ends with this very sentence.</p>\x03</main><section class="comments"><div><p>nice article</p><a>reply</a></div><div><p>me too</p><a>reply</a></div></section></body>',
    '<body><ul><li><a>one</a></li><li><a>two</a></li></ul><div><div><span>posted</span></div>\x02<div>plain text in a division with no paragraph, still many words long in all.</div><div>more of the plain text, also in a division of its own kind.</div>\x03</div><div><a>previous</a> <a>next</a></div><div><ul><li><a>tag</a></li><li><a>tag</a></li></ul></div></body>',
    '<body><div><div><b>the daily paper</b></div><div>today is a fine day. <a>subscribe</a> now and save.</div></div><div>\x02<h2>heading of the text</h2><p>a paragraph of the text that is rather long and has its full share of words.</p><p>a second one that follows it, with words enough to be read.</p>\x03</div><div><div><a>another story</a><br>what it says in a few words</div><div><a>one more story</a><br>what that one says in a few words</div><div><a>a third story</a><br>and a few words again</div></div><div>our address is a street in a town. call us or write to us. <a>map</a></div><div>made by a company of that name. all rights reserved by them. <a>imprint</a></div></body>',
    '<body><div><span>you are here:</span> <a>home</a> <a>section</a></div><div>get our letter every week. <input><button>send</button></div><div>\x02<p>the text begins with a paragraph of many words, as most texts do.</p><h3>part two</h3><p>it goes on in a second part after a small heading.</p><blockquote>words that somebody said and that are cited here.</blockquote>\x03</div><div><div>about the writer: somebody who writes for us about many things.</div><div>read also: <a>a story</a> <a>a story</a> <a>a story</a></div></div><div>this site does not answer for other sites. prices may change.</div></body>',
)


_TEXT = ("word", "link", "chrome")


def places(seen, homes) -> list[str]:
    """Where each token stands: in or out of the page's articles (its mains, if no article has words), "" if it has none."""
    worded = [0, *accumulate(kind in ("word", "link") and n > 0 for kind, n, _, _ in seen)]
    for home in ("article", "main"):
        mine = sorted((a, b) for h, a, b in homes if h == home and worded[b] > worded[a])
        if mine:
            where, done = ["out"] * len(seen), 0
            for a, b in mine:  # one inside another is marked once
                a = max(a, done)
                where[a:b] = ["in"] * (b - a)
                done = max(done, b)
            return where
    return [""] * len(seen)


def _odds(inside: Counter, outside: Counter) -> dict[str, float]:
    n_in, n_out = sum(inside.values()), sum(outside.values())
    return {k: math.log((inside[k] + 0.5) / (n_in + 1)) - math.log((outside[k] + 0.5) / (n_out + 1)) for k in {*inside, *outside}}


@cache
def weights() -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds of each kind of token, and of its place, inside and outside the articles of the labelled
    pages; a word's kind is at least a tenth above 0 and a tag's at least a tenth below."""
    kinds, stands = (Counter(), Counter()), (Counter(), Counter())
    for page in LABELLED:
        within = 0
        seen, homes = tokens(re.sub("([\x02\x03])", r"<!---->\1<!---->", page))
        for (kind, n, text, _), where in zip(seen, places(seen, homes)):
            if text in ("\x02", "\x03"):
                within = int(text == "\x02")
                continue
            kinds[1 - within][kind] += n or kind not in _TEXT
            if where and kind in _TEXT:
                stands[1 - within][where] += n
    odds = _odds(*kinds)
    words = {"word": max(odds["word"], 0.1), "link": max(odds["link"], 0.1), "chrome": -1.0}
    return {k: min(v, -0.1) for k, v in odds.items()} | words, {"": 0.0} | _odds(*stands)


#: A tag that no labelled page has.
UNSEEN = -0.5


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous run with the greatest sum above 0; the first of equals; else (0, 0)."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += x
        if run > best:
            best, found = run, (start, i + 1)
    return found


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    seen, homes = tokens(page)
    w, stands = weights()
    size = [max(n, kind not in _TEXT) for kind, n, _, _ in seen]
    plain = [w.get(kind, UNSEEN) * n for (kind, _, _, _), n in zip(seen, size)]
    spans = [best_run(plain)]
    where = places(seen, homes)
    if seen and where[0]:
        placed = [x if kind == "chrome" else (x + stands[at] * n if kind in _TEXT else min(x + stands[at], -0.1)) for (kind, _, _, _), x, n, at in zip(seen, plain, size, where)]
        a, b = best_run(placed)
        if 2 * sum(max(x, 0.0) for x in plain[a:b]) >= sum(max(x, 0.0) for x in plain[slice(*spans[0])]):
            spans = [(a, b)]
    blocks: list[list[str]] = []
    fresh, done = True, 0
    for a, b in sorted(spans):
        for kind, _, text, new in seen[max(a, done) : b]:
            if not text:
                continue
            fresh |= new
            if kind == "chrome":
                fresh |= new
                continue
            if fresh or not blocks:
                blocks.append([])
                fresh = False
            blocks[-1].append(text)
        done, fresh = max(done, b), True
    return " ".join(x for x in (" ".join("".join(parts).split()) for parts in blocks) if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page (page_id, url, html)."""

    def texts(batches):
        for batch in batches:
            found = [main_text(page.as_py()) for page in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(texts, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
