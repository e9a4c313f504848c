"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of block elements whose leaves are runs of text. Each node has features of its subtree (density of
text and links), its attribute tokens, depth, siblings and ancestors. Boosted trees give the odds that a node holds main
text. Decoding is hierarchical: the labels of greatest total likelihood are chosen under the rule that nothing inside a
dropped node is kept, by one pass up and one down the tree.

The trees are fitted on PAGES generated pages whose main text is known (seeded, built from the layouts below), so no table
is needed to fit and the model is the same everywhere.

Output: references decoded, white space inside a block made one space, blocks joined by one line feed in page order. A line
break inside a block counts as white space. Nothing is dropped but what the labels drop: the article's own heading stays.

Nulls, ties and odd input: a null or empty html gives an empty text; unclosed and stray tags are closed or ignored as in
browsers; an unfinished tag at the end is dropped; repeated rows each get a row; an empty table gives no rows; only
page_id, url and html are read. Ties in decoding keep a node.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import bounded_batches, table

PAGES, SEED = 400, 5

# Element names and attribute tokens.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style title textarea noscript template svg iframe object select button canvas audio video datalist".split())
#: Elements whose text runs to their own closing tag or to the page's end, whatever stands in it; the other raw ones nest, and
#: one that is never closed ends before the next block.
RUN_ON = frozenset(("script", "style", "textarea", "title"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption li dd dt html body".split())
SCOPE = {"li": ("li", frozenset(("ul", "ol"))), "dt": ("dt dd", frozenset(("dl",))), "dd": ("dt dd", frozenset(("dl",))), "tr": ("tr td th", frozenset(("table",))), "td": ("td th", frozenset(("tr", "table"))), "th": ("td th", frozenset(("tr", "table")))}
BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promotion promoted popup modal overlay cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login register nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar side aside rail widget widgets related recommended recommendations share sharing social follow footer foot copyright legal colophon header masthead branding topbar toolbar search form comment comments commentlist reply replies respond disqus discussion responses outbrain taboola teaser skip hidden none contentinfo complementary dialog".split()
)
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promotion promoted teaser".split())
GOOD = frozenset("article articlebody content main post entry story body text hentry blog prose markdown maincontent".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS, key=len, reverse=True))})\b", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCT = re.compile(r"[.,;:!?]")
NAMES = ("p", "h", "li", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "quote", "text")
_NAME = {"td": "table", "th": "table", "tr": "table", "tbody": "table", "thead": "table", "table": "table", "blockquote": "quote", "pre": "quote", "ul": "li", "ol": "li", "li": "li", "dl": "li", "dd": "li", "dt": "li", "#": "text"} | {f"h{i}": "h" for i in range(1, 7)} | {n: n for n in ("p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form")}


class Page:
    """The tree of a page: parallel lists over nodes in page order; a leaf has the name '#' and a text."""

    def __init__(self, html: str):
        self.name, self.parent, self.tokens, self.text, self.linked = ["html"], [-1], [frozenset()], [""], [0]
        self._stack, self._run, self._links, self._in_link = [0], [], 0, False
        self._ends: dict[str, dict[int, int]] = {}
        self._read(html)

    def _add(self, name: str, tokens: frozenset = frozenset(), text: str = "", linked: int = 0) -> int:
        self.name.append(name)
        self.parent.append(self._stack[-1])
        self.tokens.append(tokens)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.name) - 1

    def _flush(self) -> None:
        if self._run:
            text = " ".join(unescape("".join(self._run)).split())
            if text:
                self._add("#", text=text, linked=min(self._links, len(text)))
            self._run, self._links = [], 0

    def _close(self, names: tuple[str, ...] | list[str], stop: frozenset) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            n = self.name[self._stack[i]]
            if n in names:
                del self._stack[i:]
                return
            if n in stop:
                return

    def _after_raw(self, html: str, at: int, name: str) -> int:
        """Where the raw element ends whose opening tag ends at ``at``."""
        if name in RUN_ON:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            return close.end() if close else len(html)
        if name not in self._ends:  # all elements of this name, found once
            ends, opened = self._ends.setdefault(name, {}), []
            for m in re.finditer(rf"<(/?){name}\b(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>", html, re.I):
                if not m[1]:
                    opened.append(m.end())
                elif opened:
                    ends[opened.pop()] = m.end()
        close = self._ends[name].get(at)
        if close is None:
            block = _BLOCK.search(html, at)
            close = block.start() if block else len(html)
        return close

    def _read(self, html: str) -> None:
        at, quiet = 0, ""
        for m in _TAG.finditer(html):
            if m.start() < at:
                continue
            if not quiet and m.start() > at:
                self._say(html[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name or (m[5] and not html.endswith(">", 0, m.end())):
                continue
            end, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
            if name in RAW and not end and not attributes.endswith("/"):
                at = self._after_raw(html, at, name)
            elif name == "br":
                self._run.append(" ")
            elif name == "a":
                self._in_link = not end
            elif name in BLOCKS:
                self._flush()
                self._in_link = False
                if end:
                    self._close((name,), frozenset())
                elif name not in ("html", "body") or name == "body":
                    if name in CLOSES_P:
                        self._close(("p",), BLOCKS - {"p"})
                    if name in SCOPE:
                        names, stop = SCOPE[name]
                        self._close(names.split(), stop)
                    tokens: set[str] = set()
                    if attributes:
                        for a in _ATTRIBUTE.finditer(attributes):
                            value = a[2] or a[3] or a[4] or ""
                            key = a[1].lower()
                            if key in ("class", "id", "role"):
                                tokens.update(x.lower() for x in _TOKEN.findall(value))
                            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                                tokens.add("hidden")
                    n = self._add(name, frozenset(tokens))
                    if name not in VOID:
                        self._stack.append(n)
        if at < len(html):
            self._say(html[at:])
        self._flush()

    def _say(self, text: str) -> None:
        self._run.append(text)
        if self._in_link:
            self._links += len(text.strip())

    def features(self) -> np.ndarray:
        n = len(self.name)
        parent = self.parent
        chars, links, words, leaves, punct, nodes = ([0] * n for _ in range(6))
        depth, index, siblings, bad, good, inside = ([0] * n for _ in range(6))
        own_bad, own_good = [0] * n, [0] * n
        kids = [0] * n
        for i in range(n):
            t = self.text[i]
            if self.name[i] == "#":
                chars[i], links[i], words[i], leaves[i], punct[i] = len(t), self.linked[i], t.count(" ") + 1, 1, len(_PUNCT.findall(t))
                chars[parent[i]] += chars[i]
        for i in range(n - 1, 0, -1):
            if self.name[i] != "#":
                chars[parent[i]] += chars[i]
        names = list(self.name)
        for i in range(n):
            p = parent[i]
            own_bad[i], own_good[i] = len(self.tokens[i] & BAD), len(self.tokens[i] & GOOD)
            if 2 * chars[i] > chars[0]:  # what holds most of a page is no form and no advert, and what is called one says nothing
                names[i] = "div" if names[i] == "form" else names[i]
                if self.tokens[i] & ADVERTS:
                    own_bad[i] = own_good[i] = 0
            if p >= 0:
                depth[i], index[i] = depth[p] + 1, kids[p]
                kids[p] += 1
                bad[i], good[i] = bad[p] + own_bad[i], good[p] + own_good[i]
                name = names[i]
                # nearest telling ancestor: 1 article or main, 2 navigation, footer, aside or form, 3 header outside an article
                inside[i] = 1 if name in ("article", "main") else 2 if name in ("nav", "footer", "aside", "form") else 3 if name == "header" and inside[p] != 1 else inside[p]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for c in (links, words, leaves, punct):
                c[p] += c[i]
            nodes[p] += nodes[i] + 1
        total = max(chars[0], 1)
        out = np.zeros((n, 16 + len(NAMES)))
        for i in range(n):
            p = max(parent[i], 0)
            siblings[i] = kids[p]
            row = out[i]
            row[:16] = (
                np.log1p(chars[i]), links[i] / max(chars[i], 1), chars[i] / (nodes[i] + 1), words[i] / max(leaves[i], 1), punct[i] / max(words[i], 1), chars[i] / total, depth[i], index[i], siblings[i],
                own_bad[i], own_good[i], bad[i], good[i], inside[i], chars[i] / max(chars[p], 1), links[p] / max(chars[p], 1),
            )
            k = _NAME.get(names[i])
            if k:
                row[16 + NAMES.index(k)] = 1
        return out

    def decoded(self, logits: np.ndarray) -> str:
        """Best labels with drop inherited: gain[i] is what keeping i, and the best below it, has over dropping all of it."""
        n = len(self.name)
        gain = np.clip(logits, -12, 12).tolist()
        for i in range(n - 1, 0, -1):
            if gain[i] > 0:
                gain[self.parent[i]] += gain[i]
        kept = [False] * n
        for i in range(n):
            kept[i] = gain[i] >= 0 and (i == 0 or kept[self.parent[i]])
        return "\n".join(t for i, t in enumerate(self.text) if kept[i] and self.name[i] == "#")


# --- generated pages --------------------------------------------------------------------------------------------------


def _made_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page and its main blocks; every block's text is unique."""
    serial = iter(range(10**6))
    keep: set[str] = set()

    def words(lo: int, hi: int) -> str:
        n = rng.randint(lo, hi)
        w = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(1, 9))) for _ in range(n)]
        style = rng.random()
        marks = (" |",) if style < 0.1 else (",", ".", ".", "", "", "", "") if style < 0.85 else ("$$$", "***", "%%%", "!!")
        return " ".join(x + rng.choice(marks) for x in w) + f" x{next(serial)}x"

    def good(lo: int, hi: int) -> str:
        t = " ".join(words(lo, hi).split())
        keep.add(t)
        return t

    def p(t: str) -> str:
        some, _, rest = t.partition(" ")
        return rng.choice((f"<p>{t}</p>",) * 8 + (f"<p><a href='/x'>{some}</a> {rest}</p>", f"<p>{some} <a href='/x'>{rest}</a></p>", f"<p><b>{t}<br>", f"<p>{t}", f"<p><em>{t}</em></p>"))

    def a(lo: int = 1, hi: int = 3) -> str:
        return f'<a href="/{rng.random()}">{words(lo, hi)}</a>'

    def ul(n: int) -> str:
        return "<ul>" + "".join(f"<li>{a()}</li>" for _ in range(n)) + "</ul>"

    def klass(*names: str) -> str:
        return f'{rng.choice(("class", "class", "id"))}="{rng.choice(names)}"'

    def lines(n: int, hi: int) -> str:
        return "".join(f"<p>{words(1, hi)}</p>" for _ in range(n)) if rng.random() < 0.6 else words(1, hi * 2)

    def menu() -> str:
        inner = ul(rng.randint(1, 9))
        return rng.choice((f"<nav>{inner}</nav>", f"<nav>{inner}</nav>", f"<div {klass('menu', 'main-nav', 'navbar', 'topMenu')}>{inner}</div>", f"<header>{inner}</header>", f"<div {klass('breadcrumbs')}>{a()} {a()}</div>"))

    def head() -> str:
        inner = f"<h1>{words(1, 4)}</h1>" if rng.random() < 0.4 else f"<p>{words(1, 9)}</p>"
        return rng.choice((f"<header>{inner}{menu() if rng.random() < 0.5 else ''}</header>", f"<div {klass('header', 'site-header', 'masthead')}>{inner}</div>"))

    def advert() -> str:
        inner = lines(rng.randint(1, 3), 40)
        return f"<div {klass('ad', 'ads', 'advert', 'ad-slot', 'banner', 'sponsored', 'promo-box')}>{inner}</div>" if rng.random() < 0.85 else f"<aside>{inner}</aside>"

    def notice() -> str:
        inner = lines(rng.randint(1, 2), 30)
        return f"<div {klass('cookie-notice', 'cookie-consent', 'notice', 'alert', 'newsletter', 'subscribe', 'popup', 'gdpr')}>{inner}</div>"

    def side() -> str:
        inner = f"<h3>{words(1, 3)}</h3>" + rng.choice((ul(rng.randint(2, 8)), lines(rng.randint(1, 4), 30)))
        return rng.choice((f"<aside>{inner}</aside>", f"<div {klass('sidebar', 'side-bar', 'related', 'widget', 'rail', 'recommended')}>{inner}</div>", f"<aside class='sidebar'>{inner}</aside>"))

    def form() -> str:
        return f"<form><p>{words(1, 8)}</p><label>{words(1, 3)}</label><input name=q></form>"

    def comments() -> str:
        one = lambda: f"<li><p>{words(1, 3)}</p><p>{words(2, 40)}</p></li>"
        many = "".join(one() for _ in range(rng.randint(1, 6)))
        return rng.choice((f"<section {klass('comments', 'discussion')}><h3>{words(1, 3)}</h3><ol>{many}</ol></section>", f"<div {klass('comments', 'comment-list', 'disqus', 'responses')}>" + "".join(f"<div class='comment'><p>{words(2, 40)}</p></div>" for _ in range(rng.randint(1, 5))) + "</div>"))

    def foot() -> str:
        inner = rng.choice((f"&copy; {words(1, 20)}", f"<p>&copy; {words(1, 12)}</p>{ul(3)}", words(1, 25)))
        return rng.choice((f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div {klass('footer', 'site-footer', 'copyright')}>{inner}</div>"))

    body = []
    if rng.random() < 0.9:
        body.append(rng.choice(("<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>")).format(good(1, 12)))
    longest = rng.choice((3, 30, 120, 400))
    for _ in range(rng.choice((1, 1, 2, 5, 12, 30))):
        kind = rng.random()
        if kind < 0.8:
            body.append(p(good(rng.choice((1, 1, 5)), longest + 4)))
        elif kind < 0.86:
            body.append(f"<h2>{good(1, 6)}</h2>")
        elif kind < 0.91:
            body.append("<ul>" + "".join(f"<li>{good(1, 20)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
        elif kind < 0.94:
            body.append(f"<blockquote><p>{good(3, 40)}</p></blockquote>")
        elif kind < 0.96:
            body.append("<table>" + "".join(f"<tr><td>{good(1, 4)}</td><td>{good(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
        elif kind < 0.98:
            body.append(f"<figure><img src=x><figcaption>{good(2, 12)}</figcaption></figure>")
        else:
            body.append(rng.choice((advert, notice, side))())
    if rng.random() < 0.1:
        body.append(comments())
    shell = rng.choice(("<article>{}</article>",) * 4 + ("<main><article>{}</article></main>", "<main>{}</main>", "<div id='content'>{}</div>", "<div class='post-content'>{}</div>", "<div class='entry'><div class='article-body'>{}</div></div>", "<section class='story'>{}</section>", "<div class='container'><article>{}</article></div>"))
    before = [f() for f in (menu, head, notice, advert, side, form) if rng.random() < 0.45]
    after = [f() for f in (comments, side, advert, notice, form) if rng.random() < 0.3] + ([foot()] if rng.random() < 0.9 else [])
    rng.shuffle(before)
    page = "".join(before) + shell.replace("{}", "".join(body)) + "".join(after)
    if rng.random() < 0.3:
        page = f"<div {klass('wrapper', 'page', 'site')}>{page}</div>"
    return f"<html><head><title>t</title></head><body>{page}</body></html>", keep


@lru_cache(2)
def model(pages: int = PAGES, seed: int = SEED) -> BoostedTrees:
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        html, keep = _made_page(rng)
        page = Page(html)
        y = [t in keep for t in page.text]
        for i in range(len(y) - 1, 0, -1):
            y[page.parent[i]] |= y[i]
        xs.append(page.features())
        ys.append(y)
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_text(htmls: list[str], trees: BoostedTrees) -> list[str]:
    pages = [Page(h) for h in htmls]
    feats = [p.features() for p in pages]
    logits = trees.logits(np.concatenate(feats)) if pages else np.empty(0)
    ends = np.cumsum([len(f) for f in feats])
    return [p.decoded(logits[e - len(f) : e]) for p, f, e in zip(pages, feats, ends.tolist(), strict=True)]


def extract(pages: DataFrame, trees: BoostedTrees | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    trees = model() if trees is None else trees  # a few kB, whatever the data
    kind = pages.schema["page_id"].dataType.simpleString()
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 200):
                b = whole.slice(lo, 200)
                text = main_text(b.column("html").to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op4_html_text": op4_html_text}
ORACLE_SQL: dict[str, str] = {}
