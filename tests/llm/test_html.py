"""Main text: the article of the test pages, tree decoding, odd pages."""

import html as H
import re
from itertools import product

import duckdb
import numpy as np

from corpusloom.llm.boosting import BoostedTrees
from corpusloom.llm.htmltext import Page, extract, main_text, model

from .fixtures import SF, frame, with_clashes

PAGES = "page_id long, url string, html string"


def article(html):
    """The test pages hold their main text in one article element."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    inner = re.sub(r"<(aside|div|nav|section|form|ul|footer|header)\b.*?</\1>", "\n", inner, flags=re.S)
    blocks = re.split(r"</?(?:p|h1|h2|h3|li|ul|ol|blockquote|table|tr|td)\b[^>]*>", re.sub(r"<br\s*/?>", " ", inner))
    texts = (" ".join(H.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_article_of_each_page(spark):
    rows = [r for r in duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet' ORDER BY page_id").fetchall()]
    got = {r.page_id: r for r in extract(frame(spark, rows, PAGES)).collect()}
    assert len(got) == len(rows)
    right = sum(got[i].text == article(h) for i, _, h in rows)
    assert right / len(rows) >= 0.98, right
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_decoding_is_the_best_labelling_without_kept_nodes_in_dropped_ones():
    page = Page("<div><p>a</p><div><p>b</p>c</div></div><nav>d</nav>")
    n, rng = len(page.name), np.random.default_rng(0)
    for _ in range(50):
        logits = rng.normal(0, 3, n)
        best = max((sum(x for x, k in zip(logits, kept, strict=True) if k), kept) for kept in product((False, True), repeat=n) if all(not k or i == 0 or kept[page.parent[i]] for i, k in enumerate(kept)))
        want = "\n".join(t for i, t in enumerate(page.text) if best[1][i] and page.name[i] == "#")
        assert page.decoded(logits) == want


def test_odd_pages(spark):
    long = "<article>" + "".join(f"<p>Sentence number {i}, with some more words in it.</p>" for i in range(20_000)) + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<"), (4, "u", "plain"), (5, "u", "<p>a</div></p><<p <b"), (6, "u", long), (None, "u", "<!-- x"), (6, "u", long), (7, "u", "<script>" + "x" * 100_000), (8, "u", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    out = extract(with_clashes(frame(spark, rows, PAGES), "text n_chars")).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r.text for r in out}
    assert got[1] == got[2] == got[None] == got[7] == ""
    assert got[6].count("\n") == 19_999
    assert extract(frame(spark, [], PAGES, 1)).count() == 0


def test_references_breaks_and_white_space():
    page = "<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>one&nbsp;two<br>three \n\t four &lt;five&gt; &#233;&#x1F600; with some words, to fill it.</p></article><footer>&copy; x</footer></body></html>"
    assert main_text([page], model())[0] == "A & B\none two three four <five> é😀 with some words, to fill it."


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    fitted = BoostedTrees().fit(x[:3000], y[:3000])
    assert ((fitted.logits(x[3000:]) > 0) == y[3000:]).mean() > 0.95


BODY = " ".join(f"word{i} of the story, told at some length." for i in range(12))


def one(html):
    return main_text([html], model())[0]


def test_raw_elements_that_are_never_closed_end_before_the_next_block():
    for opened in ("<button>Go", "<object data=x>", "<svg><path d='M0'>", "<select><option>a", "<iframe src=x>", "<video src=y>", "<template>", "<canvas>", "<audio>"):
        assert one(f"<article><p>{BODY}</p>{opened}<p>Second paragraph, {BODY}</p></article>") == f"{BODY}\nSecond paragraph, {BODY}", opened
    assert one(f"<article><p>{BODY}</p></article><script>var a = '<p>no</p>'") == BODY
    assert one(f"<article><p>{BODY}</p></article><style>p {{}}<p>no</p>") == BODY


def test_raw_elements_nest():
    assert one(f"<article><p>{BODY}</p><object><object></object>tail</object><p>{BODY} end.</p></article>") == f"{BODY}\n{BODY} end."
    assert one(f"<article><p>{BODY}</p><button title='a>b'>x<button>y</button>z</button><p>{BODY} end.</p></article>") == f"{BODY}\n{BODY} end."
    assert one(f"<article><p>{BODY}</p>" + "<button>" * 20_000 + f"<p>{BODY} end.</p></article>") == f"{BODY}\n{BODY} end."


def test_a_form_or_an_odd_class_round_the_whole_page():
    page = f"<header><ul><li><a href=x>Home</a></li></ul></header><article><h1>Title of it</h1><p>{BODY}</p><p>{BODY} end.</p></article><footer>&copy; x</footer>"
    want = f"Title of it\n{BODY}\n{BODY} end."
    assert one(f"<body><form action=x>{page}<input type=hidden></form></body>") == want
    assert one(f"<body><div class='promo-story main-ad-free'>{page}</div></body>") == want
    assert BODY not in one(f"<body>{page}<form><p>{BODY}</p></form></body>").removeprefix(want)
