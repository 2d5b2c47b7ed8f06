import html
import itertools
import re

import numpy as np

from stratabranch.llm import html_mincut as H
from stratabranch.llm import queries

PAGE = """<html><head><title>t</title><style>p{x}</style><script>var a="</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><div id="top-menu"><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div>
<div class="cookie-notice">We use cookies, please accept.</div><%s><h1>A title</h1><p>The first paragraph of the story, with commas, and a fair number of words in it.
<p>The second &amp; last&#32;one, with <b>bold</b>words and<br>a break, telling things at length.</p><div class="ad">Buy this now!</div>
<!-- <p>not this</p> --><p style="display: none">hidden</p><form><label>Name</label><input value=x><textarea>typed</textarea></form><div class="reader-comments"><p>I liked it, says a reader, at some length and with care.</p></div></%s>
<aside><p>Related stories</p></aside><footer>&copy; somebody</footer></body></html>"""
TEXT = "A title The first paragraph of the story, with commas, and a fair number of words in it. The second & last one, with boldwords and a break, telling things at length."


def test_furniture_goes():
    assert H.main_text(PAGE % ("article", "article")) == TEXT
    assert H.main_text(PAGE % ("main", "main")) == TEXT


def test_nothing_and_broken_pages():
    for page in ("", "   ", "<", "<p", "<script>x", "<nav>only menu</nav>", "<!-- open", "</div></p>"):
        assert H.main_text(page) in ("", "<", "<p")
    assert H.main_text("<article>" + "<div>" * 3000 + "deep" + "</article>") == "deep"
    assert H.main_text("<article>a&nbsp;b\n\t c&eacute;</article>") == "a b cé"


def test_names_of_wrappers_lose_no_article():
    text = "The first paragraph, with a fair number of words in it. The second one, telling more at length."
    body = "<p>The first paragraph, with a fair number of words in it.<p>The second one, telling more at length."
    article = f"<nav>Home</nav><article>{body}</article><div class='sidebar-inner'>Popular</div>"
    for page in (
        f'<body class="has-sidebar">{article}</body>',
        f'<html id="header-top"><body class="no-sidebar menu">{article}</body></html>',
        f'<body><article class="post has-comments widget">{body}</article><div class="comments">Nice.</div></body>',
        f'<body><main class="content sidebar-right">{body}</main><aside>More</aside></body>',
        f'<body><div role="main" class="sidebar">{body}</div></body>',
        f'<body><div id="page" class="nav-closed">{article}</div></body>',
        f'<body><div id="nav"><div class="sidebar">{article}</div></div></body>',
        f'<body><form action="/"><div class="content">{body}</div><footer>us</footer></form></body>',
        f'<body><form>{article}</form></body>',
        f'<body><div class="content"><h2>T</h2></div><div class="sidebar-right"><div class="text">{body}</div></div></body>',
    ):
        got = H.main_text(page)
        assert got.removeprefix("T ") == text, page
    # Articles in a list of comments or of related stories are no main text, however long they are.
    for box in ("comments-area", "related-posts", "site-footer", "cookie-notice"):
        page = f'<main><article>{body}</article><div class="{box}"><ol><li><article>' + "I liked it, says a reader. " * 9 + "</article></ol></div></main>"
        assert H.main_text(page) == text, box


def test_skipped_parts_end_where_html_ends_them():
    for page in (
        "<html><head><meta charset=utf-8><title>t</title><body><article>It isn't lost.</article>",
        "<head><link rel=x><article>It isn't lost.</article>",
        "<head><script>for (i = 0; i<n; i++) {} // don't</script></head><body><article>It isn't lost.</article></body>",
        "<article><div hidden><script>i<n // don't</script><style>a>b{}</style></div>It isn't lost.</article>",
        "<article><svg><script href=x /><svg/><title>t</title></svg>It isn't lost.</article>",
        "<article><p hidden>no<p>It isn't<p>lost.</article>",
        "<article><p hidden>no<div>It isn't lost.</div></article>",
        "<article><div><p style='display:none'>no</div>It isn't lost.</article>",
        "<article><ul><li hidden>no<ul><li>nor this</ul><li>It isn't<li>lost.</ul></article>",
        "<article><ul><li hidden>no</ul>It isn't lost.</article>",
        "<article><ul><li><p hidden>no</li>It isn't<li>lost.</ul></article>",
        "<article><dl><dt hidden>no<dd>It isn't<dd>lost.</dl></article>",
        "<article><table><tr><td hidden>no<td>It isn't<tr hidden><td>no<tr><td>lost.</table></article>",
        "<article><div hidden>no<div>nor</div><p>this</div>It isn't lost.</article>",
        "<article><section><div hidden>no</section>It isn't lost.</article>",
        "<article><template><p>no</div></article></template>It isn't lost.</article>",
        '<article title="hidden gems"><p title="a hidden one">It isn\'t</p><div data-hidden="false" data-style="display:none" alt=hidden>lost.</div></article>',
        '<article><div class="a" hidden>no</div><p aria-hidden=true>no</p><p HIDDEN>no</p>It isn\'t lost.</article>',
    ):
        assert H.main_text(page) == "It isn't lost.", page


def test_cut_is_minimal():
    r = np.random.default_rng(4)
    for _ in range(60):
        n = int(r.integers(1, 8))
        s, t = n, n + 1
        edges = [(s, k, float(r.random()), 0.0) for k in range(n)] + [(k, t, float(r.random()), 0.0) for k in range(n)]
        edges += [(int(a), int(b), w := float(r.random()), w) for a, b in r.integers(0, n, (6, 2)) if a != b]
        side = H.max_flow(n + 2, edges, s, t)

        def cost(x):
            return sum((f if x[u] and not x[v] else 0) + (b if x[v] and not x[u] else 0) for u, v, f, b in edges)

        best = min(cost([*x, True, False]) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(side) - best) < 1e-7


def test_pages_match_a_plain_reading(spark, sf_dir):
    def plain(page):
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        return " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", body))).split())

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = queries.op5_html(spark, sf_dir).collect()
    assert len(got) == len(want)
    assert all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)


def kept(page, smooth=True):
    """Texts of the blocks that are kept, and the blocks' own odds."""
    p = H.Page(page)
    odds = H.odds_of(p, H.made_weights())
    side = H.label(odds, H.smoothness(p) if smooth else [])
    return [b.text for b, k in zip(p.blocks, side) if k], dict(zip((b.text for b in p.blocks), odds.tolist()))


LONG = "A paragraph of the story, with commas, and with a fair number of words in it, telling more. It goes on for a while, and then it ends."


def test_parts_of_an_article_that_are_not_text():
    for page in (
        "<article><p>It isn't<p class='ad'>Buy!<p class=notice>Read this!</p>lost.</article>",
        "<article>It isn't <span style='display: none'>no</span><span hidden>no <b>nor</b> this</span>lost.</article>",
        "<article>It isn't <span hidden>no<span>nor</span> this</span> lost.</article>",
        "<article><p>It isn't <span hidden>no<p>lost.</article>",
        "<article><form><select><option>a<option>b</form>It isn't lost.</article>",
        "<article>It isn't <select><option>a<option>b<p>lost.</article>",
        "<article><div>It isn't<button>go</button></div><p>lost.</article>",
        "<article><p>It isn't</p></div></section><p>lost.</article>",
        "<article><table><tr><td>It isn't</div></article><td>lost.</table></article>",
        "<article><svg><text>no<p>It isn't lost.</article>",
        "<article><p title='>'>It isn't</p><p title=>lost.</article>",
        '<article><p title="an open quote>It isn\'t lost.</article>',
        "<article><!--> <p>It isn't</p> <!-- no --><?php no ?></>lost.</article>",
        "<article>It isn't lost.</article><a href='the page ends here",
    ):
        assert H.main_text(page) == "It isn't lost.", page
    assert H.main_text(f"<article><header><h1>Title</h1></header><p>{LONG}</article><header><h1>Site</h1></header>") == f"Title {LONG}"
    assert H.main_text("<article>1 < 2 and <3 & a<b></b></article>") == "1 < 2 and <3 & a"
    comments = "".join(f"<article><p>I think that {LONG}</p></article>" for _ in range(5))
    assert H.main_text(f"<article><p>{LONG} {LONG}<p>{LONG}<section><h2>Replies</h2>{comments}</section></article>") == f"{LONG} {LONG} {LONG}"


def test_reading_is_linear():
    import time

    for piece in ("<a ", "<a b=\"", "<a b='\"", "<div>x", "<span hidden>x", "</div>", "<p>a", "<p><button><div>", "</script", "<li><ul>", "<table><td>x", "<b hidden>", "&amp", "<!-", "<![CDATA["):
        began = time.process_time()
        H.Page(piece * (1_000_000 // len(piece)))
        assert time.process_time() - began < 8, piece


def test_cut_overturns_odds_and_names():
    # A word alone has the look of a menu; between paragraphs of its container it is text.
    short = f"<div><p>{LONG}</p><div>Yes</div><p>{LONG} {LONG}</p></div><div><a href=/>Home</a> <a href=/x>About</a></div>"
    assert kept(short)[0] == [LONG, "Yes", f"{LONG} {LONG}"]
    page = f"<article><p>{LONG}</p>" + f"<p>{LONG}</p>" * 3 + "</article>"
    assert len(kept(page)[0]) == 4
    # Odds that are weakly against are overturned by neighbours, and the same odds alone are not.
    edges = [(0, 1, 2.0), (1, 2, 2.0)]
    assert H.label(np.array([5.0, -1.5, 5.0]), edges) == [True] * 3
    assert H.label(np.array([5.0, -1.5, 5.0]), []) == [True, False, True]
    assert H.label(np.array([-3.0, 1.0, -3.0]), edges) == [False] * 3
    found = flipped = 0
    r = np.random.default_rng(9)
    for _ in range(60):
        p, content = H.made_blocks(H.made_page(r, elements=False, names=False))
        odds, edges = H.odds_of(p, H.made_weights()), H.smoothness(p)
        cut = np.array(H.label(odds, edges))
        flipped += int((cut != (odds > 0)).sum())
        found += int((cut == (content > 0)).sum()) - int(((odds > 0) == (content > 0)).sum())
    assert flipped > 10 and found > 0  # the cut decides against odds, and more often right than not


def test_label_is_the_least_cost():
    """Settling blocks before the flow leaves the minimum cut as it is."""
    r = np.random.default_rng(6)
    for _ in range(300):
        n = int(r.integers(1, 9))
        odds = r.normal(0, 2, n)
        edges = [(int(a), int(b), float(r.random() * 2)) for a, b in r.integers(0, n, (7, 2)) if a != b]

        def cost(x):
            return sum(np.logaddexp(0, -o if k else o) for o, k in zip(odds, x)) + sum(w for u, v, w in edges if x[u] != x[v])

        assert cost(H.label(odds, edges)) <= min(map(cost, itertools.product([False, True], repeat=n))) + 1e-7


def test_made_pages_held_out():
    """Blocks told right on pages that weren't learned from: with names or without, with elements or without."""
    for elements, names, least in ((True, True, 0.99), (True, False, 0.99), (False, True, 0.99), (False, False, 0.93)):
        r, right, blocks = np.random.default_rng(123), 0, 0
        for _ in range(150):
            p, content = H.made_blocks(H.made_page(r, elements, names))
            cut = H.label(H.odds_of(p, H.made_weights()), H.smoothness(p))
            right, blocks = right + int((np.array(cut) == (content > 0)).sum()), blocks + len(content)
        assert right / blocks > least, (elements, names, right / blocks)


def test_pages_without_names_or_elements(spark, sf_dir):
    """The given pages, their class names taken off, and their elements too."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    want = [H.main_text(r.html) for r in pages]
    bare = [re.sub(r' class="[^"]*"', "", r.html) for r in pages]
    assert [H.main_text(x) for x in bare] == want
    plain = [H.main_text(re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", x)) for x in bare]
    assert sum(a == b for a, b in zip(plain, want)) > 0.9 * len(want)


def test_edges(spark):
    rows = [(1, "u", None), (None, None, "<article>x</article>"), (2, "u", "<article>" + "<p>word</p>" * 5000 + "</article>"), (2, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS h", "2 AS text")
    got = H.extract(pages).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 1, 5 * 5000 - 1]
    assert H.extract(pages.limit(0)).count() == 0


def test_pages_with_one_kind_of_evidence_or_none(spark):
    text = "A plain paragraph, which tells something at length. Another one follows it, and it is as long as that."
    plain = text.replace(". ", ".<p>")
    links = "<ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/a>About us</a></ul>"
    bare = [f"<p>{plain}", f"<div>{links}</div><div><p>{plain}</div>", f"<html><body><div><div><p>{plain}</div></div></body></html>", text]
    for more in ("", "<nav><a href=/>Menu</a></nav>"):
        pages = spark.createDataFrame([(k, "u", more + x) for k, x in enumerate(bare)], "page_id long, url string, html string")
        assert [r.text for r in H.extract(pages).collect()] == [text] * len(bare), more
    pages = spark.createDataFrame([(k, "u", x) for k, x in enumerate([*bare, f"<article>{text}</article>"])], "page_id long, url string, html string")
    assert [r.text for r in H.extract(pages).collect()] == [text] * (len(bare) + 1)
