import pytest

from kithgraph.llm.html import extract, main_text, regions, smoothed

FRAME = "<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{}</body></html>"
P = "<p>Some longer paragraph of the article, number {0}, with words &amp; signs.</p>"
LONG = "".join(P.format(k) for k in range(5))
WANT = "\n".join(f"Some longer paragraph of the article, number {k}, with words & signs." for k in range(5))
NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"


@pytest.mark.parametrize(
    "body,want",
    [
        (NAV + "<div class='ad'>Buy things now, they are cheap and good.</div><article>" + LONG + "</article><footer>&copy; me</footer>", WANT),
        ("<header>Site name</header>" + NAV + "<main>" + LONG + "</main><aside>Other texts that are here to be read by all of you</aside>", WANT),
        ("<div id='menu'><a href=x>a</a> <a href=y>b</a></div><div class='content'>" + LONG + "</div><div class='comments'><p>" + "I think so too. " * 20 + "</p></div>", WANT),
        ("<article>" + LONG + "<section class='comments'><h3>Comments</h3><p>First!</p></section><form><input><label>Name</label></form></article>", WANT),
        ("<article><h1>Head</h1><p><b>Bold start.<br><p>Les.</p><p>A  b\n c&nbsp;d</p></article>", "Head\nBold start.\nLes.\nA b c d"),
        ("<div class='cookie-notice'>We use cookies.</div><article><p>x</p></article>", "x"),
        ("<nav><a href=x>open</a><article>" + LONG + "</article>", WANT),
        ("", ""),
        ("<p>a &lt;b&gt; &eacute; &#233; &#x1F600;</p>", "a <b> é é 😀"),
        ("plain words only", "plain words only"),
    ],
)
def test_content(body, want):
    assert main_text(FRAME.format(body)) == want


LINKS = "<ul><li><a href='/s'>Source one</a></li><li><a href='/t'>Source two</a></li></ul>"


@pytest.mark.parametrize("tag", ["article", "main"])
def test_linked_lists_inside_an_article_stay(tag):
    page = f"<ul><li><a href=/x>Elsewhere</a></li></ul><{tag}>{LONG}<h2>Sources</h2>{LINKS}</{tag}>"
    assert main_text(FRAME.format(page)) == WANT + "\nSources\nSource one\nSource two"
    assert main_text(FRAME.format(f"<div>{LINKS}{LONG}</div>")) == WANT


@pytest.mark.parametrize("name", ["discussion", "notice", "related-work", "social", "share", "toc", "header", "hidden-costs", "menu"])
def test_names_of_parts_of_an_article_stay(name):
    part = f"<section id='{name}'><p>A part of the text.</p></section>"
    assert main_text(FRAME.format(f"<article>{LONG}{part}</article>")) == WANT + "\nA part of the text."
    assert main_text(FRAME.format(f"<div>{LONG}</div>{part}")) == WANT


def test_smoothing_and_clusters():
    flat = smoothed([3.0] * 9)
    assert len(flat) == 9 and abs(flat - 3).max() < 1e-9 and regions(flat).all()
    import numpy as np

    assert regions(np.array([1, 1, 50, 60, 55, 1.0])).tolist() == [False, False, True, True, True, False]


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", FRAME.format(LONG), "k"), (1, "u", FRAME.format(LONG), "k"), (2, None, None, "k"), (None, "v", "", "k"), (3, "w", "<article><p>" + "word " * 100_000, "k")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.n_chars) for r in extract(df).collect())
    assert got == [(0, 0), (1, len(WANT)), (1, len(WANT)), (2, 0), (3, 499_999)]
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<div class='page no-sidebar'>{}</div>",
        "<form id='aspnetForm'>{}</form>",
        "<div class='has-comments'>{}</div>",
        "<article><div class='social-science'>{}</div></article>",
        "<section class='related-work'>{}</section>",
        "<div class='overlay'>{}</div>",
    ],
)
def test_names_around_the_text_keep_it(page):
    assert main_text(FRAME.format(NAV + page.format(LONG) + "<footer>me</footer>")) == WANT


def brute_regions(blocks, sigma=1.5):
    """Ratios (text, tags) of blocks, smoothed by definition, split at a moving threshold."""
    import math

    ratios, n, reach = [t / (g + 1) for t, g in blocks], len(blocks), int(3 * sigma)
    weights = {d: math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)}

    def at(k):
        if n <= reach:
            return ratios[min(max(k, 0), n - 1)]
        return ratios[-k if k < 0 else 2 * (n - 1) - k if k >= n else k]

    smooth = [sum(w * at(k + d) for d, w in weights.items()) / sum(weights.values()) for k in range(n)]
    cut = sum(smooth) / n
    for _ in range(30):
        high, low = [x for x in smooth if x >= cut], [x for x in smooth if x < cut]
        if not low or sum(low) / len(low) > 0.5 * sum(high) / len(high):
            return [True] * n
        cut = (sum(high) / len(high) + sum(low) / len(low)) / 2
    return [x >= cut for x in smooth]


def test_regions_against_definitions_and_their_effect(monkeypatch):
    import random

    from kithgraph.llm import html

    rng, changed = random.Random(4), 0
    for _ in range(60):
        blocks = [(rng.choice([3, 8, 200, 300, 400]), rng.choice([0, 0, 1, 5])) for _ in range(rng.randint(1, 25))]
        values = smoothed([t / (g + 1) for t, g in blocks])
        assert regions(values).tolist() == brute_regions(blocks)
        # Pages without an article: some of the short blocks are links, which only regions tell from content.
        page = "".join(f"<div>{'<a href=x>' if t < 9 else ''}x" + "<i></i>" * g + "x" * (t - 1) + ("</a>" if t < 9 else "") + "</div>" for t, g in blocks)
        kept = main_text(FRAME.format(page))
        with monkeypatch.context() as m:
            m.setattr(html, "regions", lambda v: v >= v.min())
            changed += main_text(FRAME.format(page)) != kept
    assert changed > 9  # of 60


def test_unnamed_frames_of_links_go_by_their_ratios():
    link = "<div><a href=x>{}</a></div>".format
    page = "<div>" + link("Home") + link("News") + link("Us") + "</div><div>" + LONG + "</div>" + link("a") + link("b") + link("c 2024")
    assert main_text(FRAME.format("<div>" + page + "</div>")) == WANT


SHORT = ["Yes.", "No.", "Well.", "So.", "Then she left."]


@pytest.mark.parametrize("first,last", [([], SHORT), (SHORT, []), (SHORT, SHORT)])
@pytest.mark.parametrize("frame", ["<div>{}</div>", "<div id=content>{}</div>", "{}", "<section><div>{}</div></section>"])
def test_short_paragraphs_beside_long_ones_stay(first, last, frame):
    p = lambda lines: "".join(f"<p>{x}</p>" for x in lines)
    long = [f"A long paragraph number {k} " + "with many words of text in it " * 8 + "end." for k in range(12)]
    assert main_text(FRAME.format(NAV + frame.format(p(first) + p(long) + p(last)) + "<footer>me</footer>")).split("\n") == [*first, *long, *last]
    assert main_text(FRAME.format(frame.format(p(long) + "<h2>Notes</h2><p>short note</p><p>Ok.</p>"))).split("\n") == [*long, "Notes", "short note", "Ok."]


@pytest.mark.parametrize("inline", ["<script>var x = '</p>';</script>", "<svg><text>s</text></svg>", "<button>Go</button>", "<span class='ad'>Buy</span>", "<noscript>n</noscript>", "<!-- c -->", "<span class=advert>a <span>b</span> c</span>", "<span hidden>h</span>", "<img alt=x>", "<style>p{}</style>"])
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<div>{}</div>"])
def test_elements_inside_of_a_line_do_not_end_it(inline, frame):
    page = frame.format(f"<p>Hello there my friend {inline} and so on.</p><p>{inline}Next.</p><p>Last.{inline}</p>" + LONG)
    assert main_text(FRAME.format(page)) == "Hello there my friend and so on.\nNext.\nLast.\n" + WANT


def test_formulas_stay():
    page = "<article><p>Then <math><mi>E</mi> <mo>=</mo> <mi>mc</mi></math> holds.</p></article>"
    assert main_text(FRAME.format(page)) == "Then E = mc holds."


@pytest.mark.parametrize("page", ["<div>x" * 80_000, "<a " * 20_000, "<p>x" + "<a " * 20_000 + ">y", "<div class=ad>x" * 20_000, "<b class=x>x" * 40_000, "<li><ul>x" * 20_000, "<h1>x" * 40_000, "<blockquote><p>x" * 20_000 + "</p></blockquote>" * 20_000, "<article>x" * 20_000, "</div>x" * 40_000, "<!--" * 20_000, "&" * 60_000])
def test_time_grows_with_length(page):
    import time

    main_text("<p>x</p>")
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 4


def brute(tree):
    """(blocks, keep) of a page of nested (tag, class, children) in which content is known by construction."""
    out = []

    def walk(node, dropped, line):
        if isinstance(node, str):
            if not dropped:
                line.append(node)
            return
        tag, name, children = node
        gone = dropped or name == "ad" or tag in ("script", "nav", "footer", "aside")
        block = tag in ("p", "div", "section", "li", "ul", "h2", "nav", "footer", "aside")
        if block and line:
            out.append("".join(line))
            line.clear()
        for c in children:
            walk(c, gone, line)
        if block and line:
            out.append("".join(line))
            line.clear()

    line: list[str] = []
    walk(tree, False, line)
    return "\n".join(t for t in (" ".join(x.split()) for x in [*out, "".join(line)]) if t)


def test_articles_against_brute_force():
    """Random articles of nested blocks and inline elements, furniture inside and around them."""
    import random

    rng = random.Random(12)

    def node(depth):
        if depth > 3 or rng.random() < 0.3:
            return rng.choice(["word ", "two words", " and\n more ", "x", "  "])
        tag = rng.choice(["p", "div", "section", "b", "i", "span", "em", "script", "aside", "nav", "h2"])
        children = [node(depth + 1) for _ in range(rng.randint(1, 4))] if tag not in ("script", "p", "h2") else [rng.choice(["text ", "t"])]
        return tag, "ad" if tag == "span" and rng.random() < 0.2 else "", children

    def render(n):
        return n if isinstance(n, str) else f"<{n[0]}{' class=' + n[1] if n[1] else ''}>" + "".join(map(render, n[2])) + f"</{n[0]}>"

    for _ in range(400):
        tree = ("div", "", [node(0) for _ in range(6)])
        page = "<html><body><nav><a href=x>Home</a></nav><article>" + render(tree) + "</article><footer>f</footer></body></html>"
        assert main_text(page) == brute(tree), page
