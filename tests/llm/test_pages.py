"""HTML extraction: whole texts, templates, odd pages."""

from __future__ import annotations

import html
import re

from ballotlake.llm import pages

SF = "/root/testdata/sf0.01"


def plain(page):
    """For the layout of the test pages only: what is inside the article, tag by tag."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    out = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"<(?:/?p|/?h1|br)>", inner)]
    return "\n".join(b for b in out if b)


def test_table_equals_plain_extraction(spark):
    source = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = pages.op3_html_extraction(spark, SF).collect()
    assert len(rows) == len(source)
    for r in rows:
        assert r.text == plain(source[r.page_id].html) and r.url == source[r.page_id].url and r.n_chars == len(r.text)


LAYOUT = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><div class="top-menu">Home</div>
<div id="main"><div class="story"><p>Story {i} <b>be</b>gins &lt;here&gt; &eacute;&#233;&nbsp;now</p><p>second<br>third {i}</p>
<div class="follow">Follow our channel</div></div><div class="sidebar">side {i}</div>
<section id="comments"><p>reader {i} says</p></section><form><p>mail</p></form></div><!-- <p>no</p> --><script>x="<p>no</p>"</script>
<div class="cookie-notice">we use</div><footer>end {i}</footer></body></html>"""


def test_template_and_marks(spark):
    rows = [(i, f"http://h.example/{i}", LAYOUT.format(i=i)) for i in range(12)]
    out = {r.row.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert out[i] == f"Story {i} begins <here> éé now\nsecond\nthird {i}"


def test_copies_are_not_template_and_small_hosts_have_none(spark):
    same = "<html><body><article><h1>A</h1><p>text of the page</p></article></body></html>"
    rows = [(i, "http://copies.example/", same) for i in range(20)] + [(100, "https://u@one.example:8/x", same)]
    out = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {"A\ntext of the page"} and len(out) == 21


def test_odd_pages(spark):
    rows = [(1, None, None, "a"), (1, None, None, "a"), (2, "nonsense", "", "b"), (3, "http://x", "just < text & more", "c"),
            (4, "http://x", "<div>" * 3000 + "deep" + "</div>" * 3000, "d"), (5, "http://x", "<p>" + "long " * 200_000, None),
            (None, "http://x", "<article>a<article>b</article></article><p>out", "e"), (6, "http://x", "<a href='x>y'>l</a><p title=\"un>d", "f")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted((str(r.row.page_id), r.text) for r in pages.extract(df).collect())
    want = {"1": "", "2": "", "3": "just < text & more", "4": "deep", "5": ("long " * 200_000).strip(), "None": "a\nb"}
    assert len(out) == 8 and all(text == want[i] for i, text in out if i in want)
    assert pages.extract(df.limit(0)).count() == 0


def tree(label, *children, code=0):
    node = pages.Node(label, code)
    node.children = list(children)
    return node


def test_tree_matching():
    m = pages.Matching()
    a = m.prepare(tree("b", tree("x"), tree("y"), tree("z")))
    b = m.prepare(tree("b", tree("y"), tree("x"), tree("z"), tree("w")))
    assert len(m.pairs(a, b)) == 3 and m.pairs(a, m.prepare(tree("c"))) == []
    # Nested: the greater common structure wins, in order.
    a = m.prepare(tree("b", tree("d", tree("p"), tree("p")), tree("d", tree("u", tree("l"), tree("l"), tree("l")))))
    b = m.prepare(tree("b", tree("d", tree("u", tree("l"), tree("l"), tree("l"), tree("l")))))
    assert [(x.label, y.label) for x, y in m.pairs(a, b)].count(("l", "l")) == 3
    # Of equal structures those with the same text belong together.
    a = m.prepare(tree("b", *[tree("p", code=c) for c in (1, 2, 9, 3)]))
    b = m.prepare(tree("b", *[tree("p", code=c) for c in (4, 5, 6, 7, 9)]))
    assert (9, 9) in [(x.code, y.code) for x, y in m.pairs(a, b)]


def test_fixed_paragraph_between_changing_ones_is_template(spark):
    def page(i, style):
        story = "".join(f"<p>Part {k} of story {i}</p>" for k in range(i % 4 + 1))
        terms = "<p>Read our terms before you write to us.</p>"
        if style == "home":
            return f"<body class='home'><div class='list'><p>Teaser {i}</p>{terms}<ul><li>one {i}</li></ul></div></body>"
        return f"<body class='single'><div class='story'>{story}{terms}<p>Last words {i}</p></div><div class='follow'>Follow our channel</div></body>"

    rows = [(i, "http://fixed.example/", page(i, "home" if i % 3 == 0 else "single")) for i in range(36)]
    rows += [(100 + i, "http://fixed.example/", "<body><table><tr><td>odd page</td></tr></table></body>") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.row.page_id: r.text for r in pages.extract(df).collect()}
    for i in range(36):
        want = [f"Teaser {i}", f"one {i}"] if i % 3 == 0 else [*(f"Part {k} of story {i}" for k in range(i % 4 + 1)), f"Last words {i}"]
        assert out[i] == "\n".join(want)
        # Without the template the text is another one.
        assert pages.main_text(rows[i][2], set()) != out[i] and "Read our terms" in pages.main_text(rows[i][2], set())
    assert out[100] == "odd page"


def test_long_boilerplate_of_short_stories_goes_and_copies_stay(spark):
    footer = "<div class='bottom'>" + "All rights of this site belong to somebody else. " * 6 + "</div>"
    rows = [(i, "http://short.example/", f"<body><div class='s'><p>Story {i}</p></div>{footer}</body>") for i in range(20)]
    rows += [(100 + i, "http://copy.example/", f"<body><p>One text for all.</p><p>And more.</p>{footer}</body>") for i in range(50)]
    out = {r.row.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Story {i}" for i in range(20))
    assert all(out[100 + i].startswith("One text for all.\nAnd more.") for i in range(50))


def text_of(html):
    return pages.main_text(html, set())


def test_names_and_elements_that_only_look_like_parts():
    for odd in ("<svg class='i'/>", "<svg-icon>", "<template-card>", "<title-bar>", "<script-note>", "<svg><path d='x'/></svg>", "<iframe src='x'/>"):
        assert text_of(f"<body><article><p>before</p>{odd}<p>after</p></article></body>") == "before\nafter", odd
    for name in ("share-price", "related-work", "social-history", "ad-hoc", "share", "comments"):
        assert text_of(f'<article><p>a</p><p class="{name}">b</p><h2 class="{name}">c</h2></article>') == "a\nb\nc", name
    for name in ("share-price", "related-work", "social-history", "ad-hoc"):
        assert text_of(f'<article><p>a</p><div class="{name}">b</div></article>') == "a\nb", name
        assert text_of(f'<body><p>a</p><div class="{name}">b</div></body>') == "a\nb", name
    for part in ('<div class="share">x</div>', '<section id="comments"><p>x</p></section>', "<aside>x</aside>", '<div role="navigation">x</div>', "<div hidden>x</div>"):
        assert text_of(f"<article><p>a</p>{part}</article>") == "a", part
    assert text_of('<body><div class="site-footer">x</div><div id="top_menu">x</div><div class="mainNav">x</div><p>a</p></body>') == "a"


def test_story_beside_a_teaser():
    story = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(5))
    out = text_of(f"<body><article><p>Read this too</p></article><div class='story'><h1>Title</h1>{story}</div></body>")
    assert out.startswith("Title\nword") and "Read this too" not in out and out.count("\n") == 5


def test_broken_pages_take_time_that_grows_with_their_length():
    import time
    for broken in ("<a ", "<a href='", '<a href="x', "<!", "<title>", "<title", "<div class='", "</", "<p>x<div "):
        start = time.process_time()
        text_of("<article><p>first</p>" + broken * (1_000_000 // len(broken)))
        assert time.process_time() - start < 6, broken
    labels = [tree(f"x{i}") for i in range(1000)]
    m = pages.Matching()
    start = time.process_time()
    m.pairs(m.prepare(tree("b", *labels)), m.prepare(tree("b", *[tree(f"x{999 - i}") for i in range(1000)])))
    assert time.process_time() - start < 2


def test_text_after_and_in_deep_parts(spark):
    inner = "<div>" * 150 + "deep<aside>left out<div>this too</div></div></b>and this</aside>last" + "</div>" * 149
    page = f"<body><div><article><p>first</p>{inner}<p>after {{i}}</p><i>" + "<b>" * 300 + "bold</b>" + "</b>" * 299 + "</i></article></div><p>out</p></body>"
    rows = [(i, "http://deep.example/", page.format(i=i)) for i in range(3)]
    rows += [(10 + i, "http://very.example/", "<body><article>" + "<div>" * 20_000 + f"at the bottom {i}" + "</div>" * 20_000 + f"<p>end {i}</p></article><p>out") for i in range(6)]
    out = {r.row.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(3):
        assert out[i].split("\n")[:2] == ["first", "deep"] and out[i].split("\n")[-2:] == [f"after {i}", "bold"]
        assert "left out" not in out[i] and "this too" not in out[i] and "out" not in out[i].split("\n")
    assert all(out[10 + i] == f"at the bottom {i}\nend {i}" for i in range(6))


def test_trees_come_back():
    made = pages.tree_of(pages.parse("<div>a<p>b</p><ul><li>c<li>d</ul></div><p>e" + "<i>" * 5 + "<table><tr><td>x<td>y<tr><td>z</table>"))
    again = pages.loaded(pages.dumped(made))
    assert [(n.label, n.code, len(n.children)) for n in pages.nodes_of(again)] == [(n.label, n.code, len(n.children)) for n in pages.nodes_of(made)]
    m = pages.Matching()
    assert len(m.pairs(m.prepare(made), m.prepare(again))) == len(pages.nodes_of(made))


def brute_pairs(p, q, score=lambda a, b: (3 if a[1] == b[1] else 1) if a[0] == b[0] else 0):
    """The score of the best alignment of two lists, of (label, code) or others, cell by cell."""
    table = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i, a in enumerate(p):
        for j, b in enumerate(q):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + score(a, b))
    return table[-1][-1]


def test_long_lists_of_siblings_are_aligned_whole():
    import random
    rnd = random.Random(3)
    # What is common to both stands far from the same place in each.
    fixed = [("p", 10_000 + i) for i in range(300)]
    cases = [(fixed + [("p", i + 1) for i in range(500)], [("p", 1000 + i) for i in range(500)] + fixed)]
    for n, m in ((5, 7), (64, 65), (65, 300), (201, 450), (700, 130)):
        cases.append(tuple([(rnd.choice("abc"), rnd.randrange(1, 40)) for _ in range(k)] for k in (n, m)))
    for p, q in cases:
        m = pages.Matching()
        a, b = (m.prepare(tree("b", *[tree(label, code=code) for label, code in x])) for x in (p, q))
        found = m.pairs(a, b)[1:]
        assert sum(3 if x.code == y.code else 1 for x, y in found) == brute_pairs(p, q)
        for own, side in ((a, 0), (b, 1)):
            order = {id(c): i for i, c in enumerate(own.children)}
            at = [order[id(pair[side])] for pair in found]
            assert len(set(at)) == len(at)
    # The same below: structures that differ in many children.
    m = pages.Matching()
    parts = ["xy"] * 500 + ["xz"] * 40, ["xw"] * 300 + ["xy"] * 400 + ["z"]
    wide = [m.prepare(tree("b", tree("d", *[tree("u", *[tree(x) for x in part]) for part in side]))) for side in parts]
    assert m.common(wide[0].shape, wide[1].shape) == 2 + brute_pairs(*parts, lambda a, b: 1 + len(set(a) & set(b)))


def test_template_far_down_a_list_is_found(spark):
    def page(i):
        # The longer a page's list, the further down its fixed end begins.
        return "<body><div>" + "".join(f"<p>Item {k} of {i}</p>" for k in range(1 + 400 * (i % 3))) + "".join(
            f"<p>Fixed line {k} of the site</p>" for k in range(250)) + "".join(f"<p>Last {k} of {i}</p>" for k in range(150 * (i % 2))) + "</div></body>"

    rows = [(i, "http://long.example/", page(i)) for i in range(12)]
    out = {r.row.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert "Fixed line" not in out[i] and out[i].count("\n") + 1 == 1 + 400 * (i % 3) + 150 * (i % 2)
