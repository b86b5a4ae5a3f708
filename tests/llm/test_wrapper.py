"""What belongs to a host's template and what doesn't."""

import random
from itertools import combinations

import pytest

from pagesift.llm import html_wrapper


def texts(spark, sources, host="h.example"):
    rows = [(k, f"http://{host}/{k}", s) for k, s in enumerate(sources)]
    got = html_wrapper.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r["page_id"]: r["text"] for r in got}


def test_constant_members_of_a_run_are_template(spark):
    story = lambda k: f"story {k} " + "abc " * k
    plain = texts(spark, [f"<body><div>menu</div><div>{story(k)}</div><div>all rights reserved</div></body>" for k in range(12)])
    assert plain == {k: story(k).strip() for k in range(12)}
    notice = texts(spark, ["<article>" + "".join(f"<p>part {k} {i}</p>" for i in range(1 + k % 4)) + "<p>Read our terms.</p></article>" for k in range(12)])
    assert notice == {k: "\n".join(f"part {k} {i}" for i in range(1 + k % 4)) for k in range(12)}


def test_copies_of_an_article_do_not_vote_for_themselves(spark):
    page = lambda k: f"<article><h1>T{k}</h1><p>a {k}</p><h2>S{k}</h2><p>b {k}</p><p>c {k}</p></article>"
    got = texts(spark, [page(0)] * 30 + [page(k) for k in range(1, 8)])
    assert all(got[k] == "T0\na 0\nS0\nb 0\nc 0" for k in range(30))
    assert got[33] == "T4\na 4\nS4\nb 4\nc 4"


def test_a_name_alone_does_not_hide_the_text_of_a_page(spark):
    story = "<p>one long story</p><p>and its end</p>"
    for name in ("content has-sidebar", "layout-no-sidebar", "page search-results"):
        for inner in (story, f"<article>{story}</article>"):
            page = f'<body><div>top</div><div class="{name}">{inner}</div></body>'
            got = texts(spark, [page.replace("one", f"story {k}").replace("its", f"the {k}th") for k in range(8)], name[:3] + ".example")
            assert got == {k: f"story {k} long story\nand the {k}th end" for k in range(8)}
    kept = html_wrapper.extract('<body><p>short</p><div id="comments"><article><p>a very long rant of a reader</p></article></div><div class="cookie-notice"><p>we use many cookies here</p></div></body>')
    assert kept == "short"


def site(k):
    """A page without telling names or tags: a menu, a head and a tail around a story."""
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Part {i}</a></li>" for i in range(6)) + "</ul>"
    story = "".join(f"<p>sentence {k} {i} of the story</p>" for i in range(1 + k % 3)) + f"<h2>second part {k}</h2><p>more about {k}</p>"
    tail = "<p>Call us at any time.</p><p>All prices with tax.</p>"
    return f'<body><div class="x1"><div class="x2">{menu}</div><div class="x3">{story}{tail}</div><div class="x4"><p>Made by hand.</p></div></div></body>', "\n".join([*[f"sentence {k} {i} of the story" for i in range(1 + k % 3)], f"second part {k}", f"more about {k}"])


def test_a_site_with_neutral_names(spark, monkeypatch):
    pages = [site(k) for k in range(40)]
    assert texts(spark, [p for p, _ in pages]) == {k: t for k, (_, t) in enumerate(pages)}
    # the template does it: without constants the menu and the notes stay
    assert html_wrapper.extract(pages[0][0]) == "".join(f"Part {i}\n" for i in range(6)) + pages[0][1] + "\nCall us at any time.\nAll prices with tax.\nMade by hand."


def test_a_box_at_its_own_place_on_some_pages(spark):
    """Constant where it is, though most pages have other text on the same path."""
    box = "<div><p>Offer of the week: two for one.</p></div><h3>part</h3>"
    page = lambda k: f"<body>{box if k % 4 == 0 else ''}<table><tr><td>x {k}</td></tr></table><div><p>story {k}</p></div></body>"
    got = texts(spark, [page(k) for k in range(40)])
    assert got[4] == "x 4\nstory 4" and got[5] == "x 5\nstory 5"


def test_names_and_links_do_not_drop_paragraphs():
    keep = '<article><div class="share-price-notice"><p>Shares rose.</p></div><div class="ad"><p>Buy</p></div><div class="search-results-story"><p>Found.</p></div></article>'
    assert html_wrapper.extract(keep) == "Shares rose.\nFound."
    assert html_wrapper.extract("<body><p><a href=x>Start here.</a></p><p>Text</p><ul><li><a>menu</a></li></ul><p><a>End.</a></p></body>") == "Start here.\nText\nmenu\nEnd."
    assert html_wrapper.extract('<body><div class="post-header"><h1>T</h1></div><div class="siteHeader">top</div><p>text</p><div class="ad-slot box">buy</div></body>') == "T\ntext"


def test_any_depth():
    for n in (100, 700, 20_000):
        assert html_wrapper.extract("<div>" * n + "<nav>menu</nav><p>text 1</p>" + "</div>" * n + "<p>end</p>") == "text 1\nend"


def tree(rng, depth=3):
    node = html_wrapper.Shape(rng.choice("abc"), 1)
    node.children = [tree(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
    return node


def brute_size(a, b):
    """By trying every ordered choice of pairs of children."""
    if a.label != b.label:
        return 0
    best = 0
    for n in range(1, min(len(a.children), len(b.children)) + 1):
        for x in combinations(a.children, n):
            for y in combinations(b.children, n):
                sizes = [brute_size(p, q) for p, q in zip(x, y, strict=True)]
                best = max(best, sum(sizes) if all(sizes) else 0)
    return 1 + best


def test_matching_is_the_largest():
    rng, seen = random.Random(3), 0
    for _ in range(300):
        a, b = tree(rng), tree(rng)
        b.label = a.label
        matching = html_wrapper.Matching()
        pairs = matching.pairs(a.children, b.children)
        assert matching.size(a, b) == brute_size(a, b) == 1 + sum(matching.size(a.children[i], b.children[j]) for i, j in pairs)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        seen += len(pairs) > 1
    assert seen > 20


def test_merged_outlines_hold_every_tree():
    rng = random.Random(4)
    for _ in range(100):
        a, b = tree(rng), tree(rng)
        b.label = a.label
        whole = html_wrapper.Shape.parse(a.dump())
        html_wrapper.merge(whole, html_wrapper.Shape.parse(b.dump()))
        size = lambda t: sum(1 for _ in t.walk())
        assert size(whole) == size(a) + size(b) - brute_size(a, b)
        for one in (a, b):
            outline = " ".join(f"{d}:{n.label}" for n, d, _ in one.walk())
            assert all(slot >= 0 for slot, _ in html_wrapper.places(outline, whole))


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_change_nothing(spark, parts, monkeypatch):
    monkeypatch.setattr(html_wrapper, "_FAN", 2)
    rows = [(k, "http://h.example/", site(k)[0].replace("x3", f"y{'abcdefgh'[k % 8]}")) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    templates = {r["host"]: r["template"] for r in html_wrapper.induce(df).collect()}
    assert list(templates) == ["h.example"] and all(f"div.y{c}:5" in templates["h.example"] for c in "abcdefgh")
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract_text(df).collect()}
    assert got == {k: site(k)[1] for k in range(40)}


def test_constant_headings_between_an_articles_texts_stay(spark):
    page = lambda k: f"<article><h1>Dish {k}</h1><h2>Ingredients</h2><p>{k} eggs</p><h2>Method</h2><p>stir {k} times</p><p>Read our terms.</p></article>"
    got = texts(spark, [page(k) for k in range(20)])
    assert got == {k: f"Dish {k}\nIngredients\n{k} eggs\nMethod\nstir {k} times" for k in range(20)}


def test_only_a_template_drops_links(spark):
    assert texts(spark, ["<p>A<ul><li><a>linked item</a></li></ul>"]) == {0: "A\nlinked item"}
    menu = "<ul><li><a>Home</a></li><li><a>News</a></li></ul>"
    got = texts(spark, [f"{menu}<div>story {k}</div><ul><li><a>source {k}</a></li></ul>" for k in range(12)])
    assert got == {k: f"story {k}\nsource {k}" for k in range(12)}


def test_a_form_that_is_the_page(spark):
    whole = "<body><form action=x><div class='sidebar'>aside</div><input name=a><h1>Title {k}</h1><p>Long text of page {k}, which all stands in a form.</p><button>Send</button></form><p>foot</p></body>"
    small = "<body><p>Long text of page {k}, which stands beside a form.</p><form>Name <input> Mail <input></form></body>"
    got = texts(spark, [whole.format(k=k) for k in range(3)])
    assert got == {k: f"Title {k}\nLong text of page {k}, which all stands in a form.\nfoot" for k in range(3)}
    got = texts(spark, [small.format(k=k) for k in range(3)])
    assert got == {k: f"Long text of page {k}, which stands beside a form." for k in range(3)}
