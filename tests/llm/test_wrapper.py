"""Wrapper induction: tree matching against brute force, hosts of several sizes, copies of an article, page markup."""

import itertools
import random

import pytest

from turnstile.llm import wrapper


def _greatest(a, b):
    """Matched nodes below two roots of one label: every choice of children of both sides, in order."""
    best = 0
    for k in range(min(len(a[1]), len(b[1])) + 1):
        for xs in itertools.combinations(a[1], k):
            for ys in itertools.combinations(b[1], k):
                if all(x[0] == y[0] for x, y in zip(xs, ys, strict=True)):
                    best = max(best, sum(1 + _greatest(x, y) for x, y in zip(xs, ys, strict=True)))
    return best


def _tree(rng, depth):
    return [rng.choice("abc"), [_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else []]


def test_tree_matching_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        a, b = ["#", [_tree(rng, 2) for _ in range(3)]], ["#", [_tree(rng, 2) for _ in range(3)]]
        found, pairs = wrapper.matching(a, b)
        assert found == _greatest(a, b)
        assert pairs == sorted(pairs) and all(a[1][i][0] == b[1][j][0] for i, j in pairs)
        assert sum(1 + wrapper.matching(a[1][i], b[1][j])[0] for i, j in pairs) == found


def test_merged_trees_have_a_slot_for_every_node():
    rng = random.Random(4)
    for _ in range(50):
        trees = [["#", [_tree(rng, 2) for _ in range(3)]] for _ in range(4)]
        template = None
        for t in trees:
            template = wrapper.merged(template, t)
        assert all(0 == wrapper.slots(template, t)[0] for t in trees)
        assert -1 not in wrapper.slots(template, trees[-1])


def _texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["row"]["page_id"]: r["text"] for r in wrapper.extracted(pages, ["page_id"]).collect()}


PAGE = "<body><div>Acme daily</div><div class=x><p>By <a>author {n}</a></p><p>story {n}</p><p>Share this story</p></div><div>All rights reserved</div></body>"


@pytest.mark.parametrize("size", [3, 5, 50])
def test_template_decides_on_hosts_of_any_size(spark, shared, size):
    """Constant blocks go, also between varying siblings; a block whose phrases vary is none."""
    got = _texts(spark, [(n, "http://h/", PAGE.format(n=n)) for n in range(size)])
    assert got == {n: f"By author {n}\nstory {n}" for n in range(size)}


def test_two_pages_make_no_template(spark, shared):
    got = _texts(spark, [(n, "http://h/", PAGE.format(n=n)) for n in range(2)])
    assert got[1] == "Acme daily\nBy author 1\nstory 1\nShare this story\nAll rights reserved"


def test_one_article_at_many_urls_stays_whole(spark, shared):
    page = "<body><div class=ad>advert {n}</div><article><h1>Title</h1><p>first</p><p>second</p></article><aside>seen {n} times</aside></body>"
    got = _texts(spark, [(n, f"http://h/{n}", page.format(n=n)) for n in range(6)])
    assert set(got.values()) == {"Title\nfirst\nsecond"}
    # Repeated pages: a row each, and no template made of copies.
    got = _texts(spark, [(n, "http://h/1", PAGE.format(n=1)) for n in range(6)])
    assert len(got) == 6 and set(got.values()) == {"Acme daily\nBy author 1\nstory 1\nShare this story\nAll rights reserved"}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p>one</p><svg class=i /><p>two</p><math/><p>three</p></article>", "one\ntwo\nthree"),
        ("<article><p>one</p><svg><text>icon</text></svg><script>x</script><p>two</p></article>", "one\ntwo"),
        ("<article><p>Use the <span class='search-term'>search</span> box, <b class=share>share</b> it</p></article>", "Use the search box, share it"),
        ("<article><div class='search-term'>sought</div><div class='ad-slot'>buy</div><div class='share-buttons'>tell</div></article>", "sought"),
        ("<main><article><p>text</p></article></main><article><p>teaser</p></article>", "text"),
        ("<article><p>text</p></article><article class='user-comment'><p>nice</p></article>", "text"),
        ("<article><p>text</p><article class=comment>nice</article><section id=comments><p>too</p></section></article>", "text"),
        ("<form><div class='page with-sidebar'><main><p>text</p></main></div></form>", "text"),
        ("<div class=related><article><p>only</p></article></div>", "only"),
        ("<article><header><h1>T</h1></header><p>a<br>b &amp; c</p></article><header>site</header>", "T\na b & c"),
        ("", ""),
        (None, ""),
        ("no tags", "no tags"),
    ],
)
def test_markup(html, text):
    root = wrapper.parse(html or "")
    assert "\n".join(t for _, t, _ in wrapper.pieces(root, wrapper.folded(root)[1])) == text


def test_empty_table_and_odd_columns(spark, shared):
    pages = spark.createDataFrame([(1, "http://h/", "<p>x</p>", "r"), (1, None, "<p>x</p>", "r"), (None, "y", None, None)], "page_id long, url string, html string, host string")
    assert sorted(r["text"] for r in wrapper.extracted(pages, ["page_id", "host"]).collect()) == ["", "x", "x"]
    assert wrapper.extracted(pages.limit(0), ["page_id"]).count() == 0
