import pytest

from kiln.functions.html import compile_path, nodes_of, parse, values_of
from kiln.operators import web

PAGE = """<!DOCTYPE html><html lang=en><head><title>T &amp; t</title><script>var x = "<p>no</p>";</script></head><body>
<!-- <h1>comment</h1> --><div id="a" class="posted-by big"><span class='date'>2024/01/02</span><a href="/x" data-k>Bob <b>B</b></a></div>
<ul><li>one<li>two <b>bold</ul><div class="news-post-content"><p>first<p>second<br>line<div>inner</div></div>
<h1 class="other heading-size-1">Head</h1><h1>Second</h1></body>"""


def values(path, html=PAGE):
    return values_of(parse(html), compile_path(path))


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("//h1", ["Head", "Second"]),
        ('//h1[@class="heading-size-1"] | //h1[contains(@class,"heading")] | //h1', ["Head"]),
        ('//div[contains(@class,"posted-by")]//a | //a', ["Bob B"]),
        ('//div[contains(@class, "posted-by")]//span[@class="date"]', ["2024/01/02"]),
        ("//a/@href", ["/x"]),
        ("//a[@data-k]/b", ["B"]),
        ("/html/@lang", ["en"]),
        ("//ul/li", ["one", "two bold"]),
        ("//ul/li[2]", ["two bold"]),
        ("//li/b", ["bold"]),
        ("//title", ["T & t"]),
        ('//div[contains(@class,"news-post-content")]', ["first second line inner"]),
        ('//div[contains(@class,"news-post-content")]/p', ["first", "second line"]),
        ('//p[contains(text(), "line")]', ["second line"]),
        ("//h2 | //h3", []),
        ("/h1", []),
        ("//body/*[@id]/@id", ["a"]),
    ],
)
def test_paths(path, want):
    assert values(path) == want


@pytest.mark.parametrize("path", ["", "h1", "//h1[last()]", "//a/@href/b", "//", "//h1 | "])
def test_paths_that_are_not_understood(path):
    with pytest.raises(ValueError):
        compile_path(path)


def test_intervals_are_the_tree():
    t = parse(PAGE)
    for n in range(len(t.tags)):
        inside = {m for m in range(len(t.tags)) if n < m <= t.last[n]}
        up = set()
        for m in range(len(t.tags)):
            x = t.parents[m]
            while x >= 0:
                if x == n:
                    up.add(m)
                x = t.parents[x]
        assert inside == up
    assert parse(None).tags == [] and parse("plain <").tags == [] and parse("</b>x").tags == []


def test_nested_elements_of_one_name():
    t = parse("<div><div class=x><p>a</div><p>b</div><p>c")
    assert values_of(t, compile_path("//div")) == ["a b", "a"]
    assert [t.text_of(n) for n in nodes_of(t, compile_path("//div//p")[0][0])] == ["a", "b"]
    assert values_of(t, compile_path("//table//tr")) == []


def test_table_functions(spark):
    pages = spark.createDataFrame([(1, "u1", PAGE), (2, "u2", None), (3, "u3", "<h1> x </h1><ul><li><a href='1'>a</a><a href='2'>b</a></li><li></li></ul>")], "page_id long, url string, html string")
    paths = {"title": "//h1", "who": "//a", "it's": "//li/a/@href"}
    got = {r.page_id: tuple(r)[1:] for r in web.fields_by_path(pages, paths).collect()}
    assert got == {1: ("u1", "Head", "Bob B", ""), 2: ("u2", "", "", ""), 3: ("u3", "x", "a", "1")}
    assert {r.page_id for r in web.fields_by_path(pages, paths, "//h1").collect()} == {1, 3}
    nested = web.nested_by_path(pages, "//li", {"to": ".//a/@href", "label": "./a"})
    assert sorted(tuple(r) for r in nested.collect()) == [(3, 0, "1 2", "a b")]
    nodes = web.html_nodes(pages.where("page_id = 3")).collect()
    assert [(r.node, r.parent, r.last, r.tag) for r in nodes] == [(0, -1, 0, "h1"), (1, -1, 5, "ul"), (2, 1, 4, "li"), (3, 2, 3, "a"), (4, 2, 4, "a"), (5, 1, 5, "li")]
    plan = web.html_nodes(pages)._jdf.queryExecution().executedPlan().toString()
    assert "UDTF" in plan


def test_crawl_and_extract(spark):
    stored = spark.createDataFrame([("b/1", "<h1>one</h1>"), ("b/2", "<h1>two</h1>")], "url string, html string")
    found = spark.createDataFrame([("b/1",), ("b/2",), ("b/1",), ("b/3",)], "url string")
    visited = spark.createDataFrame([("b/2",)], "url string")
    assert sorted(tuple(r) for r in web.crawl_articles(found, stored, {"title": "//h1"}).collect()) == [("b/1", "one"), ("b/2", "two")]
    assert [tuple(r) for r in web.crawl_articles(found, stored, {"title": "//h1"}, visited).collect()] == [("b/1", "one")]
