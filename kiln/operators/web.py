"""Stored web pages: links, crawl order, fields."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions import html as tree

HREF = r'<a\s+href="([^"]*)"'
FIELDS = {
    "title": (r"<h1[^>]*>([^<]*)</h1>", r"<title>([^<]*)</title>"),
    "author": (r'<meta\s+name="author"\s+content="([^"]*)"', r'class="author"[^>]*>([^<]*)<'),
    "date": (r"<time[^>]*>([^<]*)</time>",),
    "content": (r"(?s)<article>(.*?)</article>", r"(?s)<body>(.*?)</body>"),
}


def absolute(url: Column, base: Column) -> Column:
    """Only what begins with a slash is put behind the base."""
    return F.when(F.startswith(url, F.lit("/")), F.concat(base, url)).otherwise(url)


def article_url(url: Column, host: str, section: str = "news") -> Column:
    """https://host/section/slug-digits, slug in lower case."""
    safe = host.replace(".", r"\.")
    return url.rlike(rf"^https://{safe}/{section}/[a-z0-9-]+-\d+$")


def links(pages: DataFrame, base: str = "", contains: str = "", html_col: str = "html") -> DataFrame:
    """(page_id, pos, url) of all links with an address that holds `contains`, in the order of the page."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all(html_col, F.lit(HREF), F.lit(1))).alias("pos", "href"))
    found = found.where("href <> ''")
    if contains:
        found = found.where(F.contains("href", F.lit(contains)))
    return found.select("page_id", "pos", absolute(F.col("href"), F.lit(base)).alias("url"))


def first_seen(found: DataFrame) -> DataFrame:
    """One row for each url, the first by page and position."""
    w = Window.partitionBy("url").orderBy("page_id", "pos")
    return found.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def crawl(pages: DataFrame, base: str = "", contains: str = "", max_pages: int = 20) -> DataFrame:
    """(page_id, pos, url): what a crawl over listing pages 1.. in order finds. It ends before the first page that has no
    link which isn't on an earlier page."""
    found = links(pages.where(F.col("page_id") < max_pages), base, contains)
    new = first_seen(found)
    gains = pages.where(F.col("page_id") < max_pages).select("page_id").join(new.select("page_id").distinct().withColumn("new", F.lit(1)), "page_id", "left")
    stop = gains.where("new is null").agg(F.min("page_id").alias("stop"))
    return new.crossJoin(F.broadcast(stop)).where("stop is null or page_id < stop").drop("stop")  # one row


def field(html: Column, patterns: tuple[str, ...]) -> Column:
    """The first match of the first pattern that has any, trimmed, even if it is blank; else empty."""
    return F.coalesce(*(F.trim(F.get(F.regexp_extract_all(html, F.lit(p), F.lit(1)), F.lit(0))) for p in patterns), F.lit(""))


def page_fields(pages: DataFrame, fields: dict[str, tuple[str, ...]] = FIELDS) -> DataFrame:
    """One row for each page with a heading: page_id, url and the fields."""
    ready = pages.where(F.col("html").rlike("<body") & F.col("html").rlike("<h1"))
    return ready.select("page_id", "url", *(field(F.col("html"), p).alias(k) for k, p in fields.items()))


def nested(pages: DataFrame, root: str, fields: dict[str, str]) -> DataFrame:
    """(page_id, pos, fields...): one row for each match of root; each field joins its matches inside by blanks. Rows of
    which all fields are empty are dropped."""
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(root), F.lit(0))).alias("pos", "part"))
    out = each.select("page_id", "pos", *(F.array_join(F.regexp_extract_all("part", F.lit(p), F.lit(1)), " ").alias(k) for k, p in fields.items()))
    return out.where(F.concat_ws("", *fields) != "")


# -- by the tree of a page: table functions that are called by LATERAL


@F.udtf(returnType="node int, parent int, last int, tag string, attributes map<string,string>, text string")
class HtmlNodes:
    """html_nodes(html): a row for each element; those inside it have numbers from node + 1 to last."""

    def eval(self, html: str) -> Iterator[tuple]:
        t = tree.parse(html)
        for n, tag in enumerate(t.tags):
            yield n, t.parents[n], t.last[n], tag, t.attributes[n], t.text_of(n)


@F.udtf(returnType="fields map<string,string>")
class HtmlFields:
    """html_fields(html, paths): a row with the first value of each path; empty where there is none."""

    def __init__(self):
        self.compiled: dict[str, dict] = {}

    def eval(self, html: str, paths: str) -> Iterator[tuple]:
        if paths not in self.compiled:
            self.compiled[paths] = {k: tree.compile_path(p) for k, p in json.loads(paths).items()}
        t = tree.parse(html)
        yield ({k: (tree.values_of(t, p) or [""])[0].strip() for k, p in self.compiled[paths].items()},)


@F.udtf(returnType="pos int, fields map<string,string>")
class HtmlNested:
    """html_nested(html, root, paths): a row for each element of root; values of a path inside it are joined by blanks. Rows
    without any value are left out."""

    def __init__(self):
        self.compiled: dict[tuple, tuple] = {}

    def eval(self, html: str, root: str, paths: str) -> Iterator[tuple]:
        if (root, paths) not in self.compiled:
            self.compiled[root, paths] = tree.compile_path(root), {k: tree.compile_path(p) for k, p in json.loads(paths).items()}
        roots, inner = self.compiled[root, paths]
        t = tree.parse(html)
        found = next((x for steps, _ in roots if (x := tree.nodes_of(t, steps))), [])
        for pos, n in enumerate(found):
            fields = {k: " ".join(tree.values_of(t, p, n)).strip() for k, p in inner.items()}
            if any(fields.values()):
                yield pos, fields


def _lateral(pages: DataFrame, name: str, function, select: str, call: str, **args: str) -> DataFrame:
    spark = pages.sparkSession
    spark.udtf.register(name, function)
    return spark.sql(f"SELECT {select} FROM {{pages}} AS p, LATERAL {name}({call}) AS x", args=args, pages=pages)


def html_nodes(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, node, parent, last, tag, attributes, text) of all elements."""
    return _lateral(pages, "html_nodes", HtmlNodes, "p.page_id, x.*", f"p.{html_col}")


def fields_by_path(pages: DataFrame, paths: dict[str, str], ready: str | None = None, html_col: str = "html") -> DataFrame:
    """(page_id, url, fields): the first element's text (or attribute) of each path, whose alternatives are tried one after
    another; no element gives an empty field. Pages without any text at `ready` are left out, as pages that failed."""
    asked = paths | ({"__ready": ready} if ready else {})
    made = _lateral(pages, "html_fields", HtmlFields, "p.page_id, p.url, x.fields", f"p.{html_col}, :paths", paths=json.dumps(asked))
    if ready:
        made = made.where(F.col("fields")["__ready"] != "")
    return made.select("page_id", "url", *(F.col("fields")[k].alias(k) for k in paths))


def nested_by_path(pages: DataFrame, root: str, paths: dict[str, str], html_col: str = "html") -> DataFrame:
    """(page_id, pos, fields...): one row for each element of root inside which some path finds a value."""
    made = _lateral(pages, "html_nested", HtmlNested, "p.page_id, x.pos, x.fields", f"p.{html_col}, :root, :paths", root=root, paths=json.dumps(paths))
    return made.select("page_id", "pos", *(F.col("fields")[k].alias(k) for k in paths))


def crawl_articles(frontier: DataFrame, stored: DataFrame, paths: dict[str, str], visited: DataFrame | None = None) -> DataFrame:
    """Records (url, fields...) of the addresses that a crawl found, each once: those that weren't visited are looked up in
    the stored pages (url, html), and their fields extracted. Addresses without a stored page give no record."""
    queue = frontier.select("url").distinct()
    if visited is not None:
        queue = queue.join(visited.select("url"), "url", "left_anti")
    pages = queue.join(stored.select("url", "html"), "url").select(F.col("url").alias("page_id"), "url", "html")
    return fields_by_path(pages, paths).drop("page_id")
