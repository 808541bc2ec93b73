"""HTML as a tree of numbered nodes, and path expressions over it.

One pass over the tokens of a page numbers its elements in the order in which they begin; `last` is the number of an
element's last descendant. So "inside x" is the interval (x, last of x], and a path is a chain of interval tests.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose end may be left out, and what begins instead of it (or any end around them).
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"},
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
}
#: Elements a missing end doesn't reach over.
SCOPES = frozenset("html body table td th ul ol dl article section div nav main".split())
BREAKS = CLOSED_BY["p"] | frozenset("br li tr td th dt dd option body title".split())


@dataclass
class Tree:
    """Columns of a page's elements; text (without scripts and styles) from `begins` to `ends` of an element is its own."""

    tags: list[str] = field(default_factory=list)
    attributes: list[dict[str, str]] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    begins: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    text: str = ""
    by_tag: dict[str, list[int]] = field(default_factory=dict)

    def text_of(self, node: int) -> str:
        """Its text in one line; a title has one, too."""
        return " ".join(self.text[self.begins[node] : self.ends[node]].split())

    def inside(self, node: int, tag: str) -> list[int]:
        """Descendants with a tag (* is any); node -1 is the page."""
        if tag == "*":
            return list(range(node + 1, (self.last[node] if node >= 0 else len(self.tags) - 1) + 1))
        listed = self.by_tag.get(tag, [])
        return listed[bisect_right(listed, node) : bisect_right(listed, self.last[node]) if node >= 0 else len(listed)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree, self.open, self.parts, self.size = Tree(), [], [], 0  # open: elements without an end yet

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        t = self.tree
        while self.open and tag in CLOSED_BY.get(t.tags[self.open[-1]], ()):
            self.shut()
        for depth in range(len(self.open) - 1, -1, -1):  # <li><b>..<li>: the end of the first li is further out
            name = t.tags[self.open[depth]]
            if tag in CLOSED_BY.get(name, ()) and name != "p":
                while len(self.open) > depth:
                    self.shut()
                break
            if name in SCOPES:
                break
        if tag in BREAKS:
            self.add(" ")
        node = len(t.tags)
        t.tags.append(tag)
        t.attributes.append({k: v or "" for k, v in reversed(attrs)})
        t.parents.append(self.open[-1] if self.open else -1)
        t.last.append(node)
        t.begins.append(self.size)
        t.ends.append(self.size)
        t.by_tag.setdefault(tag, []).append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def shut(self) -> None:
        t, node = self.tree, self.open.pop()
        t.last[node], t.ends[node] = len(t.tags) - 1, self.size
        if t.tags[node] in BREAKS:
            self.add(" ")

    def handle_endtag(self, tag: str) -> None:
        """Closes the nearest open element of that name, and what is open inside it; an end without one is passed over."""
        names = [self.tree.tags[x] for x in self.open]
        if tag in names:
            depth = len(names) - 1 - names[::-1].index(tag)
            while len(self.open) > depth:
                self.shut()

    def handle_data(self, data: str) -> None:
        tags = {self.tree.tags[x] for x in self.open[-3:]}
        if not tags & {"script", "style", "template"}:
            self.add(data)


def parse(html: str | None) -> Tree:
    """Whatever the page is like, all its elements; comments and declarations are none. Null has none."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    while builder.open:
        builder.shut()
    builder.tree.text = "".join(builder.parts)
    return builder.tree


@dataclass(frozen=True)
class Step:
    """deep: any descendant, else children; tests: (kind, attribute, value)."""

    deep: bool
    tag: str
    tests: tuple[tuple[str, str, str], ...] = ()


_STEP = re.compile(r"(//?)(@?)([\w*-]+)((?:\[[^\]]*\])*)")
_TESTS = (
    ("is", re.compile(r"""@([\w-]+)\s*=\s*["']([^"']*)["']""")),
    ("holds", re.compile(r"""contains\(\s*@([\w-]+)\s*,\s*["']([^"']*)["']\s*\)""")),
    ("text", re.compile(r"""contains\(\s*(text\(\)|\.)\s*,\s*["']([^"']*)["']\s*\)""")),
    ("has", re.compile(r"@([\w-]+)()")),
    ("nth", re.compile(r"(\d+)()")),
)


def compile_path(path: str) -> tuple[tuple[tuple[Step, ...], str | None], ...]:
    """The alternatives of a path (`a | b`), each as steps and, at its end, an attribute if it names one.

    Steps: /tag, //tag, *; tests [@a], [@a="v"], [contains(@a, "v")], [contains(text(), "v")], [2]. What isn't
    understood is a ValueError.
    """
    out = []
    for one in (x.strip() for x in path.split(" | ")):
        steps, attribute, at = [], None, 1 if one.startswith("./") else 0
        while at < len(one):
            m = _STEP.match(one, at)
            if not m or attribute:
                raise ValueError(f"{one!r} isn't understood from {one[at:]!r} on")
            if m[2]:
                attribute = m[3]
            else:
                tests = []
                for test in re.findall(r"\[([^\]]*)\]", m[4]):
                    kind = next(((k, *f.groups()) for k, p in _TESTS if (f := p.fullmatch(test.strip()))), None)
                    if kind is None:
                        raise ValueError(f"[{test}] isn't understood")
                    tests.append(kind)
                steps.append(Step(m[1] == "//", m[3].lower(), tuple(tests)))
            at = m.end()
        if not steps and attribute is None:
            raise ValueError(f"{path!r} has an empty path")
        out.append((tuple(steps), attribute))
    return tuple(out)


def _passes(tree: Tree, node: int, test: tuple[str, str, str]) -> bool:
    kind, name, value = test
    if kind == "text":
        return value in tree.text_of(node)
    got = tree.attributes[node].get(name)
    return got is not None and (kind == "has" or (got == value if kind == "is" else value in got))


def nodes_of(tree: Tree, steps: tuple[Step, ...], root: int = -1) -> list[int]:
    """The elements of a path inside root, in the order of the page."""
    now = [root]
    for step in steps:
        found: set[int] = set()
        for x in now:
            here = tree.inside(x, step.tag)
            kids = here if step.deep else [n for n in here if tree.parents[n] == x]
            for test in step.tests:
                if test[0] == "nth":  # the place among those of one parent
                    places: dict[int, int] = {}
                    picked = []
                    for n in kids:
                        places[tree.parents[n]] = places.get(tree.parents[n], 0) + 1
                        if places[tree.parents[n]] == int(test[1]):
                            picked.append(n)
                    kids = picked
                else:
                    kids = [n for n in kids if _passes(tree, n, test)]
            found.update(kids)
        now = sorted(found)
    return now


def values_of(tree: Tree, path: tuple, root: int = -1) -> list[str]:
    """Texts (or attributes) of the first alternative that finds any element."""
    for steps, attribute in path:
        found = nodes_of(tree, steps, root)
        if attribute is not None:
            found = [n for n in found if n >= 0 and attribute in tree.attributes[n]]
            if found:
                return [tree.attributes[n][attribute] for n in found]
        elif found:
            return [tree.text_of(n) for n in found]
    return []
