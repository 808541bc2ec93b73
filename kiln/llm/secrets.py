"""Secret scans: three fixed patterns, and sliding-window entropy per character class over candidate strings."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import text_or_empty

#: The patterns of the three kinds, in the order in which they are listed.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
#: The same matches after the length rule: hex and access runs are maximal, so the bound can stand in the pattern.
#: That of assign can't (a failing match still uses up its characters); its group is measured afterwards.
SCANNED = {"assign": PATTERNS["assign"], "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: What a match must be so that it can pass; a cheap test before the text is cut up.
GUARDS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Window in characters, and per class: alphabet, least entropy in bits per character of its best window. Of random strings
#: of one window, each bound takes 96 to 98 % (hex 0.97, letters of one case and digits 0.98, all 0.97).
WINDOW = 20
_UPPER, _DIGITS = string.ascii_uppercase, string.digits
CLASSES = {
    "hex": (_DIGITS + "abcdef", 3.0),
    "upper hex": (_DIGITS + "ABCDEF", 3.0),
    "lower": (_UPPER.lower() + _DIGITS, 3.5),
    "upper": (_UPPER + _DIGITS, 3.4),
    "base64": (_UPPER + _UPPER.lower() + _DIGITS + "+/_=-", 3.7),
}
#: Candidates that are no secrets: one character class only (words, numbers), words with single separators, well-known samples.
ALLOW = r"^[A-Za-z]+$|^[0-9]+$|^[-_=+/]+$|^(?=[A-Za-z])(?!.*[-_/]{2})[A-Za-z/_-]*[A-Za-z]$|(?i:example|placeholder|changeme|lorem)"


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with name bound to value, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _spans(text: str, pattern: str, run: int = 128) -> str:
    """SQL: array of (start, end, match) in code points, leftmost and not overlapping.

    split() gives what stands between the matches, so starts follow by adding up lengths: first those of runs of
    matches, then within each run from where it begins. So the work doesn't grow with the square of the matches.
    """
    p = _sql(pattern)
    parts = _let(f"regexp_extract_all({text}, {p}, 0)", "found", f"transform(arrays_zip(slice(split({text}, {p}), 1, size(found)), found), z -> named_struct('gap', length(z['0']), 'm', z['found']))")
    runs = f"transform(sequence(0, greatest((size(parts) - 1) div {run}, 0)), c -> slice(parts, cast(c * {run} + 1 as int), {run}))"
    begins = "aggregate(transform(runs, r -> aggregate(r, 0, (a, z) -> a + z.gap + length(z.m))), array(0), (acc, t) -> concat(acc, array(element_at(acc, -1) + t)))"
    within = "aggregate(r, named_struct('at', begins[k], 'out', cast(array() as array<struct<s:int,e:int,m:string>>)), (a, z) -> named_struct('at', a.at + z.gap + length(z.m), 'out', concat(a.out, array(named_struct('s', a.at + z.gap, 'e', a.at + z.gap + length(z.m), 'm', z.m)))), a -> a.out)"
    return _let(parts, "parts", _let(runs, "runs", _let(begins, "begins", f"flatten(transform(runs, (r, k) -> {within}))")))


def _class_of(alphabet: str) -> str:
    return "[" + "".join("\\" + c if c in "-]^[&" else c for c in alphabet) + "]"


def _has_entropy(text: str, alphabet: str, least: float, window: int) -> str:
    """SQL: whether some window of text, all of one class, has at least this Shannon entropy; by incremental counts.

    The entropy of a window of n characters with counts c is log2(n) - sum(c * log2(c)) / n, so the least sum of all
    windows decides. A step takes the character that enters and the one that leaves, and adds what their two counts change
    in the sum, which is held in units of 2**-40, so that nothing is rounded on the way. Counts are bytes, eight to a long.
    Characters are looked up once, so the work is a constant for each character.
    """
    if not 1 < window < 128:
        raise ValueError("a window has 2 to 127 characters")
    gains = [round(c * math.log2(c) * 2**40) if c else 0 for c in range(window + 1)]
    table = "array(" + ", ".join(f"{g}L" for g in gains) + ")"
    bound = round(window * (math.log2(window) - least) * 2**40) + 1024
    codes = f"transform(split({text}, ''), x -> instr('{alphabet}', x))"
    both = f"transform(codes, (x, i) -> x + 256 * if(i >= {window}, codes[i - {window}], 0))"
    count = lambda k: f"(shiftright(a.c[shiftright({k} - 1, 3)], 8 * (({k} - 1) & 7)) & 255L)"
    one = lambda k: f"if({k} > 0 and j = shiftright({k} - 1, 3), shiftleft(1L, 8 * (({k} - 1) & 7)), 0L)"
    x, y = "(z & 255)", "shiftright(z, 8)"
    counts = f"if({x} = {y}, a.c, transform(a.c, (v, j) -> v + {one(x)} - {one(y)}))"
    gain = lambda k, d: f"if({k} > 0, {table}[cast({count(k)} as int) + {d}] - {table}[cast({count(k)} as int)], 0L)"
    best = f"if(a.n = {window}, least(a.best, a.s), a.best)"
    step = f"named_struct('c', {counts}, 'n', a.n + if({x} > 0, 1, 0) - if({y} > 0, 1, 0), 's', a.s + if({x} = {y}, 0L, {gain(y, -1)} + {gain(x, 1)}), 'best', {best})"
    zero = f"named_struct('c', array_repeat(0L, {-(-len(alphabet) // 8)}), 'n', 0, 's', 0L, 'best', {2**62}L)"
    least_sum = _let(codes, "codes", f"aggregate({both}, {zero}, (a, z) -> {step}, a -> {best})")
    return f"({text} rlike {_sql(_class_of(alphabet) + '{' + str(window) + '}')} and {least_sum} <= {bound}L)"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, classes: dict = CLASSES, allow: str = ALLOW) -> DataFrame:
    """(doc_id, text, assign, access, hex, entropy): arrays of (s, e, m) in code points, end exclusive."""
    if any("'" in a or "\\" in a for a, _ in classes.values()):
        raise ValueError("an alphabet may not hold quotes or backslashes")
    out = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    empty = "cast(array() as array<struct<s:int,e:int,m:string>>)"
    keep = {"assign": f"length(regexp_extract(x.m, {_sql(PATTERNS['assign'])}, 1)) >= 6", "access": "true", "hex": "true"}
    cols = {k: F.expr(f"if(text rlike {_sql(GUARDS[k])}, filter({_spans('text', p)}, x -> {keep[k]}), {empty})") for k, p in SCANNED.items()}
    tests = " or ".join(_has_entropy("x.m", alphabet, least, window) for alphabet, least in classes.values())
    cols["entropy"] = F.expr(f"if(text rlike {_sql(CANDIDATE)}, filter({_spans('text', CANDIDATE)}, x -> not x.m rlike {_sql(allow)} and ({tests})), {empty})")
    return out.select("doc_id", "text", *(c.alias(k) for k, c in cols.items()))


def _listed(kinds: list[str]) -> Column:
    each = ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'k', {i}, 't', concat('{k}:', x.s, ':', x.e)))" for i, k in enumerate(kinds))
    return F.expr(f"array_join(transform(array_sort(concat({each})), x -> x.t), ',')")


def secret_scan(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Base spans are those of the three patterns, whole matches, in code points. Spans holds them and those of kind
    entropy: candidates of 20 characters or more, of which some window has the entropy of a random string in one
    of the classes, unless the allow-list covers them. Null text is empty; no spans give the hash of '' and ''.
    Repeated rows, null ids and other columns need no special care: each row is judged alone. The work grows with the
    length of a text, also of one candidate of a million characters.
    """
    found = find_spans(docs, **options)
    kinds = [*PATTERNS, "entropy"]
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS), F.sha2(_listed(list(PATTERNS)).cast("binary"), 256).alias("base_sha256"), _listed(kinds).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", **options) -> DataFrame:
    """(doc_id, text): every span, overlaps merged, replaced by mask. Null text is empty; repeated rows and null ids stay."""
    found = find_spans(docs, **options)
    spans = ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'e', x.e))" for k in [*PATTERNS, "entropy"])
    merged = f"aggregate(array_sort(concat({spans})), named_struct('at', 0, 'out', cast(array() as array<string>)), (a, x) -> if(x.e <= a.at, a, named_struct('at', x.e, 'out', if(x.s >= a.at, concat(a.out, array(substring(text, a.at + 1, x.s - a.at), '{mask}')), a.out))), a -> concat(array_join(a.out, ''), substring(text, a.at + 1)))"
    return found.select("doc_id", F.expr(merged).alias("text"))
