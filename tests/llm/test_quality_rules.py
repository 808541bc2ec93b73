import random
import re
from collections import Counter

import pytest

from kiln.llm import quality_rules as q

DOCS = "doc_id long, text string, source string, host long, content string, row int, lines string, kept boolean, removed int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "c", 2, "l", False, 3) for i, t, s in rows], DOCS).repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def norm(line):
    return re.sub("[1-9]", "0", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in " ".join(words(line))))


def brute(rows, limits):
    seen, texts = {}, {}
    for _, t, s in rows:
        texts.setdefault(s, set()).add(t or "")
        for line in (t or "").split("\n"):
            if words(line):
                seen.setdefault((s, norm(line)), set()).add(t)
    bad = {k for k, v in seen.items() if len(v) > limits.documents and len(v) > limits.share * len(texts[k[0]])}
    out = []
    for i, t, s in rows:
        t = t or ""
        w = words(t)
        lines = t.split("\n")
        real = [x for x in lines if words(x)]
        wins = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if wins[tuple(w[k : k + 3])] > 1 for j in range(3)}
        removed = [k for k, x in enumerate(lines) if words(x) and (s, norm(x)) in bad]
        gone = sum(len(words(lines[k])) for k in removed)
        failed = len(w) < limits.words or len(hit) > limits.repeated * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(real) - len(set(real)), len(hit), failed, not failed and gone <= limits.depleted * len(w), gone, removed, "\n".join(x for k, x in enumerate(lines) if k not in removed)))
    return out


COLS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words", "removed"]


def sample(seed, n=120):
    rng = random.Random(seed)
    shared = ["Cookie  policy 2024", "all rights reserved #1", "é menu | home", "subscribe now", " "]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            x = rng.random()
            if x < 0.5:
                line = rng.choice(shared)
                line = line.upper() if rng.random() < 0.3 else line.replace("4", str(rng.randint(1, 9)))
            else:
                line = " ".join(rng.choice(["the", "of", "ö", "$5", "word", str(rng.random())]) for _ in range(rng.randint(0, 12)))
            lines.append(line + rng.choice(["", "\r", " "]))
        rows.append((i, "\n".join(lines) if rng.random() < 0.95 else None, rng.choice(["a", "a", "a", "b", None])))
    return rows


@pytest.mark.parametrize("limits", [q.Limits(3, 0.1, 5, 0.6, 0.4), q.Limits(1, 0.0, 1, 0.9, 0.9), q.Limits()])
@pytest.mark.parametrize("broadcast", [q.BROADCAST_LINES, 2, 0.5])
def test_verdicts_against_brute_force(spark, limits, broadcast):
    rows = sample(1) + [(500, "same text\nand more", "a")] * 5 + [(None, "subscribe now\nno id", "a")] * 2 + [(600, "subscribe now", "a"), (601, "subscribe now", "a")]
    got = q.judged(docs(spark, rows), limits, broadcast_lines=broadcast if broadcast >= 1 else 1).select(COLS).collect()
    want = [tuple(x[:-1]) for x in brute(rows, limits)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_repeat_words_of_texts_side_by_side():
    texts = [b"a b c a b c".split(), b"a b c".split(), [], b"a".split(), b"a a a a".split(), b"x y z w x y z".split(), b"c a b".split()]
    assert q.repeat_words(texts).tolist() == [6, 0, 0, 0, 4, 6, 0]
    assert q.repeat_words([]).tolist() == [] and q.repeat_words([[b"a"]]).tolist() == [0]


def test_cleaned_texts(spark):
    limits = q.Limits(3, 0.1, 2, 0.8, 0.5)
    rows = sample(2) + [(7, "subscribe now\nbut also some more words", "a")] * 2 + [(None, "subscribe now\nanother one without an id", "a")]
    got = q.cleaned(docs(spark, rows), limits)
    assert got.columns == docs(spark, []).columns
    want = [(i, t if not x[9] else x[10], s) for (i, t, s), x in zip(rows, brute(rows, limits)) if x[7]]
    assert any(x[9] and x[7] for x in brute(rows, limits))
    assert sorted(map(repr, ((r.doc_id, r.text, r.source) for r in got.collect()))) == sorted(map(repr, want))


def test_empty_table_and_long_text(spark):
    assert q.judged(docs(spark, [])).collect() == [] and q.cleaned(docs(spark, [])).collect() == []
    long = " ".join(str(i) for i in range(300_000)) + "\nx" * 1000
    (r,) = q.judged(docs(spark, [(1, long, None)])).collect()
    assert (r.n_words, r.n_dup_lines, r.n_repeat_words, r.kept) == (301_000, 999, 1000, True)


def test_a_line_of_all_documents_of_a_host(spark):
    rows = [(i, f"the common line of this host\n{' '.join('abcdefghij'[i % 10] * (i + 1) + 'xy' * k for k in range(60 if i % 2 else 5))}", "big") for i in range(300)]
    got = {r.doc_id: r for r in q.judged(docs(spark, rows)).collect()}
    assert all(r.n_removed_words == 6 and r.removed == [0] and r.kept == bool(i % 2) for i, r in got.items())
    strict = {r.doc_id: r.kept for r in q.judged(docs(spark, rows), q.Limits(words=0)).collect()}
    assert strict == {i: bool(i % 2) for i in range(300)}  # depleted
