import hashlib
import random

import pytest

from kiln.llm import bwt
from kiln.llm import substring_dedup as sub

DOCS = "doc_id long, text string, doc long, tie int, spans string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], DOCS)


def check_transform(strings):
    want = sorted((s[len(s) - n :] for s in strings for n in range(len(s) + 1)))
    got = [x for block in bwt.build(strings) for x in zip(*(a.tolist() for a in block), strict=True)]
    assert len(got) == len(want)
    last = None
    for (i, n, common), suffix in zip(got, want, strict=True):
        assert strings[i][len(strings[i]) - n :] == suffix
        if last is not None:
            k = next((k for k, (a, b) in enumerate(zip(last, suffix, strict=False)) if a != b), min(len(last), len(suffix)))
            assert common == k
        last = suffix


@pytest.mark.parametrize("block", [3, 64])
def test_transform_against_sorting(monkeypatch, block):
    monkeypatch.setattr(bwt, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(15):
        check_transform([bytes(rng.choice(b"ab\xff\x00") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 12))])
    check_transform([b"aaaaaaaaaa"] * 5)
    check_transform([b"ab" * 160, b"ab" * 160, b"b" * 300])  # prefixes beyond a byte
    assert list(bwt.build([])) == []


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = [True] * length
            seen.add(b[k : k + length])
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(left).hexdigest())
    return out


def corpus(seed, n=36):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdefé ") for _ in range(rng.randint(90, 400))) for _ in range(6)]
    rows = []
    for i in range(n):
        t = "".join(rng.choice([rng.choice(passages), rng.choice(passages)[rng.randint(0, 50) : rng.randint(60, 300)], "".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 150)))]) for _ in range(rng.randint(0, 6)))
        rows.append((i * 7 % n, t))
    return rows + [(500, None), (501, ""), (502, "x" * 1000), (503, "ab" * 400), (504, "y" * 99), (505, "y" * 100), (506, "y" * 101), (507, rows[3][1]), (508, rows[3][1]), (None, rows[5][1] + "tail" * 40)]


@pytest.mark.parametrize(("length", "hot", "block"), [(100, 2000, 1 << 17), (100, 2, 1 << 17), (100, 2000, 300), (40, 3, 128), (256, 2000, 1 << 17), (300, 2, 1 << 17)])
def test_substring_dedup_against_brute_force(spark, monkeypatch, length, hot, block):
    monkeypatch.setattr(sub, "BLOCK", block)
    monkeypatch.setattr(sub, "COLLECTION", 400)
    rows = corpus(length + hot)
    got = sub.substring_dedup(docs(spark, rows).repartition(3), length=length, hot=hot, with_text=True).collect()
    want = brute(rows, length)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_substring_dedup_repeated_rows_and_empty(spark):
    t = "".join(chr(97 + i * i % 26) for i in range(150)) * 1
    got = sub.substring_dedup(docs(spark, [(1, t), (1, t), (2, t)])).collect()
    removed = sorted((r.doc_id, r.n_removed) for r in got)
    assert removed[0] == removed[1] and removed[2] == (2, 150)
    assert sub.substring_dedup(docs(spark, [])).count() == 0


def test_hot_stretch_in_many_contents(spark):
    """A line that stands in many documents, between other words each time, with collections cut inside and between keys."""
    rng = random.Random(6)
    line = "".join(rng.choice("abcdefghij ") for _ in range(140))
    other = lambda n: "".join(rng.choice("klmnopqrst ") for _ in range(n))
    rows = [(i, other(rng.randint(0, 120)) + line + other(rng.randint(0, 120))) for i in range(600)]
    want = brute(rows, 100)
    for hot in (2000, 20):
        got = sub.substring_dedup(docs(spark, rows).repartition(5), hot=hot).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_lengths_out_of_bounds(spark):
    for length in (7, 1 << 16):
        with pytest.raises(ValueError, match="length"):
            sub.substring_dedup(docs(spark, []), length=length)
