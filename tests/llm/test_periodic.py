import random
import time
import zlib

import numpy as np
import pytest

from kiln.llm import periodic
from kiln.llm.periodic import _scan, match_counts, periodic_runs, runs_of
from tests.llm.brute import sha

DOCS = "doc_id long, text string, runs string, n_words int, start int, period int, collapsed string, lang string"


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def brute(w, least=12):
    """From the definition: every maximal stretch with period q whose smallest period that is."""
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q) and smallest_period(w[i : j + q]) == q:
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def samples(seed):
    rng = random.Random(seed)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 50, list("ab") * 6, list("ab") * 5 + ["a"], list("abcabd") * 5]
    for _ in range(40):
        w = [rng.choice("abc"[: rng.randint(1, 3)] if rng.random() < 0.5 else "abcdefghijklmnop") for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            p = rng.randint(1, 12)
            unit = [rng.choice("abcd") for _ in range(p)]
            at = rng.randint(0, len(w))
            w[at:at] = (unit * 12)[: rng.randint(p, min(12 * p, 60))]
        out.append(w)
    a, b = ["a"], ["a", "b"]
    for _ in range(9):
        a, b = b, b + a  # Fibonacci words have many runs
    return [*out, b]


def numbered(texts):
    number, keys = {}, []
    for d, w in enumerate(texts):
        keys += [number.setdefault((d, x), len(number)) for x in w]
    return np.array(keys, "i8"), np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype("i8")


@pytest.mark.parametrize("heavy", [None, "all", "none"])
@pytest.mark.parametrize("grid", [48, 12])
def test_runs_against_definition(monkeypatch, heavy, grid):
    if heavy:
        monkeypatch.setattr(periodic, "_heavy", lambda c, n: np.full(len(c), heavy == "all"))
    monkeypatch.setattr(periodic, "GRID_FROM", max(grid, 16))
    for seed in range(4):
        texts = samples(seed)
        assert runs_of(*numbered(texts)) == [brute(w) for w in texts]


@pytest.mark.parametrize("block", [1 << 21, 3])
def test_counts_are_exact_for_both_kinds_of_words(monkeypatch, block):
    monkeypatch.setattr(periodic, "BLOCK", block)
    rng = np.random.default_rng(1)
    texts = [rng.zipf(1.5, n).clip(max=60).tolist() for n in (0, 1, 2, 300, 3000)]
    keys, starts = numbered(texts)
    counts, base = match_counts(keys, starts)
    sizes = np.unique(keys[starts[4] :], return_counts=True)[1]
    assert 0 < periodic._heavy(sizes, np.full(len(sizes), 3000)).sum() < len(sizes)
    for d, w in enumerate(texts):
        w = np.array(w)
        for q in range(1, len(w) // 2 + 1):
            assert counts[base[d] + q] == (w[:-q] == w[q:]).sum()


def test_grid_finds_every_long_island():
    rng = np.random.default_rng(2)
    for lag in (48, 50, 63, 64, 100, 333):
        for _ in range(30):
            same = rng.random(2000) < 0.9
            for _ in range(3):
                a = rng.integers(0, 1500)
                same[a : a + rng.integers(lag - 3, 2 * lag)] = True
            keys = np.arange(2000 + lag)
            for i in np.flatnonzero(same):
                keys[i + lag] = keys[i]
            first, length = _scan(keys, lag, lag)
            want = periodic._islands(keys[:-lag] == keys[lag:], lag)
            assert first.tolist() == want[0].tolist() and length.tolist() == want[1].tolist()


def test_rows_of_any_kind(spark):
    texts = [None, "", " \n\t", "a " * 12, "x y " * 7 + "é " * 20, "no run here at all", "one\x0btwo\x0cthree\r" * 5, "a b " * 13]
    rows = [(i if i != 3 else None, t, "x", 1, 2, 3, "y", "en") for i, t in enumerate(texts)] * 2
    got = periodic_runs(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        w = (texts[3 if r.doc_id is None else r.doc_id] or "").encode().split()
        w = [x.decode() for x in w]
        assert [(x.start, x.length, x.period) for x in r.runs] == brute(w) and r.n_words == len(w)
        assert r.collapsed == collapse(w, brute(w))
    assert periodic_runs(spark.createDataFrame([], DOCS)).collect() == []


def test_very_long_texts_of_few_words():
    rng = np.random.default_rng(3)
    took = []
    for w in ([0] * 400_000, rng.integers(0, 2, 400_000), np.tile(rng.integers(0, 9, 1000), 400)):
        start = time.time()
        runs_of(np.asarray(w, "i8"), np.array([0, len(w)]))
        took.append(time.time() - start)
    assert max(took) < 30, took


def contract(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(collapse(w, runs)))


def test_query_contract(spark, tmp_path):
    from kiln.llm.queries import op13_periodic_runs

    rng = random.Random(5)
    rows = [(i, None if i % 31 == 0 else " \n".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([0, 1, 5, 30, 90])))) for i in range(400)]
    rows += [(1000 + i, " ".join(w)) for i, w in enumerate(samples(7))]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 20
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_periodic_runs(spark, str(tmp_path)).collect()
    want = {i: contract(i, t) for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want[r.doc_id], r
