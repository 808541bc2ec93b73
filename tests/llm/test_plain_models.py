"""The learned operators beside plain versions of their formulas."""

import math
import zlib

import numpy as np
import pytest

from kiln.llm import language_id as lang
from kiln.llm import toxicity


def plain_trigrams(text):
    """Codes of letter trigrams, letter by letter; whatever stands between letters is one blank."""
    table, out = lang._letter_codes(), [0]
    for c in (text or "").lower():
        x = int(table[ord(c)])
        if x or out[-1]:
            out.append(x)
    if out[-1]:
        out.append(0)
    return [(out[i], out[i + 1], out[i + 2]) for i in range(len(out) - 2)]


def plain_bundle(text, dim):
    _, _, base = lang._letter_vectors(dim)
    total = np.zeros(dim)
    for a, b, c in plain_trigrams(text):
        total += np.roll(base[a].astype(float), 2) * np.roll(base[b].astype(float), 1) * base[c]
    return total


@pytest.mark.parametrize("dim", [64, lang.DIM])
def test_language_prediction(spark, dim):
    texts = ["the cat and the hat", "le chat et la souris", "der Hund und die Katze", "el gato y el perro", "thé", "", None, "12 !?", "und the le"]
    names = ["en", "fr", "de", "es", "fr", "en", "de", None, None]
    rows = [(i, texts[i % 9] if texts[i % 9] is None else texts[i % 9] + " " * (i // 9) + "xyz"[: i // 9], names[i % 9]) for i in range(36)]
    sums = {}
    for i, t, name in rows:
        if name and zlib.crc32(str(i).encode()) % 3 != 1:
            sums[name] = sums.get(name, 0) + plain_bundle(t, dim)
    got = {r.doc_id: r for r in lang.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dim).collect()}
    for i, t, _ in rows:
        v = plain_bundle(t, dim)
        cos = {k: v @ p / max(np.linalg.norm(v), 1e-9) / np.linalg.norm(p) for k, p in sums.items()}
        best = max(sorted(cos), key=lambda k: round(cos[k], 5))
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        else:
            assert abs(got[i].score - max(0, cos[best])) < 1e-4 and abs(cos[got[i].lang_pred] - cos[best]) < 1e-4
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def plain_fit(positive, unlabelled, prior, least_z, decay=1e-3, rate=0.05, steps=600):
    """Non-negative risk as it is written down, its slope by differences, and Adam; all documents in each step."""
    share = lambda rows, f: sum(f in set(r) for r in rows)
    weights = {}
    for f in sorted({x for r in [*positive, *unlabelled] for x in r}):
        a, b, p, u = share(positive, f), share(unlabelled, f), len(positive), len(unlabelled)
        pool = (a + b + 1) / (p + u + 2)
        if abs((a / p - b / u) / math.sqrt(pool * (1 - pool) * (1 / p + 1 / u))) >= least_z and a + b >= 3:
            weights[f] = min(3.0, max(-3.0, math.log((a + 0.5) / (p + 1) * (u + 1) / (b + 0.5))))
    used = list(weights)
    x = lambda rows: np.array([[sum(f == y for y in r) * weights[f] * (len(r) + 50.0) ** -0.25 for f in used] + [1.0] for r in rows])
    xp, xu = x(positive), x(unlabelled)
    log1p = lambda g: np.log1p(np.exp(g)).mean()
    turned = 0

    def objective(t, sign):
        rest = log1p(xu @ t) - prior * log1p(xp @ t)
        risk = prior * log1p(-(xp @ t)) + rest if sign > 0 else -rest
        return risk + decay / 2 * (t[:-1] ** 2).sum()

    t, m, v = np.zeros(len(used) + 1), 0.0, 0.0
    t[-1] = math.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        sign = 1 if log1p(xu @ t) - prior * log1p(xp @ t) >= 0 else -1
        turned += sign < 0
        slope = np.array([(objective(t + e, sign) - objective(t - e, sign)) / 2e-5 for e in np.eye(len(t)) * 1e-5])
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        t = t - rate * math.sqrt(1 - 0.999**step) / (1 - 0.9**step) * m / (np.sqrt(v) + 1e-8)
    return {f: t[i] * weights[f] for i, f in enumerate(used)}, t[-1], turned


@pytest.mark.parametrize("prior", [0.05, 0.2, 0.7])
def test_risk_of_positive_and_unlabelled_documents(prior):
    """prior 0.7 is far above the share of positives among the unlabelled, so that the negative part falls below zero."""
    rng = np.random.default_rng(3)
    toxic = lambda: rng.choice([1, 2, 3, 8, 9], rng.integers(2, 6)).astype("<u4")
    clean = lambda: rng.choice([4, 5, 6, 7, 8, 9], rng.integers(2, 6)).astype("<u4")
    positive = [toxic() for _ in range(25)]
    unlabelled = [toxic() if i % 8 == 0 else clean() for i in range(60)]
    made = toxicity.fit_nnpu(positive, unlabelled, prior, least_z=1.5)
    weights, bias, turned = plain_fit(positive, unlabelled, prior, 1.5)
    assert (turned > 0 or prior < 0.7) and len(weights) >= 3
    assert abs(made.bias - bias) < 0.02
    for f, w in weights.items():
        assert abs(float(made.weights[f]) - w) < 0.02
    assert np.count_nonzero(made.weights) == len(weights)
