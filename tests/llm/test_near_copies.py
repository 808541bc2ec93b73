import random

import numpy as np

from kiln.llm import simhash as sim


def shuffled_pairs(groups=40, n=60, seed=5):
    """Texts of the same words in different orders, so their fingerprints of words are equal; each with one near copy."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(n)]
    rows = []
    for g in range(groups):
        w = rng.sample(words, n)
        rows.append((g, " ".join(w)))
        w[0], w[1] = w[1], w[0]
        rows.append((g + groups, " ".join(w)))
    return rows


def test_large_buckets_lose_no_link(spark):
    rows = shuffled_pairs()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in sim.near_copies(df).collect()}
    assert got == {i: i % 40 for i, _ in rows}


def test_recall_of_blocks_and_short_texts(spark):
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]
    rows = []
    for _ in range(12):
        base = words(170)
        long = words(400)
        short = words(14)
        pairs = [(base, base + words(36)), (base, words(36) + base), (base, base[:142]), (base, base[28:]), (long, long + words(60)), (short, [*short[:-1], *words(1)])]
        for a, b in pairs:
            tag = f"t{len(rows)}"  # so that the pairs of one base share no shingle
            rows += [(len(rows), " ".join(w + tag for w in a)), (len(rows) + 1, " ".join(w + tag for w in b))]
    got = {r.doc_id: r.keep_id for r in sim.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}


def test_bucket_dealt_out_in_blocks(spark):
    rows = shuffled_pairs(30)
    df = spark.createDataFrame([(i, t, 1000 + i) for i, t in rows], "doc_id long, text string, mark long")
    keyed = spark.createDataFrame([(7, 1000 + i) for i, _ in rows], "key long, mark long")
    sketches = spark.createDataFrame([(1000 + i, sim.sketch(sim.min_hashes(sim.shingle_set(t), 96))) for i, t in rows], "mark long, sketch binary")
    links = sim.copy_links(df, keyed, sketches, 0.8, 5, 8).collect()
    assert {tuple(sorted((r.u - 1000, r.v - 1000))) for r in links} == {(g, g + 30) for g in range(30)}


def test_set_links_against_all_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(60, 40)).astype(np.uint64) for _ in range(10)]
    sets += [np.unique(np.append(s[3:], 99)).astype(np.uint64) for s in sets for _ in range(2)]
    n = len(sets)
    like = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8

    def roots(links):
        up = list(range(n))
        for i, j in links:
            a, b = up[i], up[j]
            up = [min(a, b) if x in (a, b) else x for x in up]
        return up

    want = roots([(i, j) for i in range(n) for j in range(i) if like(sets[i], sets[j])])
    assert len(set(want)) < n and roots(sim.set_links(sets, np.arange(n), np.zeros(n), False, 0.8)) == want


def test_star_group(spark):
    """Copies that are alike to one text, but not to each other: all are found, however many."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(8))
    base = [word() for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 500):
        t = list(base)
        for at in rng.sample(range(300), 6):
            t[at] = word()
        rows.append((i, " ".join(t)))
    sets = [set(sim.shingle_set(t).tolist()) for _, t in rows]
    like = [i for i in range(1, 500) if len(sets[i] & sets[0]) >= 0.8 * len(sets[i] | sets[0])]
    assert len(like) > 400
    got = {r.doc_id: r.keep_id for r in sim.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in like)
