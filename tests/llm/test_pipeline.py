import random

import corpus_pipeline as cp
from kiln.llm import simhash as sim
from kiln.llm.packing import PieceCoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mark string, keep_id int"


def jaccard(a, b, k=5):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    a, b = grams(a), grams(b)
    return len(a & b) / max(1, len(a | b))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "m", 3) for i, t in rows], DOCS)


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def tables(tmp_path, spark, seed=3):
    rng = random.Random(seed)
    bench = [(k, " ".join(words(rng, 30))) for k in range(5)]
    rows = []
    for i in range(240):
        w = words(rng, rng.randint(30, 200))
        if i % 12 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vilewort", "gruntfool"])
        rows.append((i, " ".join(w)))
    rows += [(300, rows[1][1]), (301, rows[1][1].replace(" ", "\n")), (302, rows[2][1]), (303, None), (304, ""), (None, rows[3][1]), (305, rows[5][1]), (305, rows[5][1])]
    edited = rows[7][1].split()
    edited[len(edited) // 2] = "changed"
    rows += [(310, " ".join(edited)), (311, rows[8][1] + " " + bench[0][1]), (312, bench[1][1])]
    labels = [(i, 1, int(i % 12 == 0)) for i in range(240) if i // 12 % 4]
    folder = str(tmp_path / "in")
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages(spark, tmp_path):
    folder, rows = tables(tmp_path, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, columns = {}, docs.columns
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            kept[name] = [r.doc_id for r in docs.collect()]
    toxic = {i for i in range(240) if i % 12 == 0}
    assert len(toxic & set(kept["toxicity"])) <= 3
    assert set(range(240)) - toxic <= set(kept["toxicity"])
    exact = kept["exact_dedup"]
    assert 1 in exact and not {300, 301, 302, 305, None} & set(exact) and len(exact) == len(set(exact))
    assert len({303, 304} & set(exact)) == 1
    near = kept["simhash"]
    assert 7 in near and 310 not in near and set(exact) - set(near) == {310}
    clean = kept["decontamination"]
    assert set(near) - set(clean) == {311, 312}
    P = __import__("public_tokenizers")
    texts = {r.doc_id: r.text for r in docs.collect()}
    coder = PieceCoder(P.path("byte_bpe_50k.json"))
    pieces = stage(spark, docs, folder).collect()
    assert sum(r.length for r in pieces) == sum(len(coder.encode([t or ""])[0]) + 1 for t in texts.values())


def test_run_equals_stages_and_empty_tables(spark, tmp_path):
    folder, _ = tables(tmp_path, spark, 9)
    assert cp.run(spark, folder).count() > 0
    empty = frame(spark, [])
    for _, stage in cp.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(25):
        base = words(rng, rng.randint(60, 250))
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 50)):
                w[rng.randrange(len(w))] = "".join(rng.choice("xyz") for _ in range(6))
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "one"), (904, "one two")]
    got = {r.doc_id: r.keep_id for r in sim.near_copies(frame(spark, rows)).collect()}
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if i < j and a and b and jaccard(a, b) >= 0.8:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    missed = [i for i, _ in rows if got[i] != root(i)]
    assert len(missed) <= 2 and all(got[i] == i or got[i] == root(i) or root(got[i]) == root(i) for i, _ in rows)
    assert got[900] == 900 and got[901] == 901 and got[903] == 902
