"""Dense scores block by block, lines in several files, what a store keeps while it adds."""

import os
import tracemalloc

import numpy as np

from kiln.operators import dense
from kiln.operators.store import Store
from kiln.plans import queries


def test_best_of_blocks_as_of_all(monkeypatch):
    rng = np.random.default_rng(1)
    q, x = rng.integers(-2, 3, (7, 4)).astype("f8"), rng.integers(-2, 3, (300, 4)).astype("f8")  # many ties
    keys = rng.permutation(1000)[:300].astype("i8")
    for scores in (1, 50, 1 << 20):
        monkeypatch.setattr(dense, "SCORES", scores)
        best = dense.Best(7, 5)
        for a in range(0, 300, 90):
            best.add(keys[a : a + 90], x[a : a + 90], q)
        got = best.batch(np.arange(7) * 50).to_pydict()
        want = [(i * 50, int(k), -s) for i in range(7) for s, k in sorted(zip(-(x @ q[i]), keys))[:5]]
        assert sorted(zip(got["qid"], got["doc_id"], got["score"])) == sorted(want)


def test_blocks_bound_what_a_task_holds():
    x = np.random.default_rng(1).standard_normal((20_000, 8))
    best = dense.Best(1000, 10)
    tracemalloc.start()
    best.add(np.arange(20_000), x, x[:1000])  # 20 million scores, 160 MB
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()


def test_lines_are_written_by_several_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(queries, "scratch", lambda spark, name: str(tmp_path / name))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = queries.jsonl_scan(spark, "/root/testdata/sf0.001").count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert n == queries.documents(spark, "/root/testdata/sf0.001").count()
    assert sum(x.endswith(".txt") for x in os.listdir(tmp_path / "articles.jsonl")) > 1


def test_a_store_counts_rows_that_repeat_an_id_as_one(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "index"))
    index, told = store.add(spark.createDataFrame([(1, "aa bb"), (1, "aa"), (2, "aa")], "doc_id long, text string"))
    assert tuple(told.first()) == (3, 0)
    assert sorted((r.doc_id, r.term, r.tf) for r in index.tf.collect()) == [(1, "aa", 2), (1, "bb", 1), (2, "aa", 1)]
