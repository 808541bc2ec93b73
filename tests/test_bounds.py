"""Ranked search by rows: bounds of norms where terms are rare, the same rows as by joins."""

import random

import pytest

from kiln.operators import index as ix
from kiln.operators import ranked
from kiln.operators.index import Index


def rows(df):
    return sorted((r.qid, r.rank, r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("normalize", [True, False])
@pytest.mark.parametrize(("hot", "scores"), [(0, 1), (5, 100), (20, 1 << 21), (500_000, 7)])
def test_the_same_rows_as_by_joins_whatever_is_known(spark, monkeypatch, hot, scores, normalize):
    rng = random.Random(4)
    names = [f"w{int(rng.paretovariate(0.5))}" for _ in range(3000)]
    texts = [" ".join(rng.choices(names, k=rng.randrange(1, 40))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:30] + ["", None])), "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(rng.choices(names, k=4))) for i in range(20)] + [(20, "unheard"), (21, "")], "qid long, text string")
    with monkeypatch.context() as plain:
        plain.setattr(Index, "rows_by_document", lambda self: None)
        want = rows(ranked.search(Index(docs, order_col="doc_id"), asked, 6, normalize))
    monkeypatch.setattr(ix, "HOT_TERMS", hot)
    monkeypatch.setattr(ranked, "SCORES", scores)
    index = Index(docs, order_col="doc_id", keep=True)
    assert rows(ranked.search(index, asked, 6, normalize)) == want and len(want) > 100
    index.release()
    assert not index._made


def test_scores_are_made_without_a_shuffle_of_pairs(spark):
    docs = spark.createDataFrame([(i, f"aa bb w{i}") for i in range(50)] + [(50, "cc")], "doc_id long, text string")
    got = ranked.search(Index(docs, order_col="doc_id"), spark.createDataFrame([(1, "aa w7")], "qid long, text string"), 3)
    assert [r.doc_id for r in got.orderBy("rank").collect()] == [7, 0, 1]
    assert "hashpartitioning(doc_id" not in got._jdf.queryExecution().executedPlan().toString()


def test_rows_that_are_one_document_are_added_up(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "aa"), (2, "aa"), (3, "cc")], "doc_id long, text string")
    got = ranked.search(Index(docs, order_col="doc_id"), spark.createDataFrame([(1, "bb aa")], "qid long, text string"), 3)
    assert [(r.doc_id, r.rank) for r in got.orderBy("rank").collect()] == [(1, 1), (2, 2)]
