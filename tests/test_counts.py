"""Counts inside rows, weights with few broadcast terms, snapshots that share counts."""

import math
from collections import Counter

import pytest

from kiln.operators import index as ix
from kiln.operators.index import Index, weights

TEXTS = ["bb aa bb cc", "cc", "", None, "http://x.y/z aa zz zz zz", "yy"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_counts_are_made_without_a_shuffle(docs):
    index = Index(docs, order_col="doc_id")
    got = {(r.doc_id, r.term): r.tf for r in index.tf.collect()}
    assert got == {(i, t): n for i, x in enumerate(TEXTS) for t, n in Counter((x or "").split()).items()}
    assert "Exchange" not in plan(index.tf)


def test_rows_that_repeat_id_and_order_are_one_document(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "aa"), (2, "aa")], "doc_id long, text string")
    index = Index(docs, order_col="doc_id", keep=True)
    assert sorted((r.doc_id, r.term, r.tf) for r in index.tf.collect()) == [(1, "aa", 2), (1, "bb", 1), (2, "aa", 1)]
    assert index.n_docs == 3 and {r.term: r.df for r in index.vocab.collect()} == {"aa": 2, "bb": 1}
    index.release()


@pytest.mark.parametrize("most", [0, 1, 2, 1000])
def test_weights_whatever_is_broadcast(docs, monkeypatch, most):
    monkeypatch.setattr(ix, "HOT_TERMS", most)
    index = Index(docs, order_col="doc_id")
    df = Counter(t for x in TEXTS for t in set((x or "").split()))
    want = {(i, t): (1 + math.log10(n)) * math.log10(4 / df[t]) for i, x in enumerate(TEXTS) for t, n in Counter((x or "").split()).items()}
    got = weights(index.tf, index.vocab)
    assert {(r.doc_id, r.term): r.weight for r in got.collect()} == pytest.approx(want)
    assert most < 1000 or "SortMergeJoin" not in plan(got)


def test_a_grown_snapshot_keeps_the_counts_of_the_first(docs, spark):
    first = Index(docs.where("doc_id < 3"), order_col="doc_id", keep=True)
    grown, told = first.add(docs)
    assert tuple(told.first()) == (4, 2) and "fresh" in grown._made
    assert {(r.doc_id, r.term, r.tf) for r in grown.tf.collect()} == {(r.doc_id, r.term, r.tf) for r in Index(docs, order_col="doc_id").tf.collect()}
    assert "regexp_extract_all" not in plan(grown.bags).split("InMemoryTableScan")[0]
    grown.release(), first.release()


def test_the_vocabulary_and_its_sizes_come_from_one_pass_without_counts(docs):
    """doc_freq, index_stats: no counts by document are made or kept for them."""
    index = Index(docs, order_col="doc_id", keep=True)
    assert tuple(index.stats().first()) == (4, 4, 6)
    assert {r.term: r.df for r in index.vocab.select("term", "df").collect()} == {"aa": 2, "bb": 1, "cc": 2, "http://x.y/z": 1, "zz": 1, "yy": 1}
    assert "bags" not in index._made
    index.release()


@pytest.mark.parametrize(("rows", "order", "want"), [([(1, "aa bb"), (1, "aa")], None, (2, 1, 2)), ([(1, "aa"), (1, "bb"), (None, "cc")], "doc_id", (3, 1, 3)), ([(1, ""), (1, "aa")], "doc_id", (1, 1, 1)), ([], "doc_id", (0, 0, 0))])
def test_sizes_of_rows_without_an_id_or_of_one_id(spark, rows, order, want):
    index = Index(spark.createDataFrame(rows, "doc_id long, text string"), order_col=order)
    assert tuple(index.stats().first()) == want
    assert index.n_docs == want[0] and index.vocab.count() == want[2]


def test_weights_of_terms_of_one_document_need_no_shuffle(docs, monkeypatch):
    """doc_norms: the frequent terms are aa and cc, all others are in one document."""
    monkeypatch.setattr(ix, "HOT_TERMS", 2)
    index = Index(docs, order_col="doc_id", keep=True)
    index.vocab.count()
    held = plan(weights(index.tf, index.vocab)).split("InMemoryTableScan")[0]
    assert "hashpartitioning" not in held and "Union" not in held and "SortMergeJoin" not in held
    index.release()
