"""Adding to a snapshot: what is read again, and what is shuffled."""

import pytest

from kiln.operators import index as module
from kiln.operators.index import Index, IndexCatalog


def grown(spark, keep=False):
    rows = [(i, f"w{i % 7} common w{i % 3}" if i % 5 else "a") for i in range(40)]  # every fifth has no tokens
    d = spark.createDataFrame(rows, "doc_id long, text string")
    catalogue = IndexCatalog()
    catalogue.register("base", Index(d.where("doc_id % 3 = 0"), order_col="doc_id", keep=keep))
    counts = catalogue.add("base", d)
    return catalogue.get("base"), counts, rows


@pytest.mark.parametrize("known", [0, 1000])
@pytest.mark.parametrize("keep", [False, True])
def test_statistics_of_a_grown_index(spark, monkeypatch, keep, known):
    monkeypatch.setattr(module, "KNOWN_IDS", known)
    index, counts, rows = grown(spark, keep)
    have = sum(i % 3 == 0 and t != "a" for i, t in rows)
    assert tuple(counts.first()) == (40 - have, have)
    # Documents of the base without tokens are added again, as ever; they have no tokens then either.
    assert tuple(index.stats().first()) == (32, 32, 8)
    assert {r.term: r.df for r in index.vocab.collect()}["common"] == 32
    index.release()


def test_texts_are_neither_shuffled_nor_counted_for_the_vocabulary(spark):
    """index_catalogue: the ids that are known go to the texts, and tokens straight into the frequencies."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that aren't small
    try:
        index, _, _ = grown(spark)
        plan = index.vocab._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "sort_array" not in plan
    assert "InMemoryTableScan" in plan  # the base isn't cut into tokens again to know its ids
    index.release()
