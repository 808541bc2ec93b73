import random

import pytest

from kiln.operators import boolean
from kiln.operators.index import Index


def index_of(spark, n=200):
    rng = random.Random(1)
    texts = [" ".join(rng.sample(["ax", "bx", "cx", "dx", "ex", "fx"], rng.randint(0, 5))) for _ in range(n)]
    return texts, Index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), order_col="doc_id", keep=True)


def queries(n):
    rng = random.Random(2)

    def tree(depth):
        x = rng.random()
        if depth == 0 or x < 0.25:
            return rng.choice(["ax", "bx", "cx", "dx", "ex", "nosuch"])
        return f"NOT {tree(depth - 1)}" if x < 0.4 else f"({tree(depth - 1)} {rng.choice(['AND', 'OR'])} {tree(depth - 1)})"

    return {i: tree(4) for i in range(n)}


def plain(texts, text):
    """The documents of a query, by sets."""
    every = {str(i) for i, t in enumerate(texts) if t}

    def go(node):
        if node.kind == "TERM":
            return {str(i) for i, t in enumerate(texts) if node.term in t.split()}
        args = [go(a) for a in node.args]
        return every - args[0] if node.kind == "NOT" else args[0] & args[1] if node.kind == "AND" else args[0] | args[1]

    return go(boolean.parse(text))


@pytest.mark.parametrize("k", [None, 7])
def test_many_queries_are_each_alone(spark, k):
    texts, index = index_of(spark)
    asked = queries(200)
    got = {i: set() for i in asked}
    for r in boolean.search_many(index, asked, k).collect():
        got[r.qid].add(r.doc_id)
    assert got == {i: set(sorted(plain(texts, q))[:k]) for i, q in asked.items()}
    assert sorted(got[3]) == [r.doc_id for r in boolean.search(index, asked[3], k).collect()]
    index.release()


def test_chunks_of_a_larger_collection(spark):
    """More documents than a chunk holds; without a NOT only chunks with a term are made."""
    n = boolean.CHUNK + 500
    docs = spark.range(n).selectExpr("id doc_id", "concat('every', if(id % 1000 = 0, ' rare', ''), if(id = 7, ' one', '')) text")
    index = Index(docs, order_col="doc_id", keep=True)
    got = {}
    for r in boolean.search_many(index, {"a": "rare", "b": "one", "c": "NOT every", "d": "NOT (every AND NOT rare)"}).collect():
        got.setdefault(r.qid, set()).add(r.doc_id)
    rare = {str(i) for i in range(0, n, 1000)}
    assert got == {"a": rare, "b": {"7"}, "d": rare}
    assert {r.doc_id for r in boolean.search_many(index, {"a": "one OR rare"}).collect()} == rare | {"7"}
    index.release()


def test_shared_subterms_are_one_node():
    dag = boolean.merged({1: "ax AND bx", 2: "bx AND ax", 3: "NOT NOT (ax AND bx)", 4: "(ax AND bx) OR cx", 5: "ax AND ax"})
    assert dag.roots[1] == dag.roots[2] == dag.roots[3]
    assert sorted(x[0] for x in dag.nodes) == ["AND", "NOT", "OR", "TERM", "TERM", "TERM"]
    assert dag.nodes[dag.roots[4]][0] == "OR" and dag.roots[5] == 0
    with pytest.raises(boolean.BooleanQueryError):
        boolean.merged({1: "ax AND"})
