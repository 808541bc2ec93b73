import random
import time

from kiln.llm.substring_dedup import substring_dedup


def test_repeated_rows_whose_anchor_has_several_contents(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for k in range(10):
        middle = text(90)  # shared, but shorter than what counts
        rows += [(2 * k, text(150) + middle + text(150)), (2 * k + 1, text(150) + middle + text(150))]
    both = spark.createDataFrame(rows + rows, "doc_id long, text string")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in substring_dedup(both).collect()} == {tuple(r) for r in substring_dedup(once).collect()}


def shared(n, seed):
    """n texts with a line in common."""
    rng = random.Random(seed)
    line = "".join(rng.choice("abcdefgh ") for _ in range(130))
    return ["".join(rng.choice("abcdefgh ") for _ in range(60)) + line for _ in range(n)]


def kept(got):
    return sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def test_many_rows_without_an_id(spark):
    """They cost what rows with ids cost: each text is found on its own, and all but one lose the line."""
    texts = shared(3000, 1)
    took, removed = [], []
    for ids in (range(len(texts)), [None] * len(texts), [7] * len(texts)):
        data = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        start = time.time()
        got = substring_dedup(data).collect()
        took.append(time.time() - start)
        removed.append(sorted(r.n_removed for r in got))
    for r in removed:
        assert r[0] == 0 and r[1] >= 130 and r[-1] <= 140
    assert max(took[1:]) < 2 * took[0] + 10, took


def test_ids_that_are_not_numbers(spark):
    texts = [*shared(20, 2), None, ""]
    names = [f"id {chr(ord('z') - i)}" for i in range(20)] + [None, "b"]
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(list(zip(names, texts)), "doc_id string, text string")).collect()}
    order = sorted(x for x in names if x)
    numbered = [(order.index(x) if x else None, t) for x, t in zip(names, texts)]
    want = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(numbered, "doc_id int, text string")).collect()}
    assert len(got) == len(want) == 22
    for x, (i, _) in zip(names, numbered):
        assert got[x][1:] == want[i][1:]
