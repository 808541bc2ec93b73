import zlib

import pytest
from pyspark.sql import functions as F

from kiln.llm.merkle import Traversal, depth_of, folded, manifest, siblings, verified
from tests.llm.brute import sha

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, leaf string, at long, root string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, "x", "y", 3, "z") for i, t, lang, s, n in rows], DOCS).repartition(3)


def levels_of(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def path_of(levels, i, fanout):
    path = []
    for nodes in levels[:-1]:
        j = i - i % fanout
        run = nodes[j : j + fanout]
        path.append((i - j, "".join(run[: i - j] + run[i - j + 1 :])))
        i //= fanout
    return path


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute(rows, fanout=8):
    """(doc_id, leaf): sorted list of (subroot, root, proof)."""
    trees = {}
    for r in rows:
        trees.setdefault((r[2] is not None, (r[2] or "").encode()), []).append((r[0] is not None, r[0] or 0, leaf_of((r[0], r[3], r[2], r[4], r[1]))))
    tops, out = [], {}
    for key in sorted(trees):
        trees[key].sort()
        tops.append(levels_of([x[2] for x in trees[key]], fanout))
    upper = levels_of([t[-1][0] for t in tops], fanout)
    for k, (key, levels) in enumerate(zip(sorted(trees), tops)):
        for i, (has, doc, leaf) in enumerate(trees[key]):
            proof = path_of(levels, i, fanout) + path_of(upper, k, fanout)
            out.setdefault((doc if has else None, leaf), []).append((levels[-1][0], upper[-1][0], proof))
    return {k: sorted(v) for k, v in out.items()}


def got(rows):
    out = {}
    for r in rows.collect():
        out.setdefault((r.doc_id, r.leaf), []).append((r.subroot, r.root, [(x.position, x.siblings) for x in r.proof]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("fanout", [2, 3, 8])
@pytest.mark.parametrize("height", [1, 2, 5])
def test_traversal_against_all_levels(fanout, height):
    for n in [1, 2, 3, 7, 8, 9, 16, 17, 63, 64, 65, 100]:
        nodes = [sha(str(i)) for i in range(n)]
        levels = levels_of(nodes, fanout)
        walk = Traversal([x.encode() for x in nodes], depth_of(n, fanout), fanout, height)
        assert walk.root().decode() == levels[-1][0]
        assert [[(i, s.decode()) for i, s in p] for p in walk.proofs()] == [path_of(levels, i, fanout) for i in range(n)]


def test_traversal_holds_two_subtrees_a_layer(monkeypatch):
    from kiln.llm import merkle

    alive, most = set(), [0]
    begin, close = merkle._Subtree.__init__, merkle._Subtree.__del__ if hasattr(merkle._Subtree, "__del__") else None

    def init(self, *a):
        begin(self, *a)
        alive.add(id(self))
        most[0] = max(most[0], len(alive))

    monkeypatch.setattr(merkle._Subtree, "__init__", init)
    monkeypatch.setattr(merkle._Subtree, "__del__", lambda self: alive.discard(id(self)), raising=False)
    assert close is None
    assert sum(1 for _ in Traversal([b"x"] * 4096, 4, 8, 1).proofs()) == 4096
    assert most[0] <= 2 * 4 + 2


ROWS = [(i, f"text {i} é", ["en", "fr", None, "", "zz", "ém"][i % 6], f"s{i % 3}" if i % 4 else None, i * 7 if i % 5 else None) for i in range(150)]
ROWS += [(1000, None, "en", None, None), (1001, "", "en", "", 0), (None, "no id", "en", "s", 1), (None, "no id", "en", "s", 1), (1001, "tie", "en", "a", 3)]
ROWS += [(2000, "same", "fr", "s", 4)] * 40 + [(3000, "A" * 1_000_000, "alone", "s", 1)]


@pytest.mark.parametrize("options", [{}, {"levels": 1, "fanout": 4}, {"levels": 2, "fanout": 2, "height": 2}])
def test_manifest_against_brute_force(spark, options):
    rows = manifest(docs(spark, ROWS), **options)
    assert got(rows) == brute(ROWS, options.get("fanout", 8))
    assert verified(rows).where("not verified").count() == 0


def test_tampering_is_found(spark):
    data = docs(spark, ROWS[:60])
    rows = verified(manifest(data, carry={"now": F.when(F.col("doc_id") % 2 == 0, F.sha2(F.lit("other").cast("binary"), 256))}), "now").collect()
    assert {r.doc_id: r.verified for r in rows} == {i: False if i % 2 == 0 else None for i in range(60)}
    assert all(r.folded_root != r.root for r in rows if r.doc_id % 2 == 0)


def test_empty_and_single(spark):
    assert manifest(docs(spark, [])).collect() == []
    (one,) = verified(manifest(docs(spark, [(5, None, None, None, None)]))).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root == sha("1:5----") and one.proof == [] and one.verified


def test_query_contract(spark, tmp_path):
    from kiln.llm.queries import op11_merkle_manifest

    spark.createDataFrame([r for r in ROWS if r[0] is not None], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for (doc, leaf), each in brute([r for r in ROWS if r[0] is not None]).items():
        for subroot, root, proof in each:
            want.setdefault((doc, leaf), []).append((subroot, root, sha("".join(s for _, s in proof)), proof))
    texts = {(r[0], leaf_of((r[0], r[3], r[2], r[4], r[1]))): r for r in ROWS}
    rows = op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(rows) == sum(map(len, want.values()))
    for r in rows:
        row, good = texts[r.doc_id, r.leaf], False
        text = row[1].translate({c: c + 32 for c in range(65, 91)}) if row[1] is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 else row[1]
        for subroot, root, digest, proof in want[r.doc_id, r.leaf]:  # equal rows have several places
            node = leaf_of((row[0], row[3], row[2], row[4], text))
            for place, others in proof:
                node = sha(others[: 64 * place] + node + others[64 * place :])
            good |= (r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == (subroot, root, digest, node, node == root)
        assert good


def test_string_ids_and_expressions(spark):
    data = spark.createDataFrame([(x, "t", "en") for x in ("b", "a", "c")], "key string, body string, part string")
    rows = manifest(data, ("key", "body"), "part", "key")
    want = [sha(f"1:{x}1:t") for x in "abc"]
    assert {r.doc_id: (r.leaf, r.root) for r in rows.collect()} == {x: (w, sha("".join(want))) for x, w in zip("abc", want)}
    assert rows.select(siblings(F.col("proof")).alias("s")).where("s = ''").count() == 0
    assert rows.select((folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).where("not ok").count() == 0
