import json
import math

import pytest
from pyspark.sql import functions as F

from kiln.functions import text as tx
from kiln.functions import words
from kiln.operators import boolean, dense, evaluation, lsa, present, ranked, report, web
from kiln.operators.index import Index, IndexCatalog, pretty_vectors, tokenise
from kiln.sources import readers, sinks


def tokens_of(spark, texts, config=tx.TextConfig()):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r.tokens for r in tokenise(df, config).collect()}
    return [out.get(i, []) for i in range(len(texts))]


def test_normalisation(spark):
    texts = [None, "", "foo<br>bar baz", "dragon\nraid", "dragon\\nraid", "Don't stop x-ray", "Café", "see http://a.b/c?d=1.", "__init__", "a 7 b", "Straße Œuvre"]
    assert tokens_of(spark, texts) == [[], [], ["foobar", "baz"], ["dragon", "raid"], ["dragon", "raid"], ["stop", "x-ray"], ["cafe"], ["see", "http://a.b/c?d=1"], ["init"], [], ["strasse", "oeuvre"]]


def test_numbers_and_dates(spark):
    config = tx.TextConfig(dates=True, numbers=True)
    texts = ["12", "2024", "2024/01/29 AT 3:15 PM", "2024/02/30", "plain"]
    assert tokens_of(spark, texts, config) == [["twelve"], ["two", "thousand", "and", "twenty-four"], ["january", "twenty-ninth", "two", "thousand", "twenty-four"], ["two", "thousand", "and", "twenty-four", "two", "thirty"], ["plain"]]


@pytest.mark.parametrize(("n", "said"), [(0, "zero"), (19, "nineteen"), (40, "forty"), (101, "one hundred and one"), (1000, "one thousand"), (1001, "one thousand and one"), (1234, "one thousand, two hundred and thirty-four"), (1_000_100, "one million, one hundred")])
def test_cardinal(n, said):
    assert words.cardinal(n) == said


@pytest.mark.parametrize(("word", "stem"), [(w.split(":")) for w in "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat rational:ration digitizer:digit operator:oper triplicate:triplic hopefulness:hope goodness:good revival:reviv adoption:adopt probate:probat rate:rate controll:control roll:roll".split()])
def test_porter(word, stem):
    assert words.porter_stem(word) == stem


def test_ordinals():
    assert [words.ordinal(n) for n in (1, 2, 3, 5, 8, 9, 12, 20, 21, 30)] == ["first", "second", "third", "fifth", "eighth", "ninth", "twelfth", "twentieth", "twenty-first", "thirtieth"]


def test_stems_and_lemmas(spark):
    assert tokens_of(spark, ["running ponies"], tx.TextConfig(stem=True)) == [["run", "poni"]]
    assert tokens_of(spark, ["wolves wolf churches church boxes box glass men man ponies"], tx.TextConfig(lemma=True)) == [["wolf", "wolf", "church", "church", "box", "box", "glass", "man", "man", "ponies"]]


@pytest.fixture(scope="module")
def abc(spark):
    rows = [("d1", "aa aa bb cc", 0), ("d2", "aa bb bb", 1), ("d3", "aa dd", 2)]
    return Index(spark.createDataFrame(rows, "doc_id string, text string, pos long"), order_col="pos")


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.doc_id, round(r.score, 6)))
    return out


def test_statistics(abc):
    assert {r.term: (r.df, round(r.idf, 6)) for r in abc.vocab.collect()} == {"aa": (3, 0.0), "bb": (2, 0.176091), "cc": (1, 0.477121), "dd": (1, 0.477121)}
    assert {r.doc_id: round(r.norm, 6) for r in abc.norms.collect()} == {"d1": 0.508579, "d2": 0.2291, "d3": 0.477121}
    assert {r.doc_id: r.vector for r in pretty_vectors(abc.postings).collect()}["d1"] == "{bb: 0.176, cc: 0.477}"
    assert abc.stats().first().asDict() == {"n_docs": 3, "n_ids": 3, "n_terms": 4}


@pytest.mark.parametrize("normalize", [True, False])
def test_ranked(spark, abc, normalize):
    q = spark.createDataFrame([("q1", "bb"), ("q2", "aa"), ("q3", "zzz"), ("q4", "cc dd"), ("q5", "")], "qid string, text string")
    got = found(ranked.search(abc, q, 2, normalize))
    assert got == {"q1": [("d2", 1.0), ("d1", 0.346242)], "q2": [("d1", 0.0), ("d2", 0.0)], "q3": [("d1", 0.0), ("d2", 0.0)], "q4": [("d3", 0.707107), ("d1", 0.663369)], "q5": [("d1", 0.0), ("d2", 0.0)]}
    assert found(ranked.search(abc, q.where("qid = 'q1'"), 5, normalize)) == {"q1": [("d2", 1.0), ("d1", 0.346242)]}


def test_lsa_matches_the_plain_formula(spark, abc):
    import numpy as np

    q = spark.createDataFrame([("q1", "bb cc"), ("q2", "zzz"), ("q3", "aa")], "qid string, text string")
    got = found(lsa.search(abc, q, 3))
    assert set(got) == {"q1"}
    b, c = math.log10(1.5), math.log10(3)
    a = np.array([[0, 0, 0], [b, b * (1 + math.log10(2)), 0], [c, 0, 0], [0, 0, c]])
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    k = 2
    lat, docs = np.array([0, b, c, 0]) @ u[:, :k] / s[:k], (vt[:k].T * s[:k])
    want = docs @ lat / np.maximum(np.linalg.norm(docs, axis=1) * np.linalg.norm(lat), 1e-12)
    assert dict(got["q1"]) == pytest.approx({f"d{i + 1}": x for i, x in enumerate(want)}, abs=1e-5)


def test_lsa_model_is_kept_with_its_snapshot(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "bb cc"), (3, "dd")], "doc_id long, text string")
    index = Index(docs, order_col="doc_id", keep=True)
    first = lsa.model(index)
    assert lsa.model(index) is first
    more, _ = index.add(spark.createDataFrame([(4, "cc dd")], "doc_id long, text string"))
    assert lsa.model(more) is not first
    none = spark.createDataFrame([], "qid string, text string")
    assert lsa.search(index, none).collect() == []
    assert lsa.search(Index(docs.limit(0), order_col="doc_id"), none).collect() == []
    index.release()
    assert not index._made.keys() & {"latent 200", "tf"}


def test_lsa_runs_of_queries(spark, abc, monkeypatch):
    q = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(["bb cc", "dd", "cc", "zzz", "bb"])], "qid string, text string")
    want = found(lsa.search(abc, q, 2))
    monkeypatch.setattr(lsa, "QUERIES", 2)
    assert found(lsa.search(abc, q, 2)) == want


def test_queries_get_the_forms_of_the_index(spark):
    docs = spark.createDataFrame([(1, "dog house"), (2, "cats cat"), (3, "running")], "doc_id long, text string")
    q = spark.createDataFrame([("q", "dogs")], "qid string, text string")
    for config in (tx.TextConfig(stem=True), tx.TextConfig(lemma=True)):
        got = ranked.search(Index(docs, config, order_col="doc_id"), q, 1).collect()
        assert [(r.doc_id, r.score > 0) for r in got] == [(1, True)]
    plain = Index(docs, order_col="doc_id")
    assert ranked.search(plain, q, 1).first().score == 0
    assert [r.doc_id for r in lsa.search(plain, q, 1, config=tx.TextConfig(lemma=True)).collect()] == [1]
    lexicon = spark.createDataFrame([("hous",)], "form string")
    mice = Index(spark.createDataFrame([(1, "houss")], "doc_id long, text string"), tx.TextConfig(lemma=True, lexicon=lexicon), order_col="doc_id")
    assert [r.term for r in mice.tf.collect()] == ["houss"]  # a double s stays


def test_index_over_several_columns(spark):
    docs = spark.createDataFrame([(1, "aa", None, "bb"), (2, "", "cc", None), (3, None, None, "")], "doc_id long, title string, content string, text string")
    index = Index(docs, text_col=("title", "content", "text"), order_col="doc_id")
    assert {r.doc_id: r.tokens for r in index.tokenised.collect()} == {1: ["aa", "bb"], 2: ["cc"]}


def test_embeddings_are_kept_and_runs_timed(spark):
    index = Index(spark.createDataFrame([(1, "aa"), (2, None)], "doc_id long, text string"), keep=True)
    made = dense.embeddings(index, lambda texts: [[len(t) + 1.0, 0.0] for t in texts])
    assert dense.embeddings(index, None) is made
    run, total, mean = evaluation.timed(made, 4)
    assert run.count() == 2 and mean == total / 4
    assert evaluation.timed(made.limit(0), 0)[2] == 0
    index.release()


@pytest.fixture(scope="module")
def xyz(spark):
    rows = [("1", "xx"), ("2", "xx yy"), ("10", "xx"), ("3", "yy zz"), ("11", "ww")]
    return Index(spark.createDataFrame(rows, "doc_id string, text string"))


@pytest.mark.parametrize(("query", "want"), [("xx", "1 10 2"), ("xx and yy", "2"), ("xx OR zz", "1 10 2 3"), ("NOT xx", "11 3"), ("xx AND NOT yy", "1 10"), ("NOT xx AND NOT yy", "11"), ("xx OR yy AND zz", "1 10 2 3"), ("(xx OR yy) AND zz", "3"), ("NOT NOT xx", "1 10 2"), ("xx yy AND", "2"), ("AND xx yy", "2"), ("NOT xx yy AND", "1 10"), ("nope", ""), ("xx AND () yy", "2")])
def test_boolean(xyz, query, want):
    assert [r.doc_id for r in boolean.search(xyz, query).collect()] == want.split()
    assert sorted(r.doc_id for r in boolean.evaluate_by_joins(xyz, query).collect()) == want.split()


def test_boolean_limit_and_terms(xyz):
    assert [r.doc_id for r in boolean.search(xyz, "xx", 2).collect()] == ["1", "10"]
    assert boolean.lex("AND-x and-x NOT_x") == ["AND", "x", "and-x", "NOT_x"]
    assert boolean.normalise_query("Foo AND (the OR bar)", lambda x: [] if x == "the" else [x.lower() + "1"]) == "foo1 AND ( the OR bar1 )"


@pytest.mark.parametrize(("query", "said"), [("x y", "Invalid"), ("()", "Invalid"), ("x AND", "AND without"), ("NOT", "NOT without"), ("(x", "Mismatched"), ("x)", "Mismatched"), ("", "Empty"), (None, "Empty"), ("apple AND (banana OR cherry) NOT date", "Invalid")])
def test_boolean_errors(query, said):
    with pytest.raises(boolean.BooleanQueryError, match=said):
        boolean.parse(query)


def test_evaluation(spark):
    run = spark.createDataFrame([("q1", 1, "a"), ("q1", 2, "b"), ("q1", 3, "c"), ("q2", 1, "z")], "qid string, rank int, doc_id string")
    rel = spark.createDataFrame([("q1", "a"), ("q1", "c"), ("q1", "m"), ("q2", "x")], "qid string, doc_id string")
    qids = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "qid string")
    got = {(r.qid, r.k): round(r.ap, 6) for r in evaluation.average_precision(run, rel, qids, (1, 10)).collect()}
    assert got == {("q1", 1): 0.333333, ("q1", 10): 0.555556, ("q2", 1): 0, ("q2", 10): 0, ("q3", 1): 0, ("q3", 10): 0}
    assert {r.k: round(r.map, 6) for r in evaluation.mean_average_precision(run, rel, qids, (1, 2, 10)).collect()} == {1: 0.111111, 2: 0.111111, 10: 0.185185}
    assert [r.map for r in evaluation.mean_average_precision(run, rel, qids.where("false"), (10,)).collect()] == [0.0]
    lines = [r.line for r in evaluation.trec_lines(run.withColumn("score", F.lit(0.5)), "TF-IDF").orderBy("qid", "rank").collect()]
    assert lines[0] == "q1 0 a 1 0.500000 tf-idf_run"


def test_containing(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "xone two threey"), (3, "two  three"), (4, None), (1, "one two three four")], "doc_id long, text string")
    q = spark.createDataFrame([("a", "one two three"), ("b", "two"), ("c", "e four"), ("d", ""), ("e", None), ("f", "two\nthree x")], "qid string, text string")
    got = sorted(tuple(r) for r in evaluation.containing(docs, q).collect())
    assert got == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("c", 1)]


def test_incremental_is_a_rebuild(spark, abc):
    catalog = IndexCatalog()
    catalog.register("x", abc)
    new = spark.createDataFrame([("d3", "other", 3), ("d4", "dd ee", 4), ("d4", "ee", 5)], "doc_id string, text string, pos long")
    assert catalog.add("x", new).first().asDict() == {"added": 2, "skipped": 1}
    both = Index(abc.docs.unionByName(new.where("doc_id = 'd4'")), order_col="pos")
    key = lambda i: sorted((r.term, r.df, round(r.idf, 9)) for r in i.vocab.collect())
    assert key(catalog.get("x")) == key(both) and catalog.get("x").version == 1 and catalog.names() == ["x"]


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, None)], "vec_id long, embedding array<float>")
    assert found(dense.search(v, v.where("vec_id = 2"), 2)) == {2: [(2, 1.0), (3, 0.8)]}
    texts = spark.createDataFrame([(1, "aab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: [round(x, 4) for x in r.embedding] for r in dense.encode(texts, lambda ts: [[t.count("a"), t.count("b")] for t in ts]).collect()}
    assert got == {1: [0.8944, 0.4472], 2: [0.0, 0.0]}


def test_web(spark):
    html = '<body><h1> A </h1><a href="/news/x-1">x</a><a href="">e</a><a href="http://o/y">y</a><a href="/news/x-1">x</a><ul><li>k<b>1</b></li><li></li></ul></body>'
    pages = spark.createDataFrame([(0, "u0", html), (1, "u1", '<body><a href="/news/x-1">x</a></body>'), (2, "u2", '<body><h1></h1><title>T</title><a href="/new">n</a></body>'), (3, "u3", None)], "page_id long, url string, html string")
    got = [(r.page_id, r.pos, r.url) for r in web.links(pages, "http://h").orderBy("page_id", "pos").collect()]
    assert got == [(0, 0, "http://h/news/x-1"), (0, 2, "http://o/y"), (0, 3, "http://h/news/x-1"), (1, 0, "http://h/news/x-1"), (2, 0, "http://h/new")]
    assert sorted(r.url for r in web.crawl(pages, "http://h").collect()) == ["http://h/news/x-1", "http://o/y"]
    fields = {r.page_id: (r.title, r.author) for r in web.page_fields(pages).collect()}
    assert fields == {0: ("A", ""), 2: ("", "")}
    assert [(r.page_id, r.v) for r in web.nested(pages, "<li>.*?</li>", {"v": "<b>([^<]*)</b>"}).collect()] == [(0, "1")]
    urls = spark.createDataFrame([("https://h.com/news/a-b-12",), ("https://h.com/news/A-12",), ("https://h.com/news/a-12?x",)], "u string")
    assert [r[0] for r in urls.select(web.article_url(F.col("u"), "h.com")).collect()] == [True, False, False]


def test_presentation(spark):
    d = spark.createDataFrame([("1", "Title", None, "x" * 5001, "u"), ("2", None, "", "été Été", None)], "doc_id string, title string, content string, text string, url string")
    got = {r.doc_id: r.preview for r in present.preview(d).collect()}
    assert got["1"] == "ID: 1\nTitle: Title\nUrl: u\n" + "-" * 60 + "\n" + "x" * 5000 + "\n[...]"
    assert got["2"] == "ID: 2\n" + "-" * 60 + "\nété Été"
    row = d.where("doc_id = '2'").select(present.highlight(F.col("text"), ["ÉT"]).alias("h"), present.highlight_count(F.col("text"), ["é", "."]).alias("n")).first()
    assert row.h == "<mark>ét</mark>é <mark>Ét</mark>é" and row.n == 4
    run = spark.createDataFrame([("q", 1, "1", 0.25), ("q", 2, "9", 0.1)], "qid string, rank int, doc_id string, score double")
    assert [(r.score_text, r.title) for r in present.result_rows(run, d).orderBy("rank").collect()] == [("0.2500", "Title"), ("0.1000", "")]
    assert {r.score_text for r in present.result_rows(run, d, scored=False).collect()} == {"—"}


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 7, "title": "t"}\n\n{"url": "u", "content": "c"}\n{"content": "d"}\n{"id": null, "url": "v"}\n')
    got = [(r.line, r.id) for r in readers.read_documents(spark, str(tmp_path / "a.jsonl")).orderBy("line").collect()]
    assert got == [(0, "7"), (2, "u"), (3, "wh_3"), (4, None)]
    (tmp_path / "q.json").write_text(json.dumps([{"id": 1, "description": "raid guide", "evidence_list": [{"id": 3}, {"id": None}, {"id": "3"}, {"id": "a"}]}, {"id": 2, "description": "", "query": "pvp"}, {"query": "no id"}]))
    q = readers.read_queries(spark, str(tmp_path / "q.json"))
    assert [tuple(r) for r in q.collect()] == [("1", "raid guide", ["3", "a"]), ("2", "pvp", []), ("None", "no id", [])]
    assert [tuple(r) for r in readers.qrels_of(q).collect()] == [("1", "3"), ("1", "a")]
    with pytest.raises(FileNotFoundError):
        readers.read_documents(spark, str(tmp_path / "none.json"))
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{oops\n')
    with pytest.raises(Exception):  # noqa: B017
        readers.read_documents(spark, str(tmp_path / "bad.jsonl")).collect()
    lines = spark.createDataFrame([("b", 1, "b 0 x 1"), ("a", 2, "a 0 y 2"), ("a", 1, "a 0 x 1")], "qid string, rank int, line string")
    sinks.write_trec(lines, str(tmp_path / "run"))
    assert "".join(p.read_text() for p in (tmp_path / "run").glob("part-*")) == "a 0 x 1\na 0 y 2\nb 0 x 1\n"
    docs = spark.createDataFrame([("x y-z xx", "bob xx")], "content string, author string")
    sinks.write_token_report(report.token_frequencies(docs, methods={"basic": tx.TextConfig()}), str(tmp_path / "report"))
    body = "".join(p.read_text() for p in (tmp_path / "report" / "method=basic").glob("part-*"))
    assert body == "bob : 1\nxx : 1\n\n\nxx : 1\ny-z : 1\n\n\n"
    for _ in range(2):
        sinks.append_jsonl(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
