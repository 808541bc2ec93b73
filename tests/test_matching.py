import pytest
from pyspark.sql import functions as F

from kiln.functions.matching import Words, lowered
from kiln.operators import evaluation, present


@pytest.mark.parametrize(
    ("text", "words", "want"),
    [
        ("raid mark", ["raid", "mark"], "<mark>raid</mark> <mark>mark</mark>"),
        ("a mark</mark>", ["mark", "/"], "a <mark>mark</mark><<mark>/mark</mark>>"),
        ("abcabc", ["abc", "bca"], "<mark>abcabc</mark>"),
        ("aaa", ["aa"], "<mark>aa</mark>a"),
        ("ÉTÉ été", ["été"], "<mark>ÉTÉ</mark> <mark>été</mark>"),
        ("İi x", ["i"], "İ<mark>i</mark> x"),
        ("dungeon", ["dun", "dungeon", "geo"], "<mark>dungeon</mark>"),
        ("$1 \\ (x)", ["$1", "\\", "("], "<mark>$1</mark> <mark>\\</mark> <mark>(</mark>x)"),
        ("nothing", ["", "zzz"], "nothing"),
        ("", ["a"], ""),
    ],
)
def test_marks_on_the_untouched_text(text, words, want):
    assert Words(words, any_case=True).marked(text, "<mark>", "</mark>") == want


def test_lower_case_keeps_places():
    for text in ("İstanbul", "STRASSE ẞ", "plain"):
        assert len(lowered(text)) == len(text)


def test_highlight_column(spark):
    d = spark.createDataFrame([(1, "Raid mark"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.h for r in d.select("doc_id", present.highlight(F.col("text"), ["raid", "mark"]).alias("h")).collect()}
    assert got == {1: "<mark>Raid</mark> <mark>mark</mark>", 2: None, 3: ""}


@pytest.mark.parametrize("limit", [50_000, 2])
def test_short_passages_against_all_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(evaluation, "SHORT_PASSAGES", limit)
    texts = ["one two three", "two one", None, "", "xone twox", "a b c d e f"]
    passages = ["one", "one two", "two one", "nosuch", "a b c d", "", None, "one"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p = spark.createDataFrame([(str(i), t) for i, t in enumerate(passages)], "qid string, text string")
    got = sorted(tuple(r) for r in evaluation.containing(d, p).select("qid", "doc_id").collect())
    assert got == sorted((str(i), k) for i, x in enumerate(passages) if x for k, t in enumerate(texts) if t and x in t)
