"""Previews, highlights and result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.matching import marked

CUT = 5000
MARK = "[...]"


def short_title(title: Column) -> Column:
    return F.substring(F.coalesce(title, F.lit("")), 1, 100)


def preview(docs: DataFrame) -> DataFrame:
    """(doc_id, preview): id, the header fields that aren't empty, a rule, and up to 5000 characters of the body."""
    has = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    body = F.coalesce(F.nullif(has("content"), F.lit("")), F.nullif(has("text"), F.lit("")), F.lit(""))
    lines = [F.concat(F.lit("ID: "), F.col("doc_id").cast("string"))]
    lines += [F.when(F.coalesce(has(c), F.lit("")) != "", F.concat(F.lit(f"{c.capitalize()}: "), has(c))) for c in ("title", "url", "author", "date")]
    cut = F.when(F.length(body) > CUT, F.concat(F.substring(body, 1, CUT), F.lit("\n" + MARK))).otherwise(body)
    return docs.select("doc_id", F.concat_ws("\n", *lines, F.lit("-" * 60), cut).alias("preview"))


def _literal(word: str) -> str:
    return "(?iu)" + "".join("\\" + c if c in r"\.^$|?*+()[]{}-" else c for c in word)


def highlight(text: Column, words: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """What the words cover, in any case and inside other words too, between before and after.

    Occurrences are looked for in the text as it is, so marks are never found themselves; where words overlap or touch,
    there is one mark around them. Empty words are left out; null text stays null.
    """
    return marked(text, words, before, after)


def highlight_count(text: Column, words: list[str]) -> Column:
    out = F.lit(0)
    for word in words:
        out = out + F.regexp_count(text, F.lit(_literal(word)))
    return out


def result_rows(run: DataFrame, docs: DataFrame, scored: bool = True) -> DataFrame:
    """(qid, rank, score text, doc_id, title): documents without a title, or unknown ones, have an empty one."""
    titles = docs.select("doc_id", "title") if "title" in docs.columns else docs.select("doc_id", F.lit("").alias("title"))
    score = F.format_string("%.4f", "score") if scored else F.lit("—")
    return run.join(titles, "doc_id", "left").select("qid", "rank", score.alias("score_text"), "doc_id", short_title(F.col("title")).alias("title"))
