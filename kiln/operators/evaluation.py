"""Effectiveness: average precision and its mean, for all queries and cut-offs in one job."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.matching import Words
from kiln.operators.ranked import small

CUTOFFS = (10, 20, 50)
#: Passages of one or two words that are looked for in one go.
SHORT_PASSAGES = 50_000


def timed(run: DataFrame, n_queries: int) -> tuple[DataFrame, float, float]:
    """run, kept, and how long it took: milliseconds in all and for each of its queries on average (0 without queries)."""
    start = time.perf_counter()
    run = run.persist()
    run.count()
    total = 1000 * (time.perf_counter() - start)
    return run, total, total / n_queries if n_queries else 0.0


def last_of_query(queries: DataFrame, order_col: str = "pos") -> DataFrame:
    """Of records with one qid the last."""
    w = Window.partitionBy("qid").orderBy(F.desc(order_col))
    return queries.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def average_precision(run: DataFrame, qrels: DataFrame, qids: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(qid, k, ap) of every qid: sum of hits / rank at relevant ranks up to k, over the number of relevant documents.

    run: qid, rank, doc_id; qrels: qid, doc_id, distinct; qids: all queries. Without relevant documents, or without a
    ranking, it is 0. A document that is ranked twice counts twice.
    """
    relevant = qrels.distinct()
    sizes = relevant.groupBy("qid").agg(F.count("*").alias("n_rel"))
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = run.join(relevant.withColumn("rel", F.lit(1)), ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0))).withColumn("hits", F.sum("rel").over(w)).where("rel = 1")
    each = qids.select("qid").distinct().select("qid", F.explode(F.array(*map(F.lit, cutoffs))).alias("k"))
    gained = each.join(hits, "qid", "left").groupBy("qid", "k").agg(F.sum(F.when(F.col("rank") <= F.col("k"), F.col("hits") / F.col("rank")).otherwise(0.0)).alias("gain"))
    return gained.join(sizes, "qid", "left").select("qid", "k", F.coalesce(F.col("gain") / F.col("n_rel"), F.lit(0.0)).alias("ap"))


def mean_average_precision(run: DataFrame, qrels: DataFrame, qids: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(k, map): 0 if there are no queries."""
    got = average_precision(run, qrels, qids, cutoffs).groupBy("k").agg(F.avg("ap").alias("m"))
    every = qids.sparkSession.createDataFrame([(k,) for k in cutoffs], "k int")
    return every.join(F.broadcast(got), "k", "left").select("k", F.coalesce("m", F.lit(0.0)).alias("map"))


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, doc_id): documents (doc_id, text) of which the text holds the text of a passage (qid, text).

    A word inside a passage, between white space, is a word of each text that holds it. So the longest such word of
    each passage is looked up among the distinct words of the documents, and what is found is verified. Passages of
    fewer than three words have no such word; they are looked for in every text by an automaton of up to SHORT_PASSAGES of
    them at a time. Repeated rows give one; null and empty passages are in no document.
    """
    parts = passages.where("text is not null and text <> ''").select("qid", F.col("text").alias("passage"), F.split("text", r"\s+").alias("w"))
    long = parts.where("size(w) > 2").select("qid", "passage", F.expr("array_max(transform(slice(w, 2, size(w) - 2), x -> named_struct('n', length(x), 'x', x))).x").alias("word"))
    short = parts.where("size(w) < 3").select("qid", "passage")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    pairs = words.join(small(long.select("qid", "word")), "word").select("qid", "doc_id").distinct()
    found = pairs.join(docs, "doc_id").join(small(long.select("qid", "passage")), "qid").where(F.contains("text", F.col("passage"))).select("qid", "doc_id")
    if short.isEmpty():
        return found.distinct()
    n = short.count()
    for part in range(-(-n // SHORT_PASSAGES)):
        mine = short if n <= SHORT_PASSAGES else short.where(F.pmod(F.xxhash64("qid", "passage"), F.lit(-(-n // SHORT_PASSAGES))) == part)
        found = found.unionByName(_short(docs, mine))
    return found.distinct()


def _short(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, doc_id) for few short passages, which are sent to the tasks."""
    listed = passages.select("qid", "passage").collect()  # about SHORT_PASSAGES, of two words each
    kinds = [passages.schema["qid"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()]
    asked: dict[str, list] = {}
    for r in listed:
        asked.setdefault(r["passage"], []).append(r["qid"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(asked)
        for b in batches:
            qids, at = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for x in {text[s:e] for s, e in words.matches(text)} if text else ():
                    qids += asked[x]
                    at += [i] * len(asked[x])
            yield pa.RecordBatch.from_arrays([pa.array(qids), b.column(0).take(pa.array(at, pa.int64()))], names=["qid", "doc_id"]) if at else pa.RecordBatch.from_arrays([pa.nulls(0), b.column(0).slice(0, 0)], names=["qid", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, f"qid {kinds[0]}, doc_id {kinds[1]}")


def trec_lines(run: DataFrame, method: str) -> DataFrame:
    """(qid, rank, line): `qid 0 doc_id rank score run_id`, six decimals; order by qid (a string) and rank."""
    cols = (F.col("qid").cast("string"), F.lit("0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), F.format_string("%.6f", "score"), F.lit(f"{method.lower()}_run"))
    return run.select(F.col("qid").cast("string").alias("qid"), "rank", F.concat_ws(" ", *cols).alias("line"))
