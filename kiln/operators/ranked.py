"""Ranked retrieval: all queries of a batch in one job."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.text import TextConfig
from kiln.operators.index import Index, counts_of_rows, hot_level, log_tf, tokenise

#: Rows of query vectors that are broadcast to the postings; more are joined by shuffle.
BROADCAST_TERMS = 200_000
DIGITS = 6
#: Scores (queries x documents) that are made at a time in a task.
SCORES = 1 << 21
#: Rounding to DIGITS and the order of additions move a score by less.
SLACK = 2 * 10.0**-DIGITS


def small(df: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """df, marked for broadcast if it has at most limit rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def query_vectors(index: Index, queries: DataFrame, qid_col: str = "qid", text_col: str = "text", config: TextConfig | None = None) -> DataFrame:
    """(qid, term, qw, idf): log TF times the index's IDF; unknown terms are left out, terms of IDF 0 stay with weight 0.

    Queries get the stems, lemmas and number words of the index's options, or of others (config). Base forms of lemmas
    are looked up where those of the documents are.
    """
    config = config or index.config
    lexicon = index.lexicon if config.lemma and config.lexicon is None else None
    q = tokenise(queries, config, qid_col, text_col, lexicon=lexicon).select(F.col("doc_id").alias("qid"), F.explode("tokens").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("tf"))
    return index.vocab.join(small(q), "term").select("qid", "term", (log_tf(F.col("tf")) * F.col("idf")).alias("qw"), "idf")


def top(scored: DataFrame, k: int, *ties) -> DataFrame:
    """Rank by falling score per query, then by the tie columns; keeps k (pruned before the shuffle by the engine)."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), *(ties or ("doc_ord",)))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 5, normalize: bool = True, qid_col: str = "qid", text_col: str = "text") -> DataFrame:
    """(qid, rank, doc_id, score): cosine of TF-IDF vectors, rounded to six digits; ties go by document order.

    With normalize both vectors are made units first, else the dot product is divided at the end; the same up to
    rounding. Queries without a document that shares a term get the first k documents with score 0.
    """
    rows = index.rows_by_document()  # before the vocabulary, which is made of them then
    q = query_vectors(index, queries, qid_col, text_col)
    # A known term of a weight other than 0 is in some posting, so these queries find something.
    finding = q.where("qw <> 0").select("qid").distinct()
    length = q.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    if normalize:
        q = q.join(length, "qid").where("qn > 0").select("qid", "term", (F.col("qw") / F.col("qn")).alias("qw"), "idf")
    held = q.where("qw <> 0").select("qid", "term", "qw", "idf")
    if rows is not None and held.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        scored = _of_rows(index, rows, held if normalize else held.join(length, "qid"), k)
    else:
        scored = _of_sums(index, held, length, normalize)
    return completed(index, queries.select(F.col(qid_col).alias("qid")).distinct().join(finding, "qid", "left_anti"), top(scored, k), k)


def _of_sums(index: Index, q: DataFrame, length: DataFrame, normalize: bool) -> DataFrame:
    """(qid, doc_id, doc_ord, score) of all documents that share a term, by joins; for stored indexes and very many queries."""
    # Norms are put on the sums, of which there are far fewer than postings; weights are made for the queries' terms only.
    dots = index.tf.join(small(q), "term").groupBy("qid", "doc_id", "doc_ord").agg(F.sum(F.col("qw") * (log_tf(F.col("tf")) * F.col("idf"))).alias("s")).join(index.norms, ["doc_id", "doc_ord"])
    if normalize:
        dots = dots.select("qid", "doc_id", "doc_ord", (F.col("s") / F.col("norm")).alias("s"))
    else:
        dots = dots.join(length, "qid").select("qid", "doc_id", "doc_ord", F.coalesce(F.try_divide("s", F.col("qn") * F.col("norm")), F.lit(0.0)).alias("s"))
    return dots.select("qid", "doc_id", "doc_ord", F.round("s", DIGITS).alias("score"))


def _of_rows(index: Index, rows: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, doc_ord, score) of all documents that can be among the k best of a query, and perhaps some more.

    A document's terms are in one row, so its dot products are made there, without a shuffle. Its norm needs the
    frequency of each of its terms. Those of frequent terms are at hand in the tasks; of a rare one it is known that it
    lies between 1 and a limit (which is 1, too, where all others are at hand), which bounds norm and score from both sides. Documents whose upper bound reaches the k-th
    lower bound go on; only their norms are made in full.
    """
    vocab, level = index.vocab, hot_level(index.vocab)
    rare = vocab.where(F.lit(True) if level is None else F.col("df") < 2**level)
    hot = vocab.where(F.lit(False) if level is None else F.col("df") >= 2**level).select("term", "idf").toArrow().combine_chunks()  # HOT_TERMS at most
    exact = level == 1 or rare.isEmpty()  # rare terms are in one document each, or there are none
    most = float(np.log10(max(index.n_docs, 1)))
    least = max(0.0, most - float(np.log10(max(2**level - 1, 1)))) if level is not None else 0.0  # idf of rare terms is in between
    asked = q.select("qid", "term", "qw", "idf", *([F.col("qn")] if "qn" in q.columns else [])).toArrow().combine_chunks()  # BROADCAST_TERMS at most
    names = pc.unique(asked["qid"].combine_chunks())
    terms = pc.unique(asked["term"].combine_chunks())
    of_query, of_term = (pc.index_in(asked[c].combine_chunks(), v).to_numpy(zero_copy_only=False) for c, v in (("qid", names), ("term", terms)))
    value = asked["qw"].to_numpy() * asked["idf"].to_numpy() / (asked["qn"].to_numpy() if "qn" in asked.column_names else 1.0)
    order = np.argsort(of_term, kind="stable")
    of_query, value = of_query[order], value[order]
    starts = np.searchsorted(of_term[order], np.arange(len(terms) + 1))
    known, idf = hot["term"].combine_chunks(), hot["idf"].to_numpy()
    n, kinds = len(names), {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((n, k), -np.inf)  # the k largest lower bounds so far
        for batch in batches:
            for a in range(0, batch.num_rows, max(1, SCORES // n)):
                b = batch.slice(a, max(1, SCORES // n))
                split = pc.split_pattern(b.column("terms"), "\n")
                words, parent = split.flatten(), pc.list_parent_indices(split).to_numpy()
                weight = 1 + np.log10(b.column("counts").flatten().to_numpy())
                at = pc.fill_null(pc.index_in(words, known), -1).to_numpy()
                there = at >= 0
                if len(idf):
                    frequent = np.bincount(parent, np.where(there, weight * idf[at], 0.0) ** 2, b.num_rows)
                else:
                    frequent = np.zeros(b.num_rows)
                others = np.bincount(parent, np.where(there, 0.0, weight) ** 2, b.num_rows)
                low, high = np.sqrt(frequent + others * least**2), np.sqrt(frequent + others * most**2)
                at = pc.fill_null(pc.index_in(words, terms), -1).to_numpy()
                found = np.flatnonzero(at >= 0)
                of = at[found]
                times = starts[of + 1] - starts[of]
                pick = np.repeat(starts[of] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(of) else np.zeros(0, "i8")
                pair = np.repeat(found, times)
                dots = np.bincount(of_query[pick] * np.int64(b.num_rows) + parent[pair], value[pick] * weight[pair], n * b.num_rows).reshape(n, -1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    lower = np.where(dots > 0, dots / high, -np.inf)
                    upper = np.where(dots > 0, dots / low, -np.inf)
                best = np.partition(np.concatenate([best, lower], 1), -k, axis=1)[:, -k:]
                who, doc = np.nonzero((upper >= best.min(1)[:, None] - SLACK) & (dots > 0))
                if len(who):
                    doc_at = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(who)), b.column("doc_id").take(doc_at), b.column("doc_ord").take(doc_at), pa.array(dots[who, doc]), pa.array(lower[who, doc]), pa.array(upper[who, doc])], names=["qid", "doc_id", "doc_ord", "s", "low", "high"])

    if not n:
        return index.docs.sparkSession.createDataFrame([], f"qid {q.schema['qid'].dataType.simpleString()}, doc_id {kinds['doc_id']}, doc_ord {kinds['doc_ord']}, score double")
    near = rows.mapInArrow(run, f"qid {q.schema['qid'].dataType.simpleString()}, doc_id {kinds['doc_id']}, doc_ord {kinds['doc_ord']}, s double, low double, high double")
    if exact:
        return near.select("qid", "doc_id", "doc_ord", F.round("low", DIGITS).alias("score"))
    near = index.held(near)
    limits = near.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("low")))).where(F.col("at") == k).select("qid", F.col("low").alias("limit"))
    near = index.held(near.join(F.broadcast(limits), "qid", "left").where(F.col("limit").isNull() | (F.col("high") >= F.col("limit") - SLACK)).select("qid", "doc_id", "doc_ord", "s"))  # a limit a query
    docs = small(near.select("doc_id", "doc_ord").distinct())
    counts = index.held(counts_of_rows(rows.join(docs, ["doc_id", "doc_ord"], "left_semi")))
    idfs = vocab.join(small(counts.select("term").distinct(), 1_000_000), "term", "left_semi").select("term", "idf")
    weight = log_tf(F.col("tf")) * F.col("idf")
    norms = counts.join(small(idfs, 1_000_000), "term").groupBy("doc_id", "doc_ord").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    return near.join(norms, ["doc_id", "doc_ord"]).select("qid", "doc_id", "doc_ord", F.round(F.col("s") / F.col("norm"), DIGITS).alias("score"))


def completed(index: Index, without: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """found, and for the queries (qid) that found nothing the first k documents with score 0."""
    first = index.documents.orderBy("doc_ord").limit(k)
    w = Window.partitionBy("qid").orderBy("doc_ord")
    fallback = without.crossJoin(F.broadcast(first)).select("qid", "doc_id", F.lit(0.0).alias("score"), F.row_number().over(w).alias("rank"))  # k rows a query
    return found.select("qid", "rank", "doc_id", "score").unionByName(fallback.select("qid", "rank", "doc_id", "score"))
