"""Corpus pipeline: toxicity, exact dedup, SimHash near-dedup, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the rows of docs
that stay, with the columns of docs; rows are judged by id and text, so other columns may hold anything, nulls too.
Stages read docs several times: give them a table that can be read again (the check tool and run() write each result).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm.common import materialize, table
from kiln.llm.decontaminate import contamination
from kiln.llm.exact_dedup import exact_dedup
from kiln.llm.packing import pack
from kiln.llm.queries import vocabulary
from kiln.llm.simhash import near_copies
from kiln.llm.toxicity import reject_toxic

#: Rows that go are broadcast up to this number; beyond it both sides are dealt out.
BROADCAST_ROWS = 500_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose id and text hash aren't among (doc_id, mark) of gone."""
    small = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"))
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"].eqNullSafe(F.col("__id")) & (_mark() == F.col("__mark")), "left_anti")


def _mark() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _once(docs: DataFrame) -> DataFrame:
    """Of rows that repeat an id and a text, one."""
    slim = docs.select("doc_id", _mark().alias("mark"))
    if slim.groupBy("doc_id", "mark").count().where("count > 1").isEmpty():
        return docs
    return docs.dropDuplicates(["doc_id", "text"])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more go."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays; of rows that repeat id and text, one."""
    docs = _once(docs)
    slim = materialize(exact_dedup(docs), "stage-exact")
    gone = slim.where("not kept").select("doc_id")
    marked = docs.select("doc_id", _mark().alias("mark"))
    both = slim.where("kept").select("doc_id").intersect(gone)  # one id, several texts: told apart by the text
    if both.isEmpty():
        small = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        gone = gone.select(F.col("doc_id").alias("__id")).distinct()
        return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"].eqNullSafe(F.col("__id")), "left_anti")
    from kiln.llm.exact_dedup import normalised

    shas = slim.where("not kept").select(F.col("doc_id").alias("i"), "text_sha256").distinct()
    texts = docs.select("doc_id", _mark().alias("mark"), F.sha2(normalised().cast("binary"), 256).alias("sha"))
    lost = texts.join(shas, texts["doc_id"].eqNullSafe(shas["i"]) & (texts["sha"] == shas["text_sha256"])).select("doc_id", "mark")
    return _without(docs, lost.intersect(marked))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    groups = materialize(near_copies(docs), "stage-near")
    return _without(docs, groups.where("not (doc_id <=> keep_id)").select("doc_id", "mark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contract's rule calls contaminated go."""
    found = contamination(docs.select(F.struct("doc_id", _mark().alias("mark")).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(docs, materialize(found.where("contaminated").select("doc_id.doc_id", "doc_id.mark"), "stage-contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_dedup_stage), ("simhash", simhash_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: SQL can't express the classifier, the tokenizer and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"run-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
