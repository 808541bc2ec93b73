"""Writers: crawled records, TREC runs, token reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_jsonl(records: DataFrame, folder: str) -> None:
    records.write.mode("append").json(folder)


def write_trec(lines: DataFrame, folder: str) -> None:
    """lines: qid, rank, line; in the order of qid as a string and rank, one file."""
    lines.orderBy("qid", "rank").select("line").coalesce(1).write.mode("overwrite").text(folder)


def write_token_report(counts: DataFrame, folder: str) -> None:
    """counts: method, field, term, n. A folder for each method with lines `word : count`, most frequent first, and two
    blank lines after each field."""
    lines = counts.select("method", "field", F.lit(0).alias("part"), "n", "term", F.concat_ws(" : ", "term", F.col("n").cast("string")).alias("value"))
    gaps = counts.select("method", "field").distinct().select("method", "field", F.explode(F.array(F.lit(1), F.lit(2))).alias("part"), F.lit(0).cast("long").alias("n"), F.lit("").alias("term"), F.lit("").alias("value"))
    lines.unionByName(gaps).repartition("method").sortWithinPartitions("method", "field", "part", F.desc("n"), "term").select("method", "value").write.mode("overwrite").partitionBy("method").text(folder)
