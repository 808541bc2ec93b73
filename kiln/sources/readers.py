"""Readers for articles (JSON lines), evaluation documents and queries (JSON arrays)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.operators.ranked import small

ARTICLE = T.StructType([T.StructField(x, T.StringType()) for x in ("id", "doc_id", "title", "author", "date", "content", "text", "url")])
QUERY = T.StructType([*(T.StructField(x, T.StringType()) for x in ("id", "description", "query")), T.StructField("evidence_list", T.ArrayType(T.StructType([T.StructField("id", T.StringType())])))])


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where))


def checked(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): the lines of the files in the order of their paths, blank ones included, by their number from 0.

    Large files are split as ever: a first pass counts the lines of each split, a second one adds what comes before. Both
    have the same splits, in which rows are numbered one after another.
    """
    read = spark.read.text(checked(spark, path)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at"))
    splits = read.groupBy("file", "begin").agg(F.min("at").alias("first"), F.count("*").alias("n")).withColumn("all", F.lit(0))
    shift = F.sum("n").over(Window.partitionBy("all").orderBy("file", "begin")) - F.col("n") - F.col("first")  # a row for each split
    return read.join(small(splits.select("file", "begin", shift.alias("shift"))), ["file", "begin"]).select("value", (F.col("at") + F.col("shift")).alias("line"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Articles and their line number `line`; blank lines are skipped but counted; malformed lines raise.

    An absent key `id` becomes the url, else wh_ and the line number; a null that is there stays.
    """
    raw = numbered_lines(spark, path).where("trim(value) <> ''")
    parsed = raw.select("line", "value", F.from_json("value", ARTICLE, {"mode": "FAILFAST"}).alias("d"), F.array_contains(F.json_object_keys("value"), "id").alias("has"))
    #: Fixed value: the prefix of ids that are made of line numbers.
    made = F.concat(F.lit("wh_"), F.col("line").cast("string"))
    id_ = F.when(F.col("has"), F.col("d.id")).otherwise(F.coalesce(F.nullif("d.url", F.lit("")), made))
    return parsed.select("line", id_.alias("id"), *(f"d.{f}" for f in ARTICLE.fieldNames() if f != "id"))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = ARTICLE) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(checked(spark, path))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """By extension: .jsonl is JSON lines, everything else a JSON array."""
    return read_jsonl(spark, path) if path.endswith(".jsonl") else read_json_array(spark, path)


def queries_of(records: DataFrame) -> DataFrame:
    """(qid, text, relevant): description, else query; evidence ids that aren't null, each once, in order."""
    empty = F.lit("")
    ids = F.array_distinct(F.filter(F.transform("evidence_list", lambda x: x["id"]), lambda x: x.isNotNull()))
    return records.select(F.coalesce("id", F.lit("None")).alias("qid"), F.coalesce(F.nullif("description", empty), F.nullif("query", empty), empty).alias("text"), F.coalesce(ids, F.expr("cast(array() as array<string>)")).alias("relevant"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return queries_of(read_json_array(spark, path, QUERY))


def qrels_of(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode("relevant").alias("doc_id"))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
