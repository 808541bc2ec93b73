"""Token frequencies by field and method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.text import TextConfig
from kiln.operators.index import tokenise

METHODS = {"basic": TextConfig(), "stemmed": TextConfig(stem=True), "lemmatized": TextConfig(lemma=True)}


def token_frequencies(docs: DataFrame, fields: tuple[str, ...] = ("title", "author", "content"), methods: dict[str, TextConfig] = METHODS) -> DataFrame:
    """(method, field, term, n): fields that docs lacks are skipped, nulls dropped."""
    there = [f for f in fields if f in docs.columns]
    long = docs.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in there))).alias("x")).select("x.field", "x.text").where("text is not null")
    out = None
    for name, config in methods.items():
        toks = tokenise(long.withColumnRenamed("field", "doc_id"), config)
        one = toks.select(F.lit(name).alias("method"), F.col("doc_id").alias("field"), F.explode("tokens").alias("term")).groupBy("method", "field", "term").agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
