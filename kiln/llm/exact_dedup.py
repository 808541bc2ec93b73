"""Exact deduplication: 128-bit content hash, best row of each group stays, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import materialize, text_or_empty

#: Ids of rows in groups are broadcast up to this many (24 MB as longs with their hash table), else joined by shuffle.
BROADCAST_IDS = 500_000
#: Groups of more rows than this, or than a share of 1 / HOT_GROUPS of all, are placed by a broadcast of their hashes; there
#: are fewer than HOT_GROUPS of them whatever the input.
HOT_ROWS, HOT_GROUPS = 1000, 100_000


def normalised(col: str = "text") -> Column:
    """The text without blank, tab, newline, vertical tab, form feed and carriage return. Null counts as empty."""
    out = text_or_empty(col)
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _best() -> Column:
    return F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id")))


def _placed(slim: DataFrame, groups: DataFrame, hot_rows: int, broadcast_ids: int) -> DataFrame:
    """Rows with the group they are in; rows that are alone have their own id and 1."""
    own = lambda df: df.select("doc_id", "h", "text_sha256", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("size"))
    if groups.limit(broadcast_ids + 1).count() <= broadcast_ids:
        return own(slim.join(F.broadcast(groups), "h", "left"))
    hot = F.col("size") > max(hot_rows, slim.count() // HOT_GROUPS)
    first = slim.join(F.broadcast(groups.where(hot)), "h", "left")
    rest = first.where("size is null").drop("keep_id", "size").join(groups.where(~hot), "h", "left")
    return own(first.where("size is not null")).unionByName(own(rest))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are without the six ASCII white-space characters. The row with the most code
    points in its original text stays, then the smallest id. Groups come from a 128-bit hash; the members of
    each are then grouped by their bytes, and a group with several texts is taken apart.

    Null text is the empty text; all empty texts are one group. A null id sorts after all others, and is kept
    only if no other id is as good. Rows that repeat an id and a text share the decision of that id. An empty
    table gives an empty result. Further columns of docs are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    norm = normalised()
    slim = materialize(
        source.select("doc_id", F.length(text_or_empty()).cast("long").alias("n"), norm.alias("norm")).select("doc_id", "n", F.unhex(F.md5(F.col("norm").cast("binary"))).alias("h"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")),
        "exact",
    )
    groups = slim.groupBy("h").agg(_best().alias("best"), F.count("*").alias("size")).where("size > 1").select("h", F.col("best.doc_id").alias("keep_id"), "size")
    groups = materialize(groups, "exact-groups")
    placed = materialize(_placed(slim, groups, hot_rows, broadcast_ids), "exact-placed")
    inside = placed.where("size > 1").select("doc_id", "h").distinct()

    # Bytes: only the texts of groups with several rows are read again. Equal ones are put together in each task before
    # anything is shuffled, so that a group goes on as one row a task, however large it is.
    few = lambda df: F.broadcast(df) if df.limit(broadcast_ids + 1).count() <= broadcast_ids else df
    hashed = F.unhex(F.md5(F.col("norm").cast("binary")))
    texts = source.select("doc_id", F.length(text_or_empty()).cast("long").alias("n"), norm.alias("norm"))
    named = texts.join(few(inside.where("doc_id is not null")), "doc_id").where(F.col("h") == hashed)
    nameless = texts.where("doc_id is null").withColumn("h", hashed).join(few(inside.where("doc_id is null").select("h")), "h")
    members = named.select("doc_id", "n", "norm", "h").unionByName(nameless.select("doc_id", "n", "norm", "h"))
    collided = materialize(members.select("h", "norm").distinct().groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "exact-collisions")
    if collided.isEmpty():
        done = placed
    else:  # equal hash, other bytes: grouped by the bytes themselves
        own = members.join(few(collided), "h", "left_semi").groupBy("h", "norm").agg(_best().alias("best"), F.count("*").alias("own_size"))
        own = own.select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.col("best.doc_id").alias("own_keep"), "own_size")
        done = placed.join(own, ["h", "text_sha256"], "left").select("doc_id", F.when(F.col("own_size").isNotNull(), F.col("own_keep")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("own_size", "size").alias("size"), "text_sha256")
    return done.select("doc_id", "keep_id", F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
