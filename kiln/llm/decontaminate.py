"""Benchmark decontamination: a hash set of normalised test n-grams against the word windows of all documents."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import materialize, text_or_empty

WINDOW = 13
#: What is not a word character, after A-Z became a-z: ASCII besides 0-9 and a-z.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The set is sent to every task up to this many distinct windows (about 20 MB); beyond that windows are joined by shuffle.
SET_WINDOWS = 100_000
#: Beyond that their hashes (8 bytes each) are broadcast up to this many, else shuffled; texts are compared where hashes agree.
BROADCAST_WINDOWS = 1_000_000


def lowered(col: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def words(col: str = "text") -> Column:
    return F.array_remove(F.split(lowered(text_or_empty(col)), GAPS), "")


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id string, len, win, h): the distinct windows of each item; an item of fewer words is one window."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words(text_col).alias("w")).where("size(w) > 0").withColumn("len", F.least(F.size("w"), F.lit(window)))
    runs = items.select("item_id", "len", F.explode(F.expr("transform(sequence(1, size(w) - len + 1), i -> slice(w, i, len))")).alias("run"))
    return runs.select(F.coalesce("item_id", F.lit("")).alias("item_id"), "len", F.array_join("run", " ").alias("win"), F.expr("xxhash64(transform(run, x -> xxhash64(x)))").alias("h")).distinct()


def _positions_in_set(docs: DataFrame, wins: list, lengths: list[int]) -> DataFrame:
    """Adds hits: array of (p, len) where a window of the set begins; all in the row, without a shuffle."""
    out = docs
    for n in lengths:
        of = [r for r in wins if r["len"] == n]
        hashes = ",".join(f"{r['h']}L" if r["h"] != -(2**63) else "(-9223372036854775807L - 1L)" for r in of)
        texts = ",".join("'" + r["win"].replace("\\", "\\\\").replace("'", "\\'") + "'" for r in of)
        # size(hw) makes hw a column of its own: inlined, it would be made anew for each window
        out = out.withColumn(f"at{n}", F.expr(f"if(size(hw) >= {n}, filter(sequence(1, greatest(size(hw) - {n - 1}, 1)), i -> xxhash64(slice(hw, i, {n})) IN ({hashes})), array())"))
        out = out.withColumn(f"at{n}", F.expr(f"if(size(at{n}) > 0, filter(at{n}, p -> array_join(slice(w, p, {n}), ' ') IN ({texts})), at{n})"))
    return out.withColumn("hits", F.concat(*(F.expr(f"transform(at{n}, p -> named_struct('p', p, 'len', {n}, 'win', array_join(slice(w, p, {n}), ' ')))") for n in lengths)))


def _hits_by_join(base: DataFrame, distinct: DataFrame, lengths: list[int], broadcast_windows: int) -> DataFrame:
    """base (rid, w, hw, ...) with hits, for large sets: first the hashes of all windows against those of the set, without
    texts; then, only where they agree, the texts. base must be a written table, as it is read twice."""
    few = lambda df: F.broadcast(df) if df.limit(broadcast_windows + 1).count() <= broadcast_windows else df
    near = None
    for n in lengths:
        one = base.select("rid", F.posexplode(F.expr(f"if(size(hw) >= {n}, transform(sequence(1, greatest(size(hw) - {n - 1}, 1)), i -> xxhash64(slice(hw, i, {n}))), array())")).alias("at", "h"))
        one = one.join(few(distinct.where(F.col("len") == n).select("h").distinct()), "h", "left_semi").select("rid", (F.col("at") + 1).alias("p"), F.lit(n).alias("len"))
        near = one if near is None else near.unionByName(one)
    near = near.groupBy("rid").agg(F.collect_list(F.struct("p", "len")).alias("near"))
    texts = base.select("rid", "w").join(near, "rid").select("rid", F.explode(F.expr("transform(near, x -> named_struct('p', x.p, 'len', x.len, 'win', array_join(slice(w, x.p, x.len), ' ')))")).alias("x")).select("rid", "x.*")
    sure = texts.join(few(distinct.select("len", "win").distinct()), ["len", "win"], "left_semi")
    hits = sure.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("p", "len", "win"))).alias("hits"))
    return base.join(hits, "rid", "left").withColumn("hits", F.coalesce("hits", F.expr("array()")))


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, set_windows: int = SET_WINDOWS, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(rid, doc_id, n_words, hits, items): hits are the verified windows of each document, items the items they are of."""
    wins = materialize(benchmark_windows(benchmark, item_col, "text", window), "windows")
    distinct = wins.select("len", "win", "h").distinct()
    held = distinct.limit(set_windows + 1).collect()
    lengths = sorted({r["len"] for r in held}) if len(held) <= set_windows else sorted(r[0] for r in wins.select("len").distinct().collect())
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words(text_col).alias("w"))
    base = base.select("rid", "doc_id", "w", F.size("w").cast("long").alias("n_words"), F.expr("transform(w, x -> xxhash64(x))").alias("hw"))
    kind = "array<struct<p:int,len:int,win:string>>"
    if not held:
        found = base.select("rid", "doc_id", "n_words", F.expr(f"cast(array() as {kind})").alias("hits"))
    elif len(held) <= set_windows:
        found = _positions_in_set(base, held, lengths).select("rid", "doc_id", "n_words", F.col("hits").cast(kind).alias("hits"))
    else:
        found = _hits_by_join(materialize(base, "words"), distinct, lengths, broadcast_windows).select("rid", "doc_id", "n_words", F.col("hits").cast(kind).alias("hits"))
    found = materialize(found, "hits")
    pairs = found.where("size(hits) > 0").select("rid", F.explode(F.expr("array_distinct(transform(hits, x -> x.win))")).alias("win"))
    of = wins.select("win", "item_id").distinct()
    items = pairs.join(F.broadcast(of) if len(held) <= set_windows else of, "win").groupBy("rid").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return found.join(items, "rid", "left").withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    A document word inside any occurrence of a benchmark window is hit. Contaminated: at least one word and at
    least a twentieth of the words are hit. Null and empty texts have no words and are clean; benchmark items
    without words are ignored, a null item_id counts as ''. Repeated rows are judged one by one. An empty
    benchmark leaves all documents clean. Other columns are not read.
    """
    found = find_hits(docs, benchmark, **options)
    hit = F.expr("size(array_distinct(flatten(transform(hits, x -> sequence(x.p, x.p + x.len - 1)))))").cast("long")
    out = found.withColumn("n_hit", F.when(F.size("hits") > 0, hit).otherwise(F.lit(0).cast("long")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, text, n_hit): the texts without the hit words; what stands between words stays.

    The text is carried along with the id, so rows that repeat, and null ids, are judged one by one. Null text is empty.
    """
    carried = docs.select(F.struct(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = find_hits(carried, benchmark, **options).select("doc_id.doc_id", "doc_id.text", F.expr("array_distinct(flatten(transform(hits, x -> sequence(x.p, x.p + x.len - 1))))").alias("cut"))
    parts = found.select("doc_id", "text", "cut", F.split("text", WORD_ANY_CASE).alias("gaps"), F.regexp_extract_all("text", F.lit(WORD_ANY_CASE), F.lit(0)).alias("own"))
    clean = F.expr("concat(gaps[0], array_join(transform(own, (x, i) -> concat(if(array_contains(cut, i + 1), '', x), gaps[i + 1])), ''))")
    return parts.select("doc_id", F.when(F.size("cut") > 0, clean).otherwise(F.col("text")).alias("text"), F.size("cut").cast("long").alias("n_hit"))
