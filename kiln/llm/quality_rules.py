"""Quality rules: figures of each text, and lines that too many documents of one host share.

Normalised lines are hashed, distinct documents are counted per host and line, lines above the limits are removed, and
documents of which too little is left are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import few, mapped, materialize, slices, text_or_empty

SYMBOLS = b"#*$%&|<>"
#: Lines (40 bytes each) that are broadcast, at most.
BROADCAST_LINES = 200_000
_INSIDE = bytes(range(0x80, 0xC0))  # bytes of a code point after its first
_SPACE = b" \t\n\x0b\x0c\r"
_NORMAL = bytes(ord("0") if chr(c) in "123456789" else c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Limits:
    """A line is removed if more than max(documents, share * the host's documents) distinct documents of the host have it.
    A document is rejected if it has fewer than `words` words, more than `repeated` of its words are in windows of three
    that occur again, or more than `depleted` of its words are in removed lines."""

    documents: int = 10
    share: float = 0.05
    words: int = 50
    repeated: float = 0.5
    depleted: float = 0.5


def normalised_line(words: list[bytes]) -> bytes:
    """Words of a line in lower case (A-Z), digits as 0, one blank between."""
    return b" ".join(words).translate(_NORMAL)


def repeat_words(words: list[list[bytes]]) -> np.ndarray:
    """Per text the words that are in a window of three words that the text has twice or more."""
    n = np.array([len(w) for w in words], "i8")
    flat = [x for w in words for x in w]
    number = {x: i for i, x in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(number.__getitem__, flat), "i8", len(flat))
    text = np.repeat(np.arange(len(n)), n)
    first = np.flatnonzero(text[:-2] == text[2:]) if len(ids) > 2 else np.zeros(0, "i8")
    if not len(first):
        return np.zeros(len(n), "i8")
    size = len(number)  # numbers of pairs, then of windows, each text's own
    own = np.unique(text[first] * size + ids[first], return_inverse=True)[1]
    pair = np.unique(own * size + ids[first + 1], return_inverse=True)[1]
    window, count = np.unique(pair * size + ids[first + 2], return_inverse=True, return_counts=True)[1:]
    hit = np.zeros(len(ids) + 1, "?")
    for k in range(3):
        hit[first[count[window] > 1] + k] = True
    return np.bincount(text[hit[:-1]], minlength=len(n))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(row, doc_id, host, content, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines): lines (line, a, b,
    words) are those with a word, by their number from 0 and the 128 bits of their hash; host and content are hashes."""
    host = F.when(F.col(host_col).isNotNull(), F.xxhash64(F.concat(F.lit("="), F.col(host_col).cast("string")))).otherwise(F.lit(0))
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), host.alias("host"), F.xxhash64(text_or_empty(text_col)).alias("content"), text_or_empty(text_col).alias("text"))
    names = ["row", "doc_id", "host", "content"]

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for start, end in slices(texts):
            mine = texts[start:end]
            words = [t.split() for t in mine]  # by ASCII white space
            ends, listed, dups = [0], [], []
            for t in mine:
                seen, with_word = set(), 0
                for i, line in enumerate(t.split(b"\n")):
                    if w := line.split():
                        with_word += 1
                        seen.add(line)
                        h = xxhash.xxh3_128_intdigest(normalised_line(w))
                        listed.append((i, _signed(h >> 64), _signed(h & (1 << 64) - 1), len(w)))
                ends.append(len(listed))
                dups.append(with_word - len(seen))
            flat = np.array(listed, "i8").reshape(-1, 4)
            lines = pa.StructArray.from_arrays([pa.array(flat[:, 0].astype("i4")), pa.array(flat[:, 1]), pa.array(flat[:, 2]), pa.array(flat[:, 3].astype("i4"))], ["line", "a", "b", "words"])
            yield {
                **{k: batch.column(k).slice(start, end - start) for k in names},
                "n_words": [len(w) for w in words],
                "word_chars": [len(t.translate(None, _INSIDE + _SPACE)) for t in mine],
                "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in mine],
                "n_dup_lines": dups,
                "n_repeat_words": repeat_words(words),
                "lines": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines),
            }

    kind = slim.schema["doc_id"].dataType.simpleString()
    return mapped(slim, run, f"row long, doc_id {kind}, host long, content long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:int,a:long,b:long,words:int>>")


def frequent_lines(scanned: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(host, a, b, n): lines that more distinct documents of their host have than the limits allow.

    Documents with equal texts are one. Whoever has a very common line, the documents of a line are counted apart from
    each other, so no task gets them all.
    """
    pairs = scanned.select("host", "content", F.explode("lines").alias("x")).select("host", "x.a", "x.b", "content").distinct()
    counts = pairs.groupBy("host", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") > limits.documents)
    hosts = scanned.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("of"))
    counts = materialize(counts, "quality-counts")
    return counts.join(few(hosts, BROADCAST_LINES), "host").where(F.col("n") > F.col("of") * limits.share).drop("of")


def _removed(scanned: DataFrame, frequent: DataFrame, broadcast_lines: int) -> DataFrame:
    """(row, n_removed_words, removed): numbers of the lines of each row that are removed.

    Beyond broadcast_lines, the lines that most documents have are broadcast (there are fewer than broadcast_lines of them,
    by what each takes of all lines), and the others, of which none is hot, are joined by shuffle.
    """
    each = scanned.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.*")
    keys, on = frequent.select("host", "a", "b"), ["host", "a", "b"]
    if frequent.limit(broadcast_lines + 1).count() <= broadcast_lines:
        hits = each.join(F.broadcast(keys), on, "left_semi")
    else:
        total = scanned.agg(F.sum(F.size("lines"))).first()[0]
        hot = F.col("n") > max(1, total // broadcast_lines)
        top, rest = frequent.where(hot).select(on), frequent.where(~hot).select(on)
        hits = each.join(F.broadcast(top), on, "left_semi").unionByName(each.join(F.broadcast(top), on, "left_anti").join(rest, on, "left_semi"))
    return hits.groupBy("row").agg(F.sum("words").alias("n_removed_words"), F.sort_array(F.collect_list("line")).alias("removed"))


def judged(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_removed_words, removed (numbers of the removed lines), host and content (hashes of host and text).

    Words are what stands between ASCII white space. Lines are split at newlines; those without a word don't count. A
    line is the same as another if both are after ASCII lower case, digits as 0 and single blanks. Null text is empty and
    fails for want of words; a null host is a host of its own. Repeated rows and equal texts of a host are one document
    in counts, but each has its row. An empty table gives an empty result. Further columns of docs are not read.
    """
    scanned = materialize(scan(docs, id_col, text_col, host_col), "quality-lines")
    frequent = materialize(frequent_lines(scanned, limits), "quality-frequent")
    failed = (F.col("n_words") < limits.words) | (F.col("n_repeat_words") > F.col("n_words") * limits.repeated)
    out = scanned.drop("lines").join(_removed(scanned, frequent, broadcast_lines), "row", "left")
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long")).withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_removed_words") <= F.col("n_words") * limits.depleted)).drop("row")


def cleaned(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that are kept, all their columns, texts without the removed lines. As `judged`; repeated rows stay."""
    verdict = judged(docs, limits, id_col, text_col, host_col).select(F.col("doc_id").alias("__id"), F.col("host").alias("__host"), F.col("content").alias("__content"), "kept", "removed")
    verdict = verdict.where("not kept or size(removed) > 0").distinct().withColumnsRenamed({"kept": "__kept", "removed": "__removed"})
    host = F.when(F.col(host_col).isNotNull(), F.xxhash64(F.concat(F.lit("="), F.col(host_col).cast("string")))).otherwise(F.lit(0))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (host == F.col("__host")) & (F.xxhash64(text_or_empty(text_col)) == F.col("__content"))
    rows = docs.join(few(verdict, BROADCAST_LINES), same, "left").where(F.coalesce("__kept", F.lit(True)))
    gone = F.transform(F.split(text_or_empty(text_col), "\n"), lambda x, i: F.when(~F.array_contains("__removed", i), x))
    text = F.when(F.coalesce(F.size("__removed"), F.lit(0)) > 0, F.array_join(F.filter(gone, lambda x: x.isNotNull()), "\n")).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).select(*docs.columns)
