"""The opN_ queries: each applies one operator to its whole table; ORACLES has SQL where SQL can express the result."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm import merkle
from kiln.llm.common import table
from kiln.llm.compact_windows import near_passages
from kiln.llm.decontaminate import contamination
from kiln.llm.exact_dedup import exact_dedup
from kiln.llm.language_id import language_id
from kiln.llm.packing import pack
from kiln.llm.periodic import periodic_runs
from kiln.llm.quality_rules import judged
from kiln.llm.secrets import secret_scan
from kiln.llm.simhash import near_duplicates
from kiln.llm.substring_dedup import substring_dedup
from kiln.llm.token_counts import token_counts
from kiln.llm.toxicity import toxicity


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its group that stays."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 100-byte strings that also start earlier: counts and the digest of what is left."""
    return substring_dedup(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that aren't held out."""
    return language_id(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by a public tokenizer."""
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that are in a window of a benchmark item."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2,048 tokens."""
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents share nearly; a row for each link."""
    return near_passages(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets of every document."""
    return secret_scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from the labels that aren't held out."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the manifest; of a third of them the text that is checked was put in lower case."""
    docs = table(spark, sf_dir, "documents")
    third = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    other = merkle.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), lowered])
    rows = merkle.manifest(docs, carry={"tampered": F.when(third, other)})
    rows = merkle.verified(rows.withColumn("now", F.coalesce("tampered", "leaf")), "now")
    proof = F.sha2(merkle.siblings(F.col("proof")).cast("binary"), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document; hosts are sources."""
    return judged(table(spark, sf_dir, "documents")).drop("host", "content", "removed")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs; those whose id has a crc32 divisible by 10 are made periodic from some word on."""
    docs = table(spark, sf_dir, "documents")
    hashed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g, words = F.floor(hashed / 10), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    first = lambda w: g % F.size(w)
    period = lambda w: 1 + F.floor((F.size(w) - first(w)) / (3 + g % 8))
    # Each of the three is bound once for all words of a document.
    bound = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    repeated = bound(words, lambda w: bound(first(w), lambda a: bound(period(w), lambda p: F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " "))))
    text = F.when((hashed % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), repeated).otherwise(F.col("text"))
    runs = periodic_runs(docs.select("doc_id", text.alias("text")))
    best = F.get(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.signum(y["length"] - x["length"]).cast("int")).when(x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int")).otherwise(F.signum(x["period"] - y["period"]).cast("int"))), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    runs = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return runs.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_suffix_array_dedup, op3_language_id, op4_token_counts, op5_decontamination, op6_packing, op7_compact_windows, op8_simhash, op9_secret_scan, op10_toxicity, op11_merkle_manifest, op12_quality_rules, op13_periodic_runs)}

_EXACT = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
b AS (SELECT norm, doc_id AS keep_id, row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS r, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT n.doc_id, b.keep_id, b.group_size, n.doc_id = b.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN b ON n.norm = b.norm AND b.r = 1
"""

_CONTAMINATION = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
ls AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w JOIN ls ON len(w) >= n)),
h AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

def _manifest_sql(most: int = 8) -> str:
    """Level by level, for trees of up to 8 ** most leaves."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    row = lambda text: "sha256(" + " || ".join([*map(value, ("doc_id", "source", "lang", "n_chars")), value(text)]) + ")"
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    bit = "lambda x, y: xor(x >> 1, (x & 1) * 3988292384)"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {bit})))"
    parts = [f"l AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {row('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {row(lowered)} ELSE {row('text')} END AS now FROM documents)"]
    parts += ["d AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS place FROM l)"]

    def levels(p: str, nodes: str) -> str:
        parts.append(f"{p}0 AS ({nodes})")
        for k in range(1, most + 1):
            parts.append(f"{p}{k} AS (SELECT tree, place // 8 AS place, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY place)) END AS h, (any_value(n) + 7) // 8 AS n FROM {p}{k - 1} GROUP BY tree, place // 8)")
        return f"{p}{most}"

    def up(p: str, rows: str, start: str) -> str:
        """rows (.., tree, place, node, sib): node is folded up to the root, siblings are put together."""
        last = rows
        for k in range(most):
            run = f"s{p}{k} AS (SELECT tree, place // 8 AS run, any_value(n) AS n, list(h ORDER BY place) AS hs FROM {p}{k} GROUP BY tree, place // 8)"
            left, right = "array_to_string(hs[1:r.place % 8], '')", "array_to_string(hs[r.place % 8 + 2:], '')"
            parts.append(run)
            parts.append(f"{start}{k} AS (SELECT r.* EXCLUDE (place, node, sib), r.place // 8 AS place, CASE WHEN n = 1 THEN node ELSE sha256({left} || node || {right}) END AS node, sib || CASE WHEN n = 1 THEN '' ELSE {left} || {right} END AS sib FROM {last} r JOIN s{p}{k} s ON r.tree = s.tree AND r.place // 8 = s.run)")
            last = f"{start}{k}"
        return last

    low = levels("a", "SELECT tree, place, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM d")
    top = levels("b", f"SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, h, count(*) OVER () AS n, tree AS name FROM {low}")
    parts.append("f AS (SELECT doc_id, leaf, tree, place, now AS node, '' AS sib FROM d)")
    done = up("a", "f", "u")
    parts.append(f"g AS (SELECT x.doc_id, x.leaf, b0.h AS subroot, '' AS tree, b0.place, x.node, x.sib FROM {done} x JOIN b0 ON b0.name = x.tree)")
    done = up("b", "g", "v")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, {top}.h AS root, sha256(sib) AS proof_sha256, node AS folded_root, node = {top}.h AS verified FROM {done} CROSS JOIN {top}"


_QUALITY = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
n AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS k, translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS norm FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM n GROUP BY doc_id),
f AS (SELECT c.source, norm FROM (SELECT source, norm, count(DISTINCT t) AS docs FROM n GROUP BY source, norm) c JOIN (SELECT source, count(DISTINCT t) AS host_docs FROM d GROUP BY source) h ON c.source IS NOT DISTINCT FROM h.source WHERE docs > 10 AND docs > host_docs * 0.05::DOUBLE),
gone AS (SELECT doc_id, sum(k)::BIGINT AS n_removed_words FROM n JOIN f ON n.source IS NOT DISTINCT FROM f.source AND n.norm = f.norm GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY doc_id),
base AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_words, 0) AS n_removed_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_removed_words <= n_words AS kept FROM base
"""

ORACLES: dict[str, str] = {"op1_exact_dedup": _EXACT, "op5_decontamination": _CONTAMINATION, "op11_merkle_manifest": _manifest_sql(), "op12_quality_rules": _QUALITY}
