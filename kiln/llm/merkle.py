"""Merkle manifest of a dataset: one tree per value of a column, one tree over their roots, a proof for every row.

Rows are put in order by a range shuffle of their digests (texts are hashed in the scan and never moved) and dealt into
aligned blocks of fanout ** levels leaves. A block is walked by fractal traversal: for each layer of the block's tree an
existing subtree gives the siblings of the present leaf, while the desired next one grows by one leaf a step, so that a
walk holds two subtrees a layer beside the block's leaves. Roots of blocks are the leaves of the next round of blocks,
until each tree has one; on the way back the proofs of a round are appended to those of the blocks below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.common import few, mapped, materialize

FANOUT = 8
#: Levels of a block: it has FANOUT ** LEVELS leaves. Levels of a subtree of the traversal.
LEVELS, HEIGHT = 3, 1
#: Paths of blocks (about 3 kB each) that are broadcast; more are joined by shuffle.
BROADCAST_PATHS = 4096
HEX = 64
PROOF = "array<struct<position:int,siblings:string>>"


def leaf(columns: list[Column]) -> Column:
    """SHA-256 (lowercase hex) of the values one after another: `-` for null, else bytes in UTF-8, `:` and the value."""
    value = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(value, columns)).cast("binary"), 256)


def folded(leaf_: Column, proof: Column) -> Column:
    """The root that a leaf and its proof (lowest level first) give."""
    up = lambda node, x: F.sha2(F.concat(F.substring(x["siblings"], F.lit(1), x["position"] * HEX), node, F.substring(x["siblings"], x["position"] * HEX + 1, F.length(x["siblings"]))).cast("binary"), 256)
    return F.aggregate(proof, leaf_, up)


def siblings(proof: Column) -> Column:
    """All siblings of a proof, from the lowest level up, each level from left to right, as one string."""
    return F.array_join(F.transform(proof, lambda x: x["siblings"]), "")


def _h(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def depth_of(n: int, fanout: int) -> int:
    """Levels above n nodes until one is left."""
    depth = 0
    while n > 1:
        n, depth = -(-n // fanout), depth + 1
    return depth


class _Subtree:
    """The nodes of one subtree from level low to below level high, grown leaf by leaf."""

    def __init__(self, start: int, low: int, high: int, fanout: int):
        self.low, self.high, self.fanout, self.next = low, high, fanout, start
        self.runs: list[list[bytes]] = [[] for _ in range(high)]
        self.rows: list[list[bytes]] = [[] for _ in range(low, high)]
        self.root = b""

    def put(self, node: bytes, level: int = 0) -> None:
        while level < self.high:
            if level >= self.low:
                self.rows[level - self.low].append(node)
            run = self.runs[level]
            run.append(node)
            if len(run) < self.fanout:
                return
            node, level = _h(run), level + 1
            run.clear()
        self.root = node

    def grow(self, leaves: list[bytes], end: int) -> None:
        """One step: the next leaf, if there is one before end."""
        if self.next < end:
            self.put(leaves[self.next])
        self.next += 1

    def close(self, leaves: list[bytes], end: int) -> _Subtree:
        """What is left is grown, and runs that the end of the leaves cuts short are hashed as they are."""
        while self.next < end:
            self.grow(leaves, end)
        for level in range(self.high):
            if run := self.runs[level][:]:
                self.runs[level].clear()
                self.put(_h(run), level + 1)
        return self


class Traversal:
    """Root and successive proofs of the leaves of one block, `depth` levels high."""

    def __init__(self, leaves: list[bytes], depth: int, fanout: int = FANOUT, height: int = HEIGHT):
        self.leaves, self.depth, self.fanout = leaves, depth, fanout
        self.layers = [(low, min(low + height, depth)) for low in range(0, depth, height)]

    def _begin(self, layer: int, start: int) -> _Subtree:
        return _Subtree(start, *self.layers[layer], self.fanout)

    def root(self) -> bytes:
        """In memory of one open run a level."""
        if not self.depth:
            return self.leaves[0]
        return _Subtree(0, self.depth, self.depth, self.fanout).close(self.leaves, len(self.leaves)).root

    def proofs(self) -> Iterator[list[tuple[int, bytes]]]:
        """Per leaf, from the lowest level up: place in its run, the others of the run."""
        n, span = len(self.leaves), [self.fanout**high for _, high in self.layers]
        end = lambda k, at: min(n, at - at % span[k] + span[k])
        exist = [self._begin(k, 0).close(self.leaves, end(k, 0)) for k in range(len(span))]
        desired = [self._begin(k, span[k]) for k in range(len(span))]
        for at in range(n):
            path = []
            for k, (low, high) in enumerate(self.layers):
                if at and at % span[k] == 0:  # the existing subtree is used up
                    exist[k], desired[k] = desired[k].close(self.leaves, end(k, at)), self._begin(k, at + span[k])
                for level, row in zip(range(low, high), exist[k].rows, strict=True):
                    i = at % span[k] // self.fanout**level
                    j, place = i - i % self.fanout, i % self.fanout
                    path.append((place, b"".join(row[j:i]) + b"".join(row[i + 1 : j + self.fanout])))
                desired[k].grow(self.leaves, min(n, at - at % span[k] + 2 * span[k]))
            yield path


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `at`, their place in their tree, and `total`, its rows. order must tell all rows apart, so that the ranges
    are even whatever repeats; only counts per range and tree are put together."""
    keys = ["tree", *order]
    placed = materialize(rows.repartitionByRange(*map(F.col, keys)).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    w = Window.partitionBy("tree").orderBy("part")
    parts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    parts = parts.select("tree", "part", (F.sum("n").over(w) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    return placed.join(few(parts, 200_000), ["tree", "part"]).withColumn("at", F.col("at") + F.col("shift")).drop("part", "shift")


def _pack(nodes: DataFrame, width: int) -> DataFrame:
    """(tree, block, alone, total, items): a row per aligned block, items in order; alone: it is all of its tree."""
    others = [c for c in nodes.columns if c not in ("tree", "total")]
    items = nodes.groupBy("tree", "total", F.floor(F.col("at") / width).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", *(c for c in others if c != "at")))).alias("items"))
    return materialize(items.select("tree", "block", "total", (F.col("total") <= width).alias("alone"), "items"), "merkle-blocks")


def _leaves(column: pa.ListArray, i: int) -> list[bytes]:
    return [x.encode() for x in column[i].values.field("digest").to_pylist()]


def _roots(packed: DataFrame, levels: int, fanout: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out = []
        for i, alone in enumerate(batch.column("alone").to_pylist()):
            nodes = _leaves(batch.column("items"), i)
            out.append(Traversal(nodes, depth_of(len(nodes), fanout) if alone else levels, fanout).root().decode())
        yield {"tree": batch.column("tree"), "at": batch.column("block"), "alone": batch.column("alone"), "total": batch.column("total"), "digest": out}

    slim = packed.select("tree", "block", "alone", "total", F.transform("items", lambda x: F.struct(x["digest"].alias("digest"))).alias("items"))
    return materialize(mapped(slim, run, "tree string, at long, alone boolean, total long, digest string"), "merkle-roots")


def _walk(packed: DataFrame, above: DataFrame, levels: int, fanout: int, height: int) -> DataFrame:
    """The nodes of packed blocks, with proofs: their paths inside the block, then above (tree, block, proof, ...)."""
    inner = packed.schema["items"].dataType.elementType
    more = [f for f in above.schema.fields if f.name not in ("tree", "block", "proof")]
    schema = ", ".join(["tree string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in [*inner.fields, *more]), f"proof {PROOF}"])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        items, alone, tops = batch.column("items"), batch.column("alone").to_pylist(), batch.column("proof").to_pylist()
        for i in range(batch.num_rows):
            nodes = _leaves(items, i)
            top = [(x["position"], x["siblings"].encode()) for x in tops[i]]
            paths = [p + top for p in Traversal(nodes, depth_of(len(nodes), fanout) if alone[i] else levels, fanout, height).proofs()]
            ends = np.cumsum([0, *map(len, paths)])
            places = pa.array([x[0] for p in paths for x in p], pa.int32())
            texts = pa.array([x[1] for p in paths for x in p], pa.binary()).cast(pa.string())
            proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([places, texts], ["position", "siblings"]))
            rows, at = items[i].values, pa.array(np.full(len(nodes), i))
            yield {"tree": batch.column("tree").take(at), **{f.name: rows.field(f.name) for f in inner.fields}, **{f.name: batch.column(f.name).take(at) for f in more}, "proof": proof}

    return mapped(packed.join(few(above, BROADCAST_PATHS), ["tree", "block"]), run, schema, rows=64)


class _Forest:
    """Trees over nodes (tree, at, total, digest, ...): their roots, and then the proofs of all nodes."""

    def __init__(self, nodes: DataFrame, levels: int, fanout: int, height: int):
        self.rounds: list[DataFrame] = []
        self.options, tops, width = (levels, fanout, height), [], fanout**levels
        while True:
            packed = _pack(nodes, width)
            roots = _roots(packed, levels, fanout)
            self.rounds.append(packed)
            tops.append(roots.where("alone").select("tree", "digest"))
            nodes = roots.where("not alone").select("tree", "at", F.ceil(F.col("total") / width).alias("total"), "digest")
            if nodes.isEmpty():
                break
        self.roots = reduce(DataFrame.unionByName, tops)

    def proofs(self, above: DataFrame) -> DataFrame:
        """above: tree, proof (of the tree's root) and more columns; they come with every node of the tree."""
        paths = None
        for packed in reversed(self.rounds):
            own = packed.where("alone").select("tree", "block").join(few(above, BROADCAST_PATHS), "tree")
            own = own if paths is None else own.unionByName(paths)
            out = _walk(packed, own, *self.options)
            if packed is not self.rounds[0]:
                paths = materialize(out.withColumnRenamed("at", "block").select(*own.columns), "merkle-paths")
        return out


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree_col: str = "lang", id_col: str = "doc_id", carry: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS, height: int = HEIGHT) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof, and the columns of carry (over docs).

    A row's leaf is the digest of its columns. The leaves of each value of tree_col ascend by id; runs of fanout nodes
    become their digest (the last run may have fewer, even one) while there are several nodes, which leaves the subroot.
    Subroots, null first and then by their bytes, give the root in the same way. proof has an element per level, the
    lowest first: position in the run, and the other nodes of the run, from left to right, as one string of hex digests;
    `folded` gives the root from it. A change of any row changes the root.

    Null values have a mark of their own in a leaf, null tree values are a tree, null ids come first. Rows with one id
    are ordered by their leaf; equal rows are leaves of their own, whose proofs differ. An empty table gives an empty
    result, without a root. Further columns of docs are not read. Long texts are hashed where they are read.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit(""))  # null first, then bytewise
    extra = carry or {}
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf([F.col(c) for c in columns]).alias("digest"), *(c.alias(f"c_{k}") for k, c in extra.items()), F.monotonically_increasing_id().alias("seq"))
    rows = _ranked(materialize(rows, "merkle-leaves"), ["id", "digest", "seq"]).drop("seq")
    lower = _Forest(rows, levels, fanout, height)
    subroots = lower.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    upper = _Forest(_ranked(subroots, ["name"]), levels, fanout, height)
    start = upper.roots.select("tree", F.lit(None).cast(PROOF).alias("proof"), F.col("digest").alias("root")).withColumn("proof", F.coalesce("proof", F.array().cast(PROOF)))
    tops = upper.proofs(start).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "proof")
    out = lower.proofs(materialize(tops, "merkle-subroots"))
    return out.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "proof", *(F.col(f"c_{k}").alias(k) for k in extra))


def verified(rows: DataFrame, leaf_col: str = "leaf") -> DataFrame:
    """rows of a manifest with folded_root, from leaf_col and the proof, and verified, whether that is the root. A null
    leaf gives null."""
    fold = folded(F.col(leaf_col), F.col("proof"))
    return rows.withColumn("folded_root", fold).withColumn("verified", F.col("folded_root") == F.col("root"))
