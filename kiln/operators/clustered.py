"""Exact dense retrieval that passes over clusters of vectors which can't matter.

Vectors are put to the nearest of some centres (k-means over a sample; any centres give right results, better ones save
more). With c the centre and r the radius of a cluster, no dot product with a query q is over q c + |q| r. A query's
clusters with the largest bounds are visited first, which gives its k-th best score so far; of the others only those
whose bound reaches it are. Queries and vectors meet by joins on the cluster, as blocks of a matrix product.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators.dense import Best
from kiln.operators.ranked import DIGITS, small, top
from kiln.operators.spectral import Tables, large_rows, shared_folder

#: Centres at most, vectors of the sample they are fitted on, vectors and queries of a block, clusters visited first.
CENTRES, SAMPLE, BLOCK, QUERIES, SEEDS = 1024, 50_000, 2048, 512, 2
SLACK = 2 * 10.0**-DIGITS


@dataclass(frozen=True)
class Clusters:
    """blocks: (cluster, n, ids, x): up to BLOCK vectors of a cluster, x by rows; radii: (cluster, radius, n); centres."""

    blocks: DataFrame
    radii: DataFrame
    centres: np.ndarray

    @property
    def n(self) -> int:
        return self.radii.agg(F.sum("n")).first()[0] or 0


def _centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ centres.T * 2 - (centres**2).sum(1)).argmax(1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", centres: int | None = None, sample: int = SAMPLE) -> Clusters:
    """Null and empty vectors are left out. The sample is of at most about `sample` rows; all vectors are put to a centre.
    By default there are as many centres as the square root of the vectors, up to CENTRES. Tables are in the shared folder."""
    spark = vectors.sparkSession
    held = vectors.where(F.size(vector_col) > 0).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    n = held.count()
    some = held if n <= sample else held.sample(sample / n, 1)
    x = np.array([r["x"] for r in some.select("x").limit(2 * sample).collect()], "f8")
    c = _centres(x, min(len(x), centres or min(CENTRES, max(1, int(n**0.5))))) if n else np.zeros((0, 0))

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                near = (v @ c.T * 2 - (c**2).sum(1)).argmax(1)
                far = np.linalg.norm(v - c[near], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in v], pa.binary()), pa.array(near.astype("i4")), pa.array(far)], names=["id", "x", "cluster", "far"])

    path = f"{shared_folder(spark)}/clusters/{uuid.uuid4().hex}"
    held.mapInArrow(put, "id long, x binary, cluster int, far double").write.parquet(f"{path}/rows")
    rows = spark.read.schema("id long, x binary, cluster int, far double").parquet(f"{path}/rows")
    radii = rows.groupBy("cluster").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / BLOCK)
    dealt = rows.join(F.broadcast(radii.select("cluster", parts.alias("parts"))), "cluster").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def pack(t: pa.Table) -> pa.Table:
        ids, x = t["id"].to_numpy(), b"".join(t["x"].to_pylist())
        return pa.table({"cluster": t["cluster"].slice(0, 1), "n": pa.array([len(ids)]), "ids": pa.array([ids.tobytes()], pa.binary()), "x": pa.array([x], pa.binary())})

    dealt.select("cluster", "part", "id", "x").groupBy("cluster", "part").applyInArrow(pack, "cluster int, n long, ids binary, x binary").write.parquet(f"{path}/blocks")
    radii.write.parquet(f"{path}/radii")
    read = spark.read
    return Clusters(read.schema("cluster int, n long, ids binary, x binary").parquet(f"{path}/blocks"), read.schema("cluster int, radius double, n long").parquet(f"{path}/radii"), c)


def _products(clusters: Clusters, wanted: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score): of each block the k best for the queries (qid, q, cluster) that ask for its cluster."""
    dim = clusters.centres.shape[1]
    packed = wanted.groupBy("cluster", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-wanted.select("qid").distinct().count() // QUERIES)))).alias("part")).agg(F.collect_list(F.struct("qid", "q")).alias("asked"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):  # one at a time, without Python objects: a row holds megabytes
                ids, x = np.frombuffer(b.column(0)[row].as_buffer(), "i8"), np.frombuffer(b.column(1)[row].as_buffer(), "f8").reshape(-1, dim)
                asked = b.column(2)[row].values
                qids, q = asked.field("qid").to_numpy(), asked.field("q").flatten().to_numpy().reshape(-1, dim)
                best = Best(len(qids), k)
                best.add(ids, x, q)
                yield best.batch(qids)

    with large_rows(clusters.blocks.sparkSession):
        return Tables(clusters.blocks.sparkSession).put(_multiplied(clusters, packed, run))


def _multiplied(clusters: Clusters, packed: DataFrame, run) -> DataFrame:
    return clusters.blocks.join(packed, "cluster").select("ids", "x", "asked").mapInArrow(run, "qid long, doc_id long, score double")


@dataclass(frozen=True)
class Visit:
    """rows, and the pairs (qid, cluster, n) of which the dot products were made."""

    rows: DataFrame
    visited: DataFrame


def visit(clusters: Clusters, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", seeds: int = SEEDS) -> Visit:
    """As `search`, with what is visited."""
    spark = queries.sparkSession
    asked = queries.where(F.size(vector_col) > 0).select(F.col(id_col).cast("long").alias("qid"), F.col(vector_col).cast("array<double>").alias("q"))
    if not len(clusters.centres):
        return Visit(spark.createDataFrame([], "qid long, rank int, doc_id long, score double"), spark.createDataFrame([], "qid long, cluster int, n long"))
    centres = clusters.centres

    def bound(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                at, of = np.indices((b.num_rows, len(centres))).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(of.astype("i4")), pa.array((q @ centres.T).ravel()), pa.array(np.linalg.norm(q, axis=1)[at])], names=["qid", "cluster", "near", "norm"])

    bounds = asked.mapInArrow(bound, "qid long, cluster int, near double, norm double").join(F.broadcast(clusters.radii), "cluster")  # at most CENTRES
    falling = Window.partitionBy("qid").orderBy(F.desc("bound"), "cluster")
    bounds = bounds.select("qid", "cluster", "n", (F.col("near") + F.col("norm") * F.col("radius")).alias("bound")).withColumn("place", F.row_number().over(falling)).persist()
    first = bounds.where(F.col("place") <= seeds)
    found = _products(clusters, first.select("qid", "cluster").join(asked, "qid"), k)
    least = top(found, k, "doc_id").where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    rest = bounds.where(F.col("place") > seeds).join(small(least), "qid", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
    more = _products(clusters, rest.select("qid", "cluster").join(asked, "qid"), k)
    rows = top(found.unionByName(more).distinct(), k, "doc_id").select("qid", "rank", "doc_id", "score")
    return Visit(rows, first.select("qid", "cluster", "n").unionByName(rest.select("qid", "cluster", "n")))


def search(clusters: Clusters, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(qid, rank, doc_id, score): the rows of `dense.search` over the vectors; ids are distinct."""
    return visit(clusters, queries, k, id_col, vector_col).rows
