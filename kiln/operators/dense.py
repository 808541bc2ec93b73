"""Dense retrieval: dot products of unit vectors, all queries against all documents, block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.operators.index import Index
from kiln.operators.ranked import DIGITS, top

#: Query vectors sent to every task; more are searched in runs of this many.
QUERIES = 4096
#: Scores of a block that a task multiplies out at a time (8 bytes each).
SCORES = 1 << 21


def encode(docs: DataFrame, encoder: Callable[[list[str]], np.ndarray], id_col: str = "doc_id", text_col: str = "text", batch: int = 64) -> DataFrame:
    """(doc_id, embedding): encoder turns up to `batch` texts into rows of numbers, which are made unit vectors.

    The encoder is handed in (a sentence model, loaded once per worker on its first call); null text is the empty text.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = [np.asarray(encoder(texts[i : i + batch]), "f8") for i in range(0, len(texts), batch)]
            if rows:
                x = np.concatenate(rows)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.astype("f4").tolist(), pa.list_(pa.float32()))], names=["doc_id", "embedding"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, embedding array<float>")


def embeddings(index: Index, encoder: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """(doc_id, embedding) of a snapshot's documents with one text column, made once and kept with it if it keeps; a
    snapshot with more documents, and one that was released, encodes anew. One encoder per snapshot."""
    return index._once("embeddings", lambda: encode(index.docs, encoder, index.id_col, index.text_col, batch))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Best:
    """The k best documents so far of each of n queries; ties go by id. Holds n * k scores and one block."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.at, self.keys, self.scores = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)
        self.least = np.full(n, -np.inf)

    def add(self, keys: np.ndarray, x: np.ndarray, q: np.ndarray) -> None:
        """Documents (rows of x) by their keys, for the queries (rows of q)."""
        step = max(1, SCORES // max(1, self.n))
        for a in range(0, len(keys), step):
            scores = np.round(q @ x[a : a + step].T, DIGITS)
            low = self.least
            if scores.shape[1] > self.k:
                low = np.maximum(low, np.partition(scores, -self.k, axis=1)[:, -self.k])
            at, of = np.nonzero(scores >= low[:, None])  # ties with the k-th stay until ids are compared
            if len(at):
                self._put(at, keys[a : a + step][of], scores[at, of])

    def _put(self, at: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        at, keys, scores = (np.concatenate(x) for x in ((self.at, at), (self.keys, keys), (self.scores, scores)))
        order = np.lexsort((keys, -scores, at))
        at, keys, scores = at[order], keys[order], scores[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < self.k
        self.at, self.keys, self.scores = at[kept], keys[kept], scores[kept]
        last = place == self.k - 1
        self.least[at[last]] = scores[last]

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids[self.at]), pa.array(self.keys), pa.array(self.scores)], names=["qid", "doc_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(qid, rank, doc_id, score) of the k best of vectors (doc ids: id_col) for each query (id_col, vector_col).

    Blocks of documents are multiplied with the queries one after another; only a task's k best per query go on to the ranking. Null
    or empty vectors are left out. Scores are rounded to six digits before ranking, ties go by id.
    """
    held = queries.where(f"size({vector_col}) > 0").select(F.col(id_col).cast("long"), vector_col)
    n, out = held.count(), None
    parts = max(1, -(-n // QUERIES))
    for part in range(parts):
        mine = held if parts == 1 else held.where(F.pmod(F.xxhash64(id_col), F.lit(parts)) == part)
        rows = mine.collect()  # at most about QUERIES vectors
        if not rows:
            continue
        ids, q = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], "f8")

        def run(batches: Iterable[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            best = Best(len(ids), k)
            for b in batches:
                if b.num_rows:
                    best.add(b.column(0).to_numpy(), _matrix(b.column(1)), q)
            yield best.batch(ids)

        one = vectors.where(f"size({vector_col}) > 0").select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, "qid long, doc_id long, score double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "qid long, rank int, doc_id long, score double")
    return top(out, k, "doc_id").select("qid", "rank", "doc_id", "score")
