"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import held_out, mapped, slices

DIM = 1024
LETTERS = 128
#: Characters of a text that are worked on at a time; the last two letters are carried over.
SEGMENT = 1_000_000
MAX_LANGUAGES = 10_000


@functools.cache
def _letter_codes() -> np.ndarray:
    """Code of each code point: 0 for what is no letter, 1 to 26 for a-z, the rest by their code points."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = cp - 96 if "a" <= c <= "z" else 27 + cp * 2654435761 % 4294967296 % (LETTERS - 27)
    return out


@functools.cache
def _letter_vectors(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random letter vectors of -1 and 1, as they are and permuted (rolled) once and twice."""
    base = np.random.default_rng(20240229).integers(0, 2, (LETTERS, dim), dtype=np.int8) * 2 - 1
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def trigram_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Bound vectors: permuted twice (first letter) x permuted once (second) x third."""
    a, b, c = _letter_vectors(dim)
    return (a[codes >> 14] * b[codes >> 7 & 127] * c[codes & 127]).astype("f4")


def trigrams(text: str | None) -> np.ndarray:
    """Codes of the letter trigrams of the whole text; anything between letters counts as one blank."""
    if not text:
        return np.zeros(0, np.int64)
    text = text.lower()
    table, out, carry = _letter_codes(), [], np.zeros(1, np.int64)
    for i in range(0, len(text), SEGMENT):
        x = table[np.frombuffer(text[i : i + SEGMENT].encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
        x = np.concatenate([carry, x] if i + SEGMENT < len(text) else [carry, x, np.zeros(1, np.int64)])
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
        x = x[keep]
        out.append(x[:-2] << 14 | x[1:-1] << 7 | x[2:])
        carry = x[-2:]
    return np.concatenate(out)


def _bundles(texts: list[str | None], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of each text, and whether it has letters."""
    codes = [trigrams(t) for t in texts]
    n = np.array([len(c) for c in codes])
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    if not len(flat):
        return np.zeros((len(texts), dim), "f4"), n > 0
    used = np.flatnonzero(np.bincount(flat, minlength=1))
    at = np.zeros(int(used[-1]) + 1, np.int64)
    at[used] = np.arange(len(used))
    counts = np.bincount(np.repeat(np.arange(len(texts)), n) * len(used) + at[flat], minlength=len(texts) * len(used)).reshape(len(texts), len(used))
    out = np.zeros((len(texts), dim), "f4")
    for i in range(0, len(used), 8192):
        out += counts[:, i : i + 8192].astype("f4") @ trigram_vectors(used[i : i + 8192], dim)
    return out, n > 0


def prototypes(docs: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their bundled vectors over all of docs (text, lang). Of the corpus, only the sums
    (languages x dim numbers) come to the driver."""

    def summed(batch: pa.RecordBatch):
        x = batch.to_pydict()
        sums: dict[str, np.ndarray] = {}
        for a, b in slices(x["text"]):
            vectors, _ = _bundles(x["text"][a:b], dim)
            for lang in set(x["lang"][a:b]):
                mine = np.array([y == lang for y in x["lang"][a:b]])
                sums[lang] = sums.get(lang, 0) + np.rint(vectors[mine].sum(0, dtype="f8")).astype("i8")
        yield {"lang": list(sums), "v": [v.tolist() for v in sums.values()]}

    parts = mapped(docs.select("lang", "text"), summed, "lang string, v array<bigint>", 1 << 20)
    rows = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    if (n := rows.select("lang").distinct().count()) > MAX_LANGUAGES:
        raise ValueError(f"{n} languages; at most {MAX_LANGUAGES}")
    langs: dict[str, np.ndarray] = {}
    for r in rows.collect():
        langs.setdefault(r["lang"], np.zeros(dim))[r["k"]] = r["x"]
    names = sorted(langs)
    return names, np.array([langs[k] for k in names]).reshape(len(names), dim)


def predict(docs: DataFrame, names: list[str], vectors: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine with the best prototype, negative ones as 0)."""
    dim = vectors.shape[1] if names else DIM
    unit = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype("f4") if names else np.zeros((0, dim), "f4")

    def predicted(batch: pa.RecordBatch):
        x = batch.to_pydict()
        for a, b in slices(x["text"]):
            v, letters = _bundles(x["text"][a:b], dim)
            known = letters & bool(names)
            cos = v @ unit.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9) if names else np.zeros((b - a, 1))
            best = cos.argmax(1)
            yield {"doc_id": x["doc_id"][a:b], "held_out": x["held_out"][a:b], "lang_pred": [names[k] if ok else "und" for k, ok in zip(best, known, strict=True)], "score": np.where(known, np.clip(cos.max(1), 0, 1), 0).astype("f8")}

    source = docs.select("doc_id", held_out().alias("held_out"), "text")
    return mapped(source, predicted, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Prototypes come from all documents that aren't held out and have a language; the language of a text is that
    of the nearest prototype, the first by name on ties. Null texts and texts without letters are `und` with
    score 0, and so is everything if nothing could be learned. Repeated rows are treated alike; a null doc_id is
    not held out.
    """
    return predict(docs, *prototypes(docs.where("lang is not null").where(~held_out()), dim))
