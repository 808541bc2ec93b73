"""Periodic runs in texts: stretches of words that repeat with a fixed period.

For each text the matches at every lag (word i equals word i + lag) are counted exactly: words that occur often by one
Fourier transform each, whose power spectra are summed and put back as one autocorrelation; rare ones by the differences
of their places. A run of period q has at least max(LEAST - q, q) matches at lag q, so only lags with that many are
scanned for islands of matches; matches of runs that were found at a divisor of the lag don't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import mapped, slices

#: Words of the shortest run; a run also has two periods at least.
LEAST = 12
#: From this lag on islands are looked for on a grid first, of so many points in the shortest island.
GRID_FROM, GRID = 48, 16
#: Differences that are counted at a time.
BLOCK = 1 << 21
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _needed(lag: np.ndarray, least: int) -> np.ndarray:
    return np.maximum(least - lag, lag)


def _heavy(count: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a transform of the text is cheaper than all differences of a word's places."""
    return count.astype("f8") ** 2 > 32 + n * np.log2(2.0 * np.maximum(n, 1)) / 2


def match_counts(keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, base): counts[base[d] + q] places of text d match at lag q, up to half its words; exact.

    keys has the words of all texts, one after another from starts; keys of different texts differ.
    """
    n = np.diff(starts)
    half = n // 2
    base = np.concatenate([[0], np.cumsum(half + 1)])
    counts = np.zeros(base[-1], "i8")
    if not len(keys):
        return counts, base
    text = np.repeat(np.arange(len(n)), n)
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    edges = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    sizes = np.diff(np.append(edges, len(keys)))
    owner = text[order[edges]]
    heavy = _heavy(sizes, n[owner])

    alive, step, held, n_held = np.flatnonzero(~np.repeat(heavy, sizes)), 0, [], 0
    while len(alive):
        step += 1
        alive = alive[: np.searchsorted(alive, len(keys) - step)]
        alive = alive[sorted_[alive + step] == sorted_[alive]]
        lag, of = order[alive + step] - order[alive], text[order[alive]]
        near = lag <= half[of]  # places of a word ascend, so what is too far now stays so
        alive = alive[near]
        held.append(base[of[near]] + lag[near])
        n_held += len(alive)
        if n_held > BLOCK or not len(alive):
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, n_held = [], 0

    for d in np.unique(owner[heavy]):
        size = 1 << int(n[d] + half[d]).bit_length()
        power = np.zeros(size // 2 + 1)
        for g in np.flatnonzero(heavy & (owner == d)):
            x = np.zeros(n[d])
            x[order[edges[g] : edges[g] + sizes[g]] - starts[d]] = 1
            f = np.fft.rfft(x, size)
            power += f.real**2 + f.imag**2
        counts[base[d] : base[d + 1]] += np.rint(np.fft.irfft(power, size)[: half[d] + 1]).astype("i8")
    return counts, base


def _islands(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the stretches of at least `least` true values."""
    at = np.flatnonzero(same)
    if len(at) < least:
        return at[:0], at[:0]
    cut = np.flatnonzero(np.diff(at) != 1)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    ok = last - first + 1 >= least
    return first[ok], (last - first + 1)[ok]


def _scan(keys: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Islands of at least `least` matches at a lag. A long one has GRID points or more of a grid, which are tried first."""
    if lag < GRID_FROM:
        return _islands(keys[:-lag] == keys[lag:], least)
    step = least // GRID
    grid = np.arange(0, len(keys) - lag, step)
    first, length = _islands(keys[grid] == keys[grid + lag], GRID)
    found = [(np.zeros(0, "i8"), np.zeros(0, "i8"))]
    for a, b in zip((first * step).tolist(), ((first + length - 1) * step).tolist(), strict=True):
        lo, hi = max(0, a - step + 1), min(len(keys) - lag, b + step)
        f, m = _islands(keys[lo:hi] == keys[lo + lag : hi + lag], least)
        found.append((f + lo, m))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs_of(keys: np.ndarray, starts: np.ndarray, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Per text its runs (start, length, period), by start and period.

    Lags are taken from the smallest up. Once a run of period p is found, its matches at a multiple q of p are taken off
    that lag's count: no new run has any of them, as it would share q words or more with the run of period p.
    """
    counts, base = match_counts(keys, starts)
    n = np.diff(starts)
    lags = np.arange(len(counts)) - np.repeat(base[:-1], np.diff(base))
    hopeful = np.flatnonzero((lags > 0) & (counts >= _needed(lags, least)))
    hopeful = hopeful[np.argsort(lags[hopeful], kind="stable")]
    of = np.searchsorted(base, hopeful, "right") - 1
    out: list[dict[tuple[int, int], int]] = [{} for _ in n]

    def note(d: int, start: int, matches: int, lag: int) -> None:
        length = matches + lag
        if (start, length) not in out[d]:
            out[d][start, length] = lag
            many = np.arange(2 * lag, min(n[d] // 2 + 1, length), lag)
            counts[base[d] + many] -= length - many

    for lo, hi in _stretches(lags[hopeful]):
        lag = int(lags[hopeful[lo]])
        need = int(_needed(np.array(lag), least))
        ready = of[lo:hi][counts[hopeful[lo:hi]] >= need]
        if not len(ready):
            continue
        if lag < GRID_FROM:  # short lags: all texts in one pass
            offsets = np.concatenate([[0], np.cumsum(n[ready])])
            first, length = _scan(np.concatenate([keys[starts[d] : starts[d + 1]] for d in ready]), lag, need)
            where = np.searchsorted(offsets, first, "right") - 1
            for d, s, m in zip(ready[where].tolist(), (first - offsets[where]).tolist(), length.tolist(), strict=True):
                note(d, s, m, lag)
        else:
            for d in ready.tolist():
                for s, m in zip(*(x.tolist() for x in _scan(keys[starts[d] : starts[d + 1]], lag, need)), strict=True):
                    note(d, s, m, lag)
    return [sorted(((s, length, p) for (s, length), p in x.items()), key=lambda r: (r[0], r[2])) for x in out]


def _stretches(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of equal values of an ordered array."""
    if len(x):
        cuts = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)]
        yield from zip(cuts[:-1], cuts[1:], strict=True)


def _worked(texts: list[bytes | None], least: int) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
    """Per text: number of words, runs, the words that are kept."""
    words = [(t or b"").split() for t in texts]  # by ASCII white space
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype("i8")
    flat = [x for w in words for x in w]
    number = {x: i for i, x in enumerate(dict.fromkeys(flat))}
    keys = np.fromiter(map(number.__getitem__, flat), "i8", len(flat)) + np.repeat(np.arange(len(words)), np.diff(starts)) * len(number)
    runs, kept = runs_of(keys, starts, least), []
    for w, found in zip(words, runs, strict=True):
        if found:
            change = np.zeros(len(w) + 1, "i8")
            for s, length, p in found:
                change[s + p] += 1
                change[s + length] -= 1
            w = list(compress(w, (np.cumsum(change[:-1]) == 0).tolist()))
        kept.append(b" ".join(w))
    return np.diff(starts).tolist(), runs, kept


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs, collapsed.

    Words are what stands between ASCII white space, numbered from 0. A run is a stretch of words of smallest period q,
    at least `least` words and two periods long, that no word beside it continues; runs may overlap and share a start.
    runs (start, length, period) are by start and period. collapsed is the text without what runs repeat: of each run the
    first period stays, unless another run drops it; words are joined by one blank.

    Null text has no words, as the empty one: no runs, collapsed is empty. Each row is worked on for itself, so repeated
    rows, null ids and further columns of docs need no care. An empty table gives an empty result. Texts of a slice share
    their passes; a very long text is a slice of its own, and its memory grows with its words.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for a, b in slices(texts):
            n, runs, kept = _worked(texts[a:b], least)
            flat = np.array([r for x in runs for r in x], "i8").reshape(-1, 3)
            ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            yield {"doc_id": batch.column("doc_id").slice(a, b - a), "n_words": n, "runs": pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])), "collapsed": pa.array(kept, pa.binary()).cast(pa.string())}

    return mapped(slim, run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed string")
