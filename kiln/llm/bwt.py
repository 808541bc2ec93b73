"""Burrows-Wheeler transform and common prefixes of a collection of strings, built column by column.

In each round every string gives one symbol more, from its end on: its suffix grows by that symbol and is inserted
where it belongs among all suffixes so far. Where that is follows from the transform itself: the new suffix c + s
comes after as many suffixes that begin with c as there are symbols c before the row of s. Transform, common prefixes
and what each row stands for are files which each round reads once from front to back, and writes anew, block by
block; what is held in memory is one block, and one entry for each string.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

#: Rows of a block.
BLOCK = 1 << 17
#: Fields of a row: preceding symbol (0: none, byte + 1), common prefix with the row before (at most LONGEST), string and suffix length.
FIELDS = {"symbol": "<u2", "common": "<u2", "place": "<u8"}
#: Common prefixes are held up to this length; searches for longer ones are refused.
LONGEST = (1 << 16) - 1


class _Rows:
    """The fields of all rows, in a file each: written from the front, then read from the front."""

    def __init__(self, folder: str, name: str):
        self.files = {k: open(os.path.join(folder, f"{name}-{k}"), "w+b") for k in FIELDS}  # noqa: SIM115
        self.n = 0

    def begin(self) -> None:
        self.n = 0
        for f in self.files.values():
            f.seek(0)

    def put(self, rows: dict[str, np.ndarray]) -> None:
        for k, a in rows.items():
            self.files[k].write(np.ascontiguousarray(a, FIELDS[k]).data)
        self.n += len(rows["symbol"])

    def blocks(self, *fields: str) -> Iterator[list[np.ndarray]]:
        for k in fields:
            self.files[k].flush()
            self.files[k].seek(0)
        for at in range(0, self.n, BLOCK):
            m = min(BLOCK, self.n - at)
            yield [np.frombuffer(self.files[k].read(m * np.dtype(FIELDS[k]).itemsize), FIELDS[k]) for k in fields]

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def _sparse(x: np.ndarray, longest: int) -> list[np.ndarray]:
    table = [x]
    k = 1
    while 2 * k <= longest:
        t = table[-1]
        table.append(np.minimum(t[:-k], t[k:]))
        k *= 2
    return table


def _range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of x over each [a, b), a < b, by a sparse table."""
    if not len(a):
        return np.zeros(0, np.int64)
    size = b - a
    table = _sparse(x, int(size.max()))
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(a), np.int64)
    for k, t in enumerate(table):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(t[a[at]], t[b[at] - (1 << k)])
    return out


def _ranks(rows: _Rows, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass over transform and common prefixes. For rows (ascending places): how many rows before have the same
    symbol; common prefixes of the grown suffix with the one before and after it (0 where they begin otherwise)."""
    n = len(places)
    rank, before, after = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    seen = np.zeros(257, np.int64)
    since = np.full(257, LONGEST, np.int64)  # least common prefix since the last row with the symbol
    waiting = np.full(257, -1, np.int64)  # the wanted row, if the last row with the symbol is one
    at = 0
    for symbol, common in rows.blocks("symbol", "common"):
        m = len(symbol)
        lo, hi = np.searchsorted(places, (at, at + m))
        order = np.argsort(symbol, kind="stable")
        counts = np.bincount(symbol, minlength=257)
        end = np.cumsum(counts)
        begin = end - counts
        syms = np.flatnonzero(counts)
        heads, last = order[begin[syms]], order[end[syms] - 1]
        # up to the first row of each symbol in the block, from the last one before the block
        entry = np.minimum(np.minimum.accumulate(common)[heads].astype(np.int64), since[syms])
        w = waiting[syms]
        after[w[w >= 0]] = entry[w >= 0] + 1
        if hi > lo:
            where = places[lo:hi] - at
            s = symbol[where].astype(np.int64)
            # place of each wanted row in the order by symbol
            k = np.empty(hi - lo, np.int64)
            for x in np.unique(s).tolist():
                mine = s == x
                k[mine] = begin[x] + np.searchsorted(order[begin[x] : end[x]], where[mine])
            rank[lo:hi] = seen[s] + k - begin[s]
            first, final = k == begin[s], k == end[s] - 1
            inner, more = np.flatnonzero(~first), np.flatnonzero(~final)
            a = np.concatenate([order[k[inner] - 1] + 1, where[more] + 1])
            b = np.concatenate([where[inner] + 1, order[k[more] + 1] + 1])
            least = _range_min(common, a, b)
            before[lo + inner] = least[: len(inner)] + 1
            after[lo + more] = least[len(inner) :] + 1
            known = np.flatnonzero(first & (seen[s] > 0))
            of = np.zeros(257, np.int64)
            of[syms] = entry
            before[lo + known] = of[s[known]] + 1
        # carried on: per symbol the least common prefix after its last row
        tail = np.minimum.accumulate(common[::-1])  # from the end
        since = np.minimum(since, int(tail[-1]))
        since[syms] = np.where(last + 1 < m, tail[np.maximum(m - 2 - last, 0)], LONGEST)
        waiting[syms] = -1
        if hi > lo:
            waiting[s[final]] = np.arange(lo, hi)[final]
        seen += counts
        at += m
    return rank, before, after


def build(strings: list[bytes], folder: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (string, suffix length, common prefix with the row before), in the order of all suffixes.

    Ends of strings sort before all symbols and never match. Files are in a new temporary folder of this task, which
    is removed at the end; a task that runs again begins anew.
    """
    if not strings:
        return
    work = tempfile.mkdtemp(dir=folder)
    old, new = _Rows(work, "0"), _Rows(work, "1")
    try:
        n = len(strings)
        sizes = np.array([len(s) for s in strings])
        text = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
        ends = np.cumsum(sizes)
        symbol = np.zeros(n, np.uint16)
        symbol[sizes > 0] = text[ends[sizes > 0] - 1]
        old.put({"symbol": symbol, "common": np.zeros(n, np.uint16), "place": np.arange(n, dtype=np.uint64) << np.uint64(32)})
        totals = np.bincount(symbol, minlength=257)
        active = np.flatnonzero(sizes > 0)
        places = active.copy()  # row of each active string's longest suffix so far, ascending
        for r in range(1, int(sizes.max()) + 1):
            rank, before, after = _ranks(old, places)
            c = text[ends[active] - r].astype(np.int64)
            base = n + np.cumsum(np.append(0, totals[1:]))  # rows that begin with a smaller symbol
            to = base[c - 1] + rank
            order = np.argsort(to, kind="stable")
            active, to, before, after = active[order], to[order], before[order], after[order]
            previous = np.zeros(len(active), np.uint16)
            more = sizes[active] > r
            previous[more] = text[ends[active[more]] - r - 1]
            slot = to - np.arange(len(to))  # the old row that each comes before
            alone = np.append(slot[1:] != slot[:-1], True)
            fill = {"symbol": previous, "common": np.minimum(before, LONGEST).astype(np.uint16), "place": active.astype(np.uint64) << np.uint64(32) | np.uint64(r)}
            new.begin()
            at = done = 0
            for rows in old.blocks(*FIELDS):
                m = len(rows[0])
                lo, hi = np.searchsorted(slot, (at, at + m))
                follow = np.arange(lo, hi)[alone[lo:hi] & (after[lo:hi] > 0)]
                rows[1] = rows[1].copy()
                rows[1][slot[follow] - at] = np.minimum(after[follow], LONGEST)
                into = slot[lo:hi] - at + np.arange(hi - lo)
                stay = np.ones(m + hi - lo, bool)
                stay[into] = False
                out = {}
                for k, v in zip(FIELDS, rows, strict=True):
                    out[k] = np.empty(m + hi - lo, v.dtype)
                    out[k][stay], out[k][into] = v, fill[k][lo:hi]
                new.put(out)
                at += m
                done = hi
            new.put({k: v[done:] for k, v in fill.items()})
            totals = totals + np.bincount(previous, minlength=257)
            old, new = new, old
            active, places = active[more], to[more]
        for place, common in old.blocks("place", "common"):
            yield (place >> np.uint64(32)).astype(np.int64), (place & np.uint64(0xFFFFFFFF)).astype(np.int64), common
    finally:
        old.close()
        new.close()
        shutil.rmtree(work, ignore_errors=True)
