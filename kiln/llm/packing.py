"""Packing documents into token sequences: every document goes to the tier of the smallest window that holds it, each tier
is packed by best fit into windows of its own size, gaps of long windows are filled from shorter tiers."""

from __future__ import annotations

import bisect
import functools
import os
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import held, slices, small_batches, tidy

SEQUENCE = 2048
END_ID = 1
#: Tokens that are packed together; a task holds the ids of one such block.
BLOCK_TOKENS = 1_500_000
#: The smallest window that documents are packed into; longer ones double it up to a sequence.
SHORTEST = 256
#: Sequences of a step group.
STEP = 16
SLICE = 400_000
SLOTS_BITS = 20
#: White space as Unicode has it (Python's isspace() also takes the four separators 0x1C-0x1F).
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LETTER, NUMBER, SPACE, OTHER = range(4)
_GOLD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93


@functools.cache
def char_classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        k = unicodedata.category(chr(cp))[0]
        if k == "L":
            kinds[cp] = LETTER
        elif k == "N":
            kinds[cp] = NUMBER
    kinds[list(WHITE)] = SPACE
    return kinds


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for x in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def piece_starts(cps: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the pieces of the byte-level pattern begin: contractions, ' ?letters', ' ?numbers', ' ?others', white space.

    cps: code points of texts one after the other; text_starts: where each (none empty) begins.
    """
    n = len(cps)
    kind = char_classes()[cps]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    space = kind == SPACE
    before = np.empty(n, np.uint8)
    before[0], before[1:] = OTHER, kind[:-1]
    next_solid = np.zeros(n, bool)  # a character that isn't white space follows in the same text
    next_solid[:-1] = ~space[1:] & ~first[1:n]
    start = np.where(space, (before != SPACE) | next_solid, kind != before)
    blank_before = np.zeros(n, bool)
    blank_before[1:] = cps[:-1] == 0x20
    start = np.where(~space & (before == SPACE), ~blank_before, start) | first[:n]
    # 's 't 'm 'd and 're 've 'll where a piece begins with the apostrophe
    for a in np.flatnonzero((cps == 0x27) & start):
        if a + 1 < n and not first[a + 1]:
            c = chr(cps[a + 1])
            k = 2 if c in "stmd" else 3 if a + 2 < n and not first[a + 2] and c + chr(cps[a + 2]) in ("re", "ve", "ll") else 0
            if k:
                start[a + 1 : a + k] = False
                if a + k < n:
                    start[a + k] = True
    return start


class PieceCoder:
    """Token ids of many texts at once, as the library gives them.

    Pieces are found with array operations, looked up in a hash table of known pieces by a 64-bit hash, and compared
    character by character; only pieces not seen before go through the library. Texts with the string of a special
    token, which the library treats apart, are left to it as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << SLOTS_BITS, np.uint64)
        self.entry = np.full(1 << SLOTS_BITS, -1, np.int32)
        self.n, self.chars, self.ids = 0, np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32)
        self.char_at, self.id_at = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = (h * np.uint64(_GOLD)) >> np.uint64(64 - SLOTS_BITS)
        at = at.astype(np.int64)
        out = self.entry[at].copy()
        left = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << SLOTS_BITS) - 1)
            out[left] = self.entry[at[left]]
            left = left[(out[left] >= 0) & (self.keys[at[left]] != h[left])]
        return out

    def _grown(self, a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids = [e.ids for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]
        c, i = int(self.char_at[self.n]), int(self.id_at[self.n])
        self.chars = self._grown(self.chars, c + sum(map(len, pieces)))
        self.ids = self._grown(self.ids, i + sum(map(len, ids)))
        self.char_at, self.id_at = self._grown(self.char_at, self.n + len(pieces) + 1), self._grown(self.id_at, self.n + len(pieces) + 1)
        self.chars[c : c + sum(map(len, pieces))] = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4")
        self.ids[i : i + sum(map(len, ids))] = np.fromiter((x for y in ids for x in y), np.uint32)
        new = slice(self.n + 1, self.n + len(pieces) + 1)
        self.char_at[new] = c + np.cumsum([len(p) for p in pieces])
        self.id_at[new] = i + np.cumsum([len(y) for y in ids])
        mask = (1 << SLOTS_BITS) - 1
        for h, at in zip(hashes, ((hashes * np.uint64(_GOLD)) >> np.uint64(64 - SLOTS_BITS)).astype(np.int64).tolist(), strict=True):
            while self.entry[at] >= 0:
                at = (at + 1) & mask
            self.keys[at], self.entry[at] = h, self.n
            self.n += 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        odd = {i: self.tok.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if any(s in t for s in self.special)}
        pieces: list[tuple[int, str]] = []
        for i, t in enumerate(texts):
            if i not in odd and t:
                pieces += ((i, x) for x in cut(t))
        counts, out = np.zeros(len(texts), np.int64), []
        made: dict[int, list[np.ndarray]] = {}
        for a, b in slices([x for _, x in pieces], SLICE, 100_000):
            ids, n = self._run([x for _, x in pieces[a:b]])
            ends = np.cumsum(n)
            for (i, _), e, k in zip(pieces[a:b], ends.tolist(), n.tolist(), strict=True):
                made.setdefault(i, []).append(ids[e - k : e])
        for i in range(len(texts)):
            mine = made.get(i, []) if i not in odd else [np.array(odd[i], np.uint32)]
            counts[i] = sum(map(len, mine))
            out += mine
        return np.concatenate(out) if out else np.zeros(0, np.uint32), counts

    def _run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.n > (1 << SLOTS_BITS) // 2:
            self.clear()
        joined = "".join(texts)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(t) for t in texts])
        text_starts = np.cumsum(sizes) - sizes
        s = np.flatnonzero(piece_starts(cps, text_starts))
        e = np.append(s[1:], len(cps))
        p, q = _powers(1 << max(19, len(cps).bit_length()))
        run = np.zeros(len(cps) + 1, np.uint64)
        np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * np.uint64(_GOLD) * p[: len(cps)], out=run[1:])
        h = (run[e] - run[s]) * q[s]
        del run
        known = self._find(h)
        for _ in range(2):
            new = np.flatnonzero(known < 0)
            if not len(new):
                break
            u, at = np.unique(h[new], return_index=True)
            self._learn(u, [joined[s[k] : e[k]] for k in new[at]])
            known[new] = self._find(h[new])
        size = e - s
        same = self.char_at[known + 1] - self.char_at[known] == size
        local = np.arange(len(cps)) - np.repeat(s, size)
        where = np.minimum(np.repeat(self.char_at[known], size) + local, len(self.chars) - 1)
        differs = self.chars[where] != cps
        if not same.all() or differs.any():  # equal hashes of unlike pieces: left to the library
            ids = [self.tok.encode(t, add_special_tokens=False).ids for t in texts]
            return np.array([x for y in ids for x in y], np.uint32), np.array([len(y) for y in ids])
        k = self.id_at[known + 1] - self.id_at[known]
        total = np.cumsum(k)
        ids = self.ids[np.repeat(self.id_at[known] - (total - k), k) + np.arange(int(total[-1]))]
        upto = np.append(0, total)
        of = np.searchsorted(s, np.append(text_starts, len(cps)))
        return ids, np.diff(upto[of])


def cut(text: str, limit: int = SLICE) -> Iterator[str]:
    """Parts of a very long text; cuts only before a single blank between other characters, where a piece begins anyway."""
    start = 0
    while len(text) - start > limit:
        at = text.rfind(" ", start + 1, start + limit)
        while at > start and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.rfind(" ", start + 1, at)
        if at <= start:
            at = text.find(" ", start + limit)
            while 0 <= at < len(text) - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
                at = text.find(" ", at + 1)
            if not 0 <= at < len(text) - 1:
                break
        yield text[start:at]
        start = at
    yield text[start:]


def tier_sizes(size: int = SEQUENCE, shortest: int = SHORTEST) -> list[int]:
    """Window sizes, the longest first: halves of size down to the shortest."""
    return [size >> k for k in range(size.bit_length()) if size >> k >= min(shortest, size)]


def pack_block(lengths: list[int], size: int = SEQUENCE, shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length); lengths are those of the documents.

    Documents longer than size give whole windows first. Every document, or what is left of it, is routed to the tier of
    the smallest window that holds it, and each tier is packed into windows of its own size, the longest tier first: its
    longest piece opens a window, and into the gap goes the longest piece that fits, of this tier or a shorter one, again
    and again. Where none fits, the shortest piece is cut to fill it, and its rest is routed anew. So all windows are full.
    What does not make up a window of its tier at the end (less than one) is dealt into sequences whose lengths are powers
    of two, which need no padding either.
    """
    sizes = tier_sizes(size, shortest)
    pools: list[list[tuple[int, int, int]]] = [[] for _ in sizes]  # by tier: length, document, start; sorted
    out: list[list[tuple[int, int, int]]] = []

    def tier_of(n: int) -> int:
        return min((size // n).bit_length(), len(sizes)) - 1 if n < size else 0

    for d, n in enumerate(lengths):
        for at in range(0, n - size + 1, size):
            out.append([(d, at, size)])
        if n % size:
            pools[tier_of(n % size)].append((n % size, d, n - n % size))
    for pool in pools:
        pool.sort()
    left = sum(n for pool in pools for n, _, _ in pool)

    def fitting(gap: int) -> tuple[int, int, int] | None:
        for pool in pools[tier_of(gap) :]:
            i = bisect.bisect_right(pool, (gap, len(lengths), 0))
            if i:
                return pool.pop(i - 1)
        return None

    for k, tier in enumerate(sizes):
        while pools[k] and left >= tier:
            n, d, at = pools[k].pop()
            window, gap = [(d, at, n)], tier - n
            while gap:
                if (piece := fitting(gap)) is not None:
                    n, d, at = piece
                    window.append((d, at, n))
                    gap -= n
                else:
                    n, d, at = next(pool for pool in reversed(pools) if pool).pop(0)
                    window.append((d, at, gap))
                    bisect.insort(pools[tier_of(n - gap)], (n - gap, d, at + gap))
                    gap = 0
            out.append(window)
            left -= tier
    rest = [(d, at, n) for pool in pools for n, d, at in reversed(pool)]
    tier = size
    while rest:
        while tier > left:
            tier //= 2
        window, room = [], tier
        while room:
            d, at, n = rest.pop(0)
            take = min(n, room)
            window.append((d, at, take))
            room -= take
            if n > take:
                rest.insert(0, (d, at + take, n - take))
        left -= tier
        out.append(window)
    return out


def step_groups(sequences: list[list[tuple[int, int, int]]], step: int = STEP) -> list[int]:
    """A group for each sequence, over all tiers, so that groups have alike sums of squared piece lengths (the cost of
    attention) and alike shares of the tiers."""
    groups = max(1, -(-len(sequences) // step))
    order = sorted(range(len(sequences)), key=lambda i: (-sum(n * n for _, _, n in sequences[i]), i))
    out = [0] * len(sequences)
    for k, i in enumerate(order):
        r, c = divmod(k, groups)
        out[i] = c if r % 2 == 0 else groups - 1 - c
    return out


def coder(path: str) -> PieceCoder:
    return held(("pack", path), lambda: PieceCoder(path))


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    tokenizer: path of the vocabulary file, the same on all machines. Each document is its ids and end_id, so null and
    empty texts are one token. Each task packs blocks of its own documents, so nothing is shuffled and no key can be
    hot; sequence ids hold the partition, and come out the same when a task runs again. tier: the padded length,
    size or a power of two below; windows of a
    tier are full, so nothing is padded. step_group: groups of sequences of a block of like cost. with_ids adds the ids.
    Rows that repeat and null ids are packed like any others.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long" + ", ids binary" * with_ids
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, base = coder(tokenizer), TaskContext.get().partitionId() << 36
        names, ids, held, made, steps = [], [], 0, 0, 0
        end = np.array([end_id], "<u4")

        def flush() -> pa.RecordBatch:
            nonlocal made, steps
            sequences = pack_block([len(x) for x in ids], size)
            groups = step_groups(sequences)
            cols: dict[str, list] = {f.name: [] for f in arrow}
            for k, pieces in enumerate(sequences):
                at, total = 0, sum(n for _, _, n in pieces)
                for d, start, n in pieces:
                    body = ids[d][start : start + n].astype("<u4").tobytes()
                    row = (names[d], start, n, zlib.crc32(body), len(ids[d]), base + made + k, at, total if total & (total - 1) == 0 else size, base + steps + groups[k], body)
                    for c, v in zip(cols.values(), row, strict=False):
                        c.append(v)
                    at += n
            made, steps = made + len(sequences), steps + max(groups, default=-1) + 1
            names.clear()
            ids.clear()
            return pa.RecordBatch.from_pydict(cols, schema=arrow)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE, 20_000):
                flat, n = code.encode([t or "" for t in texts[a:b]])
                ends = np.cumsum(n)
                for key, e, k in zip(keys[a:b], ends.tolist(), n.tolist(), strict=True):
                    names.append(key)
                    ids.append(np.concatenate([flat[e - k : e], end]))
                    held += k + 1
                if held >= block_tokens:
                    yield flush()
                    held = 0
        if names:
            yield flush()

    return small_batches(docs.select(F.col(id_col), F.col(text_col).cast("string"))).mapInArrow(tidy(run), schema)
