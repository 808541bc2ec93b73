"""Token counts by a compiled finite-state transducer over characters.

A word-end BPE tokenizer is made into a deterministic transducer, state by state as texts need them. A state knows
how the text so far may still go on: the pretokenizer's mode, and for each place where an unfinished vocabulary entry
could have begun, the trie node reached, the token that ends there and the tokens up to there, relative to the newest
place (the residual weights of a weighted determinisation). A transition carries the change in the number of tokens.
Texts are cut into chunks of equal length which run side by side through the transition table; each chunk's map from
entry state to (end state, count) is then composed along the text.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import held, mapped, slices

CHUNK = 192
#: Columns of the table: most frequent characters get one each as they come; all others share the last, and are stepped one by one.
SYMBOLS = 160
#: A place in the trie from which at most so many tokens go on remembers which of them can follow.
FEW = 64
#: The table is thrown away and built anew beyond so many states (at 5 bytes a cell about 130 MB), between slices.
MAX_STATES = 160_000
SLICE = 1_500_000
PAD, END, RARE = 0, 1, SYMBOLS - 1
LETTER, NUMBER, SPACE, OTHER = range(4)
#: The contractions that the pretokenizer splits off, by their first letters.
SHORT, LONG = "stmd", {"r": "e", "v": "e", "l": "l"}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabularies of byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """The merges of a word-end BPE tokenizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["model"]["merges"])}
        self.vocab = model["model"]["vocab"]
        self.suffix = model["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in model["added_tokens"]]
        self.symbols = byte_symbols()
        #: How each token is made, if merges make it: rank, left part, right part.
        self.made = {a + b: (r, a, b) for (a, b), r in reversed(self.ranks.items())}
        self.whole: dict[str, bool] = {}

    def parts(self, token: str) -> list[str]:
        """A token's base symbols; the last one takes the suffix along."""
        end = token.endswith(self.suffix) and len(token) > len(self.suffix)
        body = token[: -len(self.suffix)] if end else token
        return [*body[:-1], body[-1] + self.suffix] if end else list(body)

    def merge(self, parts: list[str]) -> list[str]:
        """The merges, applied one by one: least rank first, then leftmost."""
        ranks = self.ranks
        while len(parts) > 1:
            best, at = min(((ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def own(self, token: str) -> bool:
        """Whether the merges over a token's symbols give the token."""
        if token not in self.whole:
            self.whole[token] = self.merge(self.parts(token)) == [token]
        return self.whole[token]

    def valid(self, left: str | None, right: str) -> bool:
        """Whether right can follow left, i.e. whether the merges over both give just these two tokens.

        The merges of both are undone, latest first; a merge over the border that would have come before the one
        just undone would have been applied.
        """
        if not self.own(right):
            return False
        if left is None:
            return True
        ranks, made, limit = self.ranks, self.made, 1 << 60
        none = (-1, "", "")
        while True:
            if ranks.get((left, right), limit) < limit:
                return False
            a, b = made.get(left, none), made.get(right, none)
            if a[0] > b[0]:
                limit, left = a[0], a[2]
            elif b[0] >= 0:
                limit, right = b[0] + 1, b[1]
            else:
                return True


class Transducer:
    """Lazily determinised token counter for a tokenizer of the kind NFC, lower case, split by pattern, word-end BPE."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.bpe = Bpe(path)
        # Trie over the vocabulary: node -> {byte symbol: node}; words[node]: the token, inner or word-final, that ends there.
        self.child: list[dict[str, int]] = [{}]
        self.inner: list[str | None] = [None]
        self.final: list[str | None] = [None]
        for token in self.bpe.vocab:
            if token in self.bpe.special:
                continue
            end = token.endswith(self.bpe.suffix) and len(token) > len(self.bpe.suffix)
            node = 0
            for c in token[: -len(self.bpe.suffix)] if end else token:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.inner.append(None)
                    self.final.append(None)
                node = self.child[node][c]
            (self.final if end else self.inner)[node] = token
        self.below: list[frozenset[str] | None] = [None] * len(self.child)  # tokens that go on from a node, if few
        self._gather(0)
        self.allowed: dict[tuple[str | None, int], frozenset[str]] = {}
        self.kinds: dict[int, int] = {}
        self.symbol = np.zeros(0x110001, np.uint8)  # of each code point; 0x110000 ends a text
        self.symbol[:] = 255
        self.symbol[0x110000] = END
        self.points: list[int] = [-1, 0x110000]
        self.splitter = re.compile("|".join(map(re.escape, self.bpe.special)))
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {("S",): 0}
        self.states: list[tuple] = [("S",)]
        self.next = np.full((1024, SYMBOLS), -1, np.int32)
        self.emit = np.zeros((1024, SYMBOLS), np.int8)
        self.next[0, PAD] = 0

    # -- one state at a time

    def kind(self, cp: int) -> int:
        if cp not in self.kinds:
            c = chr(cp)
            k = unicodedata.category(c)[0]
            space = c.isspace() and not 0x1C <= cp <= 0x1F
            self.kinds[cp] = LETTER if k == "L" else NUMBER if k == "N" else SPACE if space else OTHER
        return self.kinds[cp]

    def _gather(self, node: int) -> list[str] | None:
        """Fills below; vocabulary entries are short, so the depth is small."""
        mine: list[str] | None = []
        for to in self.child[node].values():
            under = self._gather(to)
            if mine is not None:
                mine = None if under is None else mine + under + [t for t in (self.inner[to], self.final[to]) if t is not None]
                if mine is not None and len(mine) > FEW:
                    mine = None
        self.below[node] = None if mine is None else frozenset(mine)
        return mine

    def _narrowed(self, last, node: int):
        """What a place has to remember: the token before it, or, where few tokens can go on, which of them can
        follow. Different tokens that allow the same are one state then."""
        below = self.below[node]
        if below is None:
            return last
        if isinstance(last, frozenset):
            return last & below
        key = (last, node)
        got = self.allowed.get(key)
        if got is None:
            if len(self.allowed) > 500_000:
                self.allowed.clear()
            got = self.allowed[key] = frozenset(t for t in below if self.bpe.valid(last, t))
        return got

    def _follows(self, last, token: str) -> bool:
        return token in last if isinstance(last, frozenset) else self.bpe.valid(last, token)

    def _inner(self, live: tuple, c: str) -> tuple[tuple, int]:
        """The live places after one more symbol inside a word, and the change in tokens."""
        on, found = [], None
        for node, last, n in live:
            to = self.child[node].get(c)
            if to is not None:
                token = self.inner[to]
                if found is None and token is not None and self._follows(last, token):
                    found = (token, n + 1)
                if self.child[to]:
                    last = self._narrowed(last, to)
                    if last or last is None:
                        on.append((to, last, n))
        token, change = found
        return (*((node, last, n - change) for node, last, n in on), (0, token, 0)), change

    def _final(self, live: tuple, c: str) -> int:
        for node, last, n in live:
            to = self.child[node].get(c)
            if to is not None and self.final[to] is not None and self._follows(last, self.final[to]):
                return n + 1
        raise AssertionError("every byte ends a word")

    def _add(self, state: tuple, cp: int) -> tuple[tuple, int]:
        """Put a character on a word: all its bytes but the last go in at once, the last waits, as it may end the word."""
        mode, live, waits = state
        total, body = 0, [self.bpe.symbols[b] for b in chr(cp).encode("utf-8", "surrogatepass")]
        for c in ([waits] if waits else []) + body[:-1]:
            live, n = self._inner(live, c)
            total += n
        return (mode, live, body[-1]), total

    def _word(self, text: str) -> int:
        state, total = ("L", ((0, None, 0),), ""), 0
        for c in text:
            state, n = self._add(state, ord(c))
            total += n
        return total + self._final(state[1], state[2])

    def _begin(self, cp: int) -> tuple[tuple, int]:
        kind = self.kind(cp)
        if kind == SPACE:
            return ("S",), 0
        if kind == NUMBER:
            return ("S",), self._word(chr(cp))
        if cp == 0x27:
            return ("A",), 0
        return self._add(("L" if kind == LETTER else "O", ((0, None, 0),), ""), cp)

    def end(self, state: tuple) -> int:
        if state[0] in "LO":
            return self._final(state[1], state[2])
        return self._word("'") * (state[0] in "AB") + (self._word(state[1]) if state[0] == "B" else 0)

    def step(self, state: tuple, cp: int) -> tuple[tuple, int]:
        """(state, change in tokens) after one character. Modes: S between words, L letters, O others, A a first
        apostrophe, B the apostrophe and a letter that may begin a contraction of two."""
        if cp == 0x110000:
            return ("S",), self.end(state)
        mode, kind, c = state[0], self.kind(cp), chr(cp)
        if mode == "L" and kind == LETTER or mode == "O" and kind == OTHER:
            return self._add(state, cp)
        if mode == "A":
            if c in SHORT:
                return ("S",), self._word("'" + c)
            if c in LONG:
                return ("B", c), 0
            if kind == OTHER:
                state, n = self._add(("O", ((0, None, 0),), ""), 0x27)
                to, m = self._add(state, cp)
                return to, n + m
        if mode == "B":
            if LONG[state[1]] == c:
                return ("S",), self._word("'" + state[1] + c)
            to, n = self._begin(ord(state[1]))
            to, m = self.step(to, cp)
            return to, self._word("'") + n + m
        n = self.end(state)
        to, m = self._begin(cp)
        return to, n + m

    # -- tables

    def _id(self, state: tuple) -> int:
        if state not in self.ids:
            n = self.ids[state] = len(self.states)
            self.states.append(state)
            if n >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
            self.next[n, PAD] = n
        return self.ids[state]

    def _advance(self, at: np.ndarray, symbols: np.ndarray, points: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """All lanes one character on; adds to counts."""
        to = self.next[at, symbols]
        missing = np.flatnonzero(to < 0)
        if len(missing):
            rare = missing[symbols[missing] == RARE]
            for pair in np.unique(at[missing].astype(np.int64) * SYMBOLS + symbols[missing]).tolist():
                s, x = divmod(pair, SYMBOLS)
                if x != RARE:
                    state, n = self.step(self.states[s], self.points[x])
                    k = self._id(state)
                    self.next[s, x], self.emit[s, x] = k, n
            to = self.next[at, symbols]
            for i in rare.tolist():
                state, n = self.step(self.states[at[i]], int(points[i]))
                to[i] = self._id(state)
                counts[i] += n
        counts += self.emit[at, symbols]
        return to

    def _run(self, symbols: np.ndarray, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(symbols.shape[1], np.int64)
        for s, p in zip(symbols, points, strict=True):
            at = self._advance(at, s, p, counts)
        return at, counts

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; strings of special tokens count as one each, as the library takes them."""
        if len(self.states) > MAX_STATES:
            self.clear()
        out = np.zeros(len(texts), np.int64)
        parts, of = [], []
        for i, t in enumerate(texts):
            pieces = self.splitter.split(t) if t else []
            out[i] = max(0, len(pieces) - 1)
            for p in pieces:
                if p:
                    parts.append(self.normal(p))
                    of.append(i)
        if not parts:
            return out
        sizes = np.array([len(p) + 1 for p in parts])
        lanes = -(-sizes // CHUNK)
        first = np.cumsum(lanes) - lanes
        cps = np.full(int(lanes.sum()) * CHUNK, -1, np.int32)
        for p, lane in zip(parts, first.tolist(), strict=True):
            cps[lane * CHUNK : lane * CHUNK + len(p)] = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), "<u4")
            cps[lane * CHUNK + len(p)] = 0x110000
        symbols = np.where(cps >= 0, self.symbol[cps], PAD).astype(np.uint8)
        if (new := symbols == 255).any():
            seen, n = np.unique(cps[new], return_counts=True)
            for cp in seen[np.argsort(-n, kind="stable")].tolist():
                if len(self.points) < RARE:
                    self.symbol[cp] = len(self.points)
                    self.points.append(cp)
                else:
                    self.symbol[cp] = RARE
            symbols[new] = self.symbol[cps[new]]
        counts = self._scan(symbols.reshape(-1, CHUNK), cps.reshape(-1, CHUNK), first)
        np.add.at(out, np.repeat(of, lanes), counts)
        return out

    def _scan(self, symbols: np.ndarray, cps: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tokens of each run of chunks (rows), put on the run's first chunk.

        After white space the state is S whatever it was before, so what comes after the first white space of a chunk (its
        tail) is a constant map; the tails of all chunks run side by side. What comes before it (its head) needs the entry
        state, and so does a chunk without white space (whole), which passes its end state on.

        The map of a head or a whole chunk is made for the states that can enter: at first the one in which the chunk
        before ends, for a whole one as if it had begun in S, then what its map has for its own entries. States forget
        what is far behind, so this soon gives no new pairs; each round runs its pairs side by side. The maps are then
        composed along each run of whole chunks by prefix doubling.
        """
        n = len(symbols)
        at = np.arange(CHUNK)
        white = np.array([cp >= 0 and cp < 0x110000 and self.kind(cp) == SPACE for cp in self.points] + [False] * (SYMBOLS - len(self.points)))
        reset = white[symbols]
        begins = np.zeros(n, bool)
        begins[first] = True
        whole = ~begins & ~reset.any(1)
        head = np.where(begins, 0, np.where(whole, CHUNK, reset.argmax(1) + 1))
        body = np.where((at < head[:, None]) & ~whole[:, None], PAD, symbols)
        ends, counts = self._run(np.ascontiguousarray(body.T), cps.T, np.zeros(n, np.int64))
        goes = whole & ~np.append(begins[1:], True)
        key = lambda c, e: c.astype(np.int64) << 32 | e
        keys, exits, sums = [key(np.flatnonzero(whole), 0)], [ends[whole]], [counts[whole]]
        counts[whole] = 0
        inner = np.flatnonzero(head > 0)
        new = key(inner, ends[inner - 1])
        while len(new := np.setdiff1d(new, np.concatenate(keys))):
            chunk = new >> 32
            width = int(head[chunk].max())
            part = np.where(at[:width] < head[chunk, None], symbols[chunk, :width], PAD)
            to, more = self._run(np.ascontiguousarray(part.T), cps[chunk, :width].T, new & 0xFFFFFFFF)
            keys.append(new)
            exits.append(to)
            sums.append(more)
            new = key(chunk[goes[chunk]] + 1, to[goes[chunk]])
        if not len(inner):
            return counts
        keys, exits, sums = np.concatenate(keys), np.concatenate(exits), np.concatenate(sums)
        order = np.argsort(keys)
        chunk = keys >> 32
        then = np.append(np.where(goes[chunk], order[np.minimum(np.searchsorted(keys, key(chunk + 1, exits), sorter=order), len(keys) - 1)], len(keys)), len(keys))
        sums = np.append(sums, 0)
        while (then < len(keys)).any():
            sums, then = sums + sums[then], then[then]
        start = inner[~whole[inner - 1]]  # heads and whole chunks of which the entry state is known
        counts[start] += sums[order[np.searchsorted(keys, key(start, ends[start - 1]), sorter=order)]]
        return counts

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case character by character (so that a last sigma is like any other)."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


def transducer(path: str) -> Transducer:
    return held(("count", path), lambda: Transducer(path))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens).

    tokenizer: path of the vocabulary file, the same on all machines. Null text counts as empty, with 0 bytes and
    tokens. Very long texts are many chunks and need no more memory than their characters. Each row is counted alone,
    so repeated rows and null ids need no care.
    """

    def counted(batch: pa.RecordBatch):
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        machine = transducer(tokenizer)
        for a, b in slices(texts, SLICE, 20_000):
            n = machine.count(texts[a:b])
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts[a:b]]
            yield {"doc_id": keys[a:b], "n_bytes": size, "n_tokens": n, "over_limit": n > limit}

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(source, counted, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
