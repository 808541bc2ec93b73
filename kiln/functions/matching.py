"""Many strings looked for at once: an Aho-Corasick automaton over the text as it is, and what its matches cover."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lowered(text: str) -> str:
    """In lower case, character by character, so that places stay; a character whose lower case is longer stays, too."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x.lower()) != 1 else x.lower() for x in text)


class Words:
    """An automaton of some words; empty ones are left out."""

    def __init__(self, words: Iterable[str], any_case: bool = False):
        self.any_case = any_case
        self.automaton = ahocorasick.Automaton()
        for w in words:
            if w:
                self.automaton.add_word(lowered(w) if any_case else w, len(w))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of each word's occurrences from left to right, those of one word not overlapping, by their ends."""
        if self.empty:
            return
        text = lowered(text) if self.any_case else text
        done: dict[str, int] = {}
        for last, n in self.automaton.iter(text):
            start = last + 1 - n
            word = text[start : last + 1]
            if done.get(word, 0) <= start:
                done[word] = last + 1
                yield start, last + 1

    def covered(self, text: str) -> list[tuple[int, int]]:
        """What the matches cover, overlapping and touching ones put together."""
        out: list[tuple[int, int]] = []
        for start, end in sorted(self.matches(text)):
            if out and start <= out[-1][1]:
                out[-1] = out[-1][0], max(end, out[-1][1])
            else:
                out.append((start, end))
        return out

    def marked(self, text: str, before: str, after: str) -> str:
        out, at = [], 0
        for start, end in self.covered(text):
            out += [text[at:start], before, text[start:end], after]
            at = end
        return "".join([*out, text[at:]])


def marked(text: Column, words: list[str], before: str, after: str) -> Column:
    """text with before and after around everything that some word covers, in any case; null stays null."""
    held: list[Words] = []

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Words(words, any_case=True))
        return texts.map(lambda t: held[0].marked(t, before, after), na_action="ignore")

    return run(text)
