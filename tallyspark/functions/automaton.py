"""Many words looked for at once: an Aho-Corasick automaton as arrays, run over all texts of a batch in step.

A state is what the last characters of a text have in common with some word's beginning; its number leads to the next
state by one look-up for each character, and tells the first of the words that end there. Work grows with the texts, not
with the words, and a plan holds one function whatever the number of words.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .similarity import letters

#: Cells of a transition table; words that need more make several automata. Characters of texts that are looked at in one pass.
TABLE, CELLS = 1 << 25, 1 << 22
#: Up to so many words a plain expression is as good.
PLAIN = 40


class Automaton:
    """The transitions and the first word (by its place) that ends in each state; ``len(words)`` where none does."""

    def __init__(self, words: Sequence[str]) -> None:
        self.none = len(words)
        #: places of the words that end in a state
        self.all: dict[int, list[int]] = {}
        self.known = np.array(sorted({ord(c) for w in words for c in w}), np.int64)
        place = {chr(c): i + 1 for i, c in enumerate(self.known.tolist())}
        children: list[dict[int, int]] = [{}]
        ends = [self.none]
        for i, word in enumerate(words):
            at = 0
            for c in word:
                nxt = children[at].get(place[c])
                if nxt is None:
                    nxt = len(children)
                    children[at][place[c]] = nxt
                    children.append({})
                    ends.append(self.none)
                at = nxt
            ends[at] = min(ends[at], i)
            self.all.setdefault(at, []).append(i)
        self.table = np.zeros((len(children), len(self.known) + 1), np.int32)
        self.first = np.array(ends, np.int32)
        self.fall = fall = np.zeros(len(children), np.int64)
        waiting = deque([0])
        while waiting:  # by length, so that what a state falls back to is complete
            at = waiting.popleft()
            if at:
                self.table[at] = self.table[fall[at]]
                self.first[at] = min(self.first[at], self.first[fall[at]])
            for c, nxt in children[at].items():
                fall[nxt] = self.table[at, c] if at else 0
                waiting.append(nxt)
            for c, nxt in children[at].items():
                self.table[at, c] = nxt

    def firsts(self, codes: np.ndarray) -> np.ndarray:
        """The first word in each row of code points, -1 behind a text's end."""
        found = np.full(len(codes), self.first[0], np.int32)
        state = np.zeros(len(codes), np.int32)
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1) if len(self.known) else np.zeros(codes.shape, np.int64)
        column = np.where(self.known[at] == codes, at + 1, 0) if len(self.known) else at
        for i in range(codes.shape[1]):
            state = self.table[state, column[:, i]]
            found = np.minimum(found, self.first[state])
        return found


    def words_in(self, text: str) -> set[int]:
        """The places of all words that a text contains."""
        out, state = set(), 0
        for c in [None, *text]:
            if c is not None:
                i = int(np.searchsorted(self.known, ord(c)))
                state = int(self.table[state, i + 1 if i < len(self.known) and self.known[i] == ord(c) else 0])
            at = state
            while at >= 0 and self.first[at] < self.none:
                out.update(self.all.get(at, ()))
                at = int(self.fall[at]) if at else -1
        return out


def next_word(text: str, made: list[tuple[int, Automaton]], least: int) -> int | None:
    """The place of the first word from ``least`` on that a text contains."""
    return min((start + i for start, one in made for i in one.words_in(text) if start + i >= least), default=None)


def automata(words: Sequence[str], cells: int = TABLE) -> list[tuple[int, Automaton]]:
    """(place of its first word, automaton) of runs of words whose tables have at most about ``cells`` cells."""
    out, start, states, seen = [], 0, 1, set()
    for i, word in enumerate(words):
        if i > start and (states + len(word)) * (len(seen | set(word)) + 1) > cells:
            out.append((start, Automaton(words[start:i])))
            start, states, seen = i, 1, set()
        states += len(word)
        seen |= set(word)
    return [*out, (start, Automaton(words[start:]))] if words else []


def first_words(texts: list[str], made: list[tuple[int, Automaton]], count: int) -> np.ndarray:
    """The place of the first of ``count`` words that each text contains, ``count`` where it has none."""
    out = np.full(len(texts), count, np.int64)
    order = np.argsort([len(t) for t in texts], kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * max(len(texts[order[end]]), 1) <= CELLS:
            end += 1
        some = order[at:end]
        codes, _ = letters([texts[i] for i in some])
        for start, one in made:
            hit = one.firsts(codes)
            out[some] = np.minimum(out[some], np.where(hit < one.none, hit + start, count))
        at = end
    return out


def first_word(text: Column, words: Sequence[str], names: Sequence[int] | None = None) -> Column:
    """The place, from 0, of the first of ``words`` that a text contains, or what ``names`` calls that place; null if it contains none or is null."""
    made, count = automata(list(words)), len(words)
    called = np.append(np.arange(count) if names is None else np.asarray(names), -1).astype(np.int32)

    @F.arrow_udf(IntegerType())
    def found(column: pa.Array) -> pa.Array:
        place = first_words([x or "" for x in column.to_pylist()], made, count)
        known = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool) & (place < count)
        return pa.array(called[place], pa.int32(), mask=~known)

    return found(text)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether a text contains any of the words, null for null."""
    if len(words) > PLAIN:
        return F.when(text.isNotNull(), first_word(text, words).isNotNull())
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out
