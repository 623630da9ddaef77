"""String similarity: levenshtein is built in; the Jaro-Winkler form used here isn't, so that part is an Arrow function that works on all pairs of a batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import trim

#: Pairs and characters of a pair that are compared at once.
PAIRS, CELLS = 4096, 1 << 22


def jaro_winkler_pair(a: str, b: str) -> float:
    """Jaro over a window of max // 2 - 1, half transpositions kept, and a prefix bonus at any score; two empty strings are alike."""
    return float(jaro_winkler_pairs([a], [b])[0])


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, a text in each row, -1 behind its end; lengths)."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), max(int(size.max(initial=0)), 1)), -1, np.int32)
    inside = np.arange(out.shape[1]) < size[:, None]
    out[inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return out, size


def jaro_winkler_pairs(left: list[str], right: list[str]) -> np.ndarray:
    """``jaro_winkler_pair`` of each left and right text."""
    out = np.zeros(len(left))
    order = np.argsort([max(len(a), len(b)) for a, b in zip(left, right, strict=True)], kind="stable")
    at = 0
    while at < len(order):
        some = order[at : at + PAIRS]
        widest = lambda part: max(len(left[part[-1]]), len(right[part[-1]]), 1)
        while len(some) > 1 and len(some) * widest(some) > CELLS:
            some = some[: len(some) // 2]
        out[some] = _compared([left[i] for i in some], [right[i] for i in some])
        at += len(some)
    return out


def _compared(left: list[str], right: list[str]) -> np.ndarray:
    (a, la), (b, lb) = letters(left), letters(right)
    reach = np.maximum(la, lb) // 2 - 1
    free = np.arange(b.shape[1]) < lb[:, None]
    mine, rows, place = np.zeros(a.shape, bool), np.arange(len(a)), np.arange(b.shape[1])
    for i in range(a.shape[1]):
        # the first free equal character in the window, if there is one
        hit = free & (b == a[:, i, None]) & (np.abs(place - i) <= reach[:, None])
        j = hit.argmax(1)
        found = hit[rows, j]
        free[rows[found], j[found]] = False
        mine[:, i] = found
    m = mine.sum(1)
    theirs = ~free & (place < lb[:, None])
    # matched characters of both in their orders, side by side
    n = int(m.max(initial=0))
    first = np.take_along_axis(a, np.argsort(~mine, 1, kind="stable")[:, :n], 1)
    second = np.take_along_axis(b, np.argsort(~theirs, 1, kind="stable")[:, :n], 1)
    moved = ((first != second) & (np.arange(n) < m[:, None])).sum(1) / 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (some - moved) / some) / 3, 0.0)
    k = min(4, a.shape[1], b.shape[1])
    prefix = np.cumprod((a[:, :k] == b[:, :k]) & (np.arange(k) < np.minimum(la, lb)[:, None]), 1).sum(1)
    score = np.where(m > 0, jaro + prefix * 0.1 * (1 - jaro), 0.0)
    return np.where((la == 0) & (lb == 0), 1.0, score)


@F.arrow_udf(DoubleType())
def jaro_winkler(a: pa.Array, b: pa.Array) -> pa.Array:
    known = np.array([x and y for x, y in zip(a.is_valid().to_pylist(), b.is_valid().to_pylist(), strict=True)], bool)
    score = jaro_winkler_pairs(*([x or "" for x in side.to_pylist()] for side in (a, b)))
    return pa.array(score, pa.float64(), mask=~known)


def similarity(a: Column, b: Column) -> Column:
    """0.4 of (1 - edit distance over the longer length) and 0.6 of Jaro-Winkler, of the trimmed lower-case forms; 1 if those are equal."""
    x, y = F.lower(trim(a)), F.lower(trim(b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 1.0).otherwise(0.4 * (1 - F.levenshtein(x, y) / longest) + 0.6 * jaro_winkler(x, y))


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distances of each left and right text, a row of the table of all pairs at a time."""
    (a, la), (b, lb) = letters(left), letters(right)
    out, steps = np.zeros(len(a), np.int64), np.arange(b.shape[1] + 1)
    row = np.broadcast_to(steps, (len(a), len(steps))).copy()
    out[la == 0] = lb[la == 0]
    for i in range(int(la.max(initial=0))):
        change = row[:, :-1] + (b != a[:, i, None])
        row = np.concatenate([np.full((len(a), 1), i + 1), np.minimum(change, row[:, 1:] + 1)], 1)
        # insertions: the least of any earlier cell and the steps from it
        row = np.minimum.accumulate(row - steps, 1) + steps
        done = la == i + 1
        out[done] = row[done, lb[done]]
    return out


def similarity_pairs(left: list[str], right: list[str]) -> np.ndarray:
    """``similarity`` of trimmed lower-case texts."""
    longest = np.array([max(len(x), len(y), 1) for x, y in zip(left, right, strict=True)])
    score = 0.4 * (1 - distances(left, right) / longest) + 0.6 * jaro_winkler_pairs(left, right)
    return np.where([x == y for x, y in zip(left, right, strict=True)], 1.0, score)


@F.arrow_udf(DoubleType())
def similarity_score(a: pa.Array, b: pa.Array) -> pa.Array:
    """``similarity`` of texts as they are, for SQL; it trims and lower-cases them in Python's way."""
    known = np.array([x and y for x, y in zip(a.is_valid().to_pylist(), b.is_valid().to_pylist(), strict=True)], bool)
    plain = lambda side: [(x or "").strip().lower() for x in side.to_pylist()]
    return pa.array(similarity_pairs(plain(a), plain(b)) if len(known) else [], pa.float64(), mask=~known if len(known) else None)


def length_bound(least: float) -> float:
    """The least ratio of lengths at which ``similarity`` can reach ``least``: a score is at most 0.52 r + 0.48."""
    return max(0.0, (least - 0.48) / 0.52 - 1e-9)


def register(spark) -> None:
    """jaro_winkler and similarity_score for SQL."""
    spark.udf.register("jaro_winkler", jaro_winkler)
    spark.udf.register("similarity_score", similarity_score)
