"""Which names can score a threshold with which candidates, from shared pairs of letters: a lossless index that joins by equality.

A score of t leaves at most (1 - t) / 0.46 of the longer text's length in edits. With k edits, m matched letters and
h half transpositions, aligning the matched letters in order costs 2 h, and what is left of both texts the rest, so
k <= 2 h + a + b - 2 m for lengths a and b. Jaro's score is then at most 1 - k / (6 longest), while k is below half of
the longest; with the bonus for a common prefix at most 1 - k / (10 longest); and the whole at most 1 - 0.46 k / longest.

An edit changes two pairs of neighbouring letters at most, so texts share at least a number of pairs that their
longer length tells. Pairs stand in one order, rare ones first; of texts that share b, all but the last b - n of each
hold n shared ones, and these n together are a key that both texts have.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import similarity_pairs

#: Thresholds below this leave so many edits that texts need share nothing: they need another way.
LEAST = 0.8
#: Pairs that make a key, if texts share so many, up to these lengths: long texts have few combinations to a key, so that keys don't outnumber letters by much.
TOGETHER = ((3, 32), (2, 64), (1, None))
#: What an edit of a text as long as one letter costs the score at least.
EDIT = 0.46
#: Pairs of letters whose numbers are looked up for the order; all others count as rare. Characters that are compared at once.
COMMON, CELLS = 20_000, 1 << 20


def most_edits(longest: int, least: float) -> int:
    return int((1 - least) / EDIT * longest + 1e-9)


def shared_least(longest: int, least: float) -> int:
    """Pairs of letters that texts share at least if their score is ``least`` and the longer has ``longest`` letters."""
    return longest - 1 - 2 * most_edits(longest, least)


def partners(length: int, least: float) -> list[int]:
    """Lengths that the longer text can have if one text has ``length``."""
    out = []
    longest = length
    while longest - length <= most_edits(longest, least):
        out.append(longest)
        longest += 1
    return out


def together(longest: int, least: float) -> int:
    """How many pairs make a key for texts of which the longer has ``longest`` letters; 0 where they need share none."""
    n = shared_least(longest, least)
    return next((many for many, most in TOGETHER if n >= many and (most is None or longest <= most)), 0)


def letter_pairs(text: str) -> list[tuple[str, int]]:
    """Neighbouring letters, each with the number of equal ones before it."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(text) - 1):
        pair = text[i : i + 2]
        out.append((pair, seen.get(pair, 0)))
        seen[pair] = out[-1][1] + 1
    return out


def keys(text: str, least: float, often: dict[str, int]) -> set[str]:
    """Keys of a text: texts that can score ``least`` have one in common, whatever ``often`` says."""
    tokens = sorted(letter_pairs(text), key=lambda t: (often.get(t[0], 0) >> t[1], t))
    needs: dict[int, int] = {}
    for longest in partners(len(text), least):
        n, many = shared_least(longest, least), together(longest, least)
        needs[many] = min(needs.get(many, n), n)
    found = {f"0 {longest}" for longest in partners(len(text), least) if not together(longest, least)}
    for many, n in needs.items():
        if many:
            found.update(f"{many} " + " ".join(f"{pair}{k}" for pair, k in some) for some in combinations(tokens[: max(0, len(tokens) - n + many)], many))
    return found


def _keyed(texts: DataFrame, column: str, least: float, often: dict[str, int]) -> DataFrame:
    """``texts`` with a row for each ``key``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [sorted(keys(x, least, often)) for x in batch.column(column).to_pylist()]
            at = pa.array([i for i, k in enumerate(each) for _ in k], pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array([k for ks in each for k in ks], pa.string())], names=[*batch.schema.names, "key"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInArrow(rows, f"{kinds}, key string")


def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, c, cand_seq, score) of rows (n, x, c, cand_seq, y), so many at once as CELLS allows."""
    for batch in batches:
        x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
        sizes = [max(len(a), len(b), 1) for a, b in zip(x, y, strict=True)]
        at = 0
        while at < len(x):
            end, widest = at, 1
            while end < len(x) and (end == at or max(widest, sizes[end]) * (end - at + 1) <= CELLS):
                widest = max(widest, sizes[end])
                end += 1
            some = batch.slice(at, end - at)
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("n", "c", "cand_seq")), pa.array(similarity_pairs(x[at:end], y[at:end]), pa.float64())], names=["n", "c", "cand_seq", "score"])
            at = end


def often_pairs(texts: DataFrame, column: str) -> dict[str, int]:
    """How often the COMMON most frequent pairs of neighbouring letters come."""
    start = F.sequence(F.lit(1), F.length(column) - 1)
    pairs = texts.where(F.length(column) > 1).select(F.explode(F.transform(start, lambda i: F.substr(F.col(column), i, F.lit(2)))).alias("pair"))
    return {r.pair: r["count"] for r in pairs.groupBy("pair").count().orderBy(F.desc("count"), "pair").limit(COMMON).collect()}


def met(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(n, x, c, cand_seq, y): the pairs of left (n, x) and right (c, cand_seq, y) that have a key in common; ``least`` is LEAST or more."""
    often = often_pairs(right, "y")
    return _keyed(left, "x", least, often).join(_keyed(right, "y", least, often), "key").drop("key").distinct()


def matches(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(n, c, cand_seq, score) of all pairs of left (n, x) and right (c, cand_seq, y) that score ``least``, which is LEAST or more."""
    return met(left, right, least).mapInArrow(scores, "n string, c string, cand_seq long, score double").where(F.col("score") >= least)
