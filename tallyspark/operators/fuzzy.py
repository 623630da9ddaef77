"""Fuzzy name matching.

High thresholds go through an index that joins by equality (``names_index``). Where the best candidates of each name are asked
for, thresholds fall step by step, and a name that has found its best leaves. What is left for a low threshold is held
against all candidates: names and candidates are packed into blocks of bounded size, and in a task a bound on the
score from lengths, common letters and the common prefix leaves out pairs that cannot reach the threshold or a
name's best so far. Nothing that could match is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import automaton
from ..functions.similarity import similarity, similarity_pairs
from ..functions.text import trim
from ..sources.tables import saved
from . import names_index

#: Names and candidates in a block, and candidates of a name that are scored together.
NAMES, CANDIDATES, SCORED = 512, 4096, 32
#: Up to so many entries of a dictionary one expression replaces them in turn; each is nested in the next, which Catalyst takes badly.
ENTRIES = 6
#: Thresholds at which names that look for their best try the index.
STEPS = (0.92, 0.85)
#: Up to so many pairs, blocks alone are faster.
PAIRS = 1 << 24


def _letters(texts: list[str], known: dict[str, int]) -> np.ndarray:
    """Counts of the known letters in each text."""
    out = np.zeros((len(texts), len(known)), np.float32)
    for row, text in zip(out, texts, strict=True):
        for c in text:
            if c in known:
                row[known[c]] += 1
    return out


def bounds(names: list[str], candidates: list[str]) -> np.ndarray:
    """The most that each name (row) and candidate (column) can score: matches are at most their common letters."""
    known = {c: i for i, c in enumerate(sorted(set("".join(names))))}
    a, b = _letters(names, known), _letters(candidates, known)
    common = np.zeros((len(names), len(candidates)), np.float32)
    for i in range(len(known)):
        common += np.minimum(a[:, i, None], b[None, :, i])
    la, lb = (np.array([len(t) for t in x], np.float64) for x in (names, candidates))
    jaro = (common / np.maximum(la, 1)[:, None] + common / np.maximum(lb, 1) + 1) / 3
    heads = lambda x, none: np.array([[ord(t[i]) if i < len(t) else none for i in range(4)] for t in x]).reshape(-1, 4)
    prefix = np.cumprod(heads(names, -1)[:, None, :] == heads(candidates, -2)[None], axis=2).sum(2)
    longest = np.maximum(np.maximum(la[:, None], lb), 1)
    most = 0.4 * common / longest + 0.6 * np.where(common > 0, jaro + 0.1 * prefix * (1 - jaro), 0)
    most[(la[:, None] == 0) & (lb == 0)] = 1
    return most + 1e-6  # rounding


def _plain(names: DataFrame, candidates: DataFrame, name: str, candidate: str) -> tuple[DataFrame, DataFrame]:
    """(n, x) of distinct names and (c, cand_seq, y) of distinct candidates; x and y are compared."""
    plain = lambda c: F.lower(trim(F.col(c)))
    left = names.select(F.col(name).cast("string").alias("n")).where("n is not null").distinct().withColumn("x", plain("n"))
    right = candidates.where(F.col(candidate).isNotNull()).groupBy(F.col(candidate).cast("string").alias("c")).agg(F.min(F.col("cand_seq").cast("long")).alias("cand_seq")).withColumn("y", plain("c"))
    return left, right


def _met(left: DataFrame, right: DataFrame, least: float, best: int | None) -> DataFrame:
    """(n, c, cand_seq, score) of pairs whose bound reaches ``least``, score null; or of the ``best`` of each name in a block, with scores."""
    asked, offered = max(1, -(-left.count() // NAMES)), max(1, -(-right.count() // CANDIDATES))
    packed = lambda frame, key, blocks, to, *fields: frame.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(to)).agg(F.collect_list(F.struct(*fields)).alias(f"{to}_rows"))
    pairs = packed(left, "n", asked, "i", "n", "x").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(offered - 1))))
    pairs = pairs.repartition("i", "j").join(packed(right, "c", offered, "j", "c", "cand_seq", "y"), "j").select("i_rows", "j_rows")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("n", pa.string()), ("c", pa.string()), ("cand_seq", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            for row in range(batch.num_rows):
                ours, theirs = batch.column("i_rows")[row].values, batch.column("j_rows")[row].values
                n, x = ours.field("n").to_pylist(), ours.field("x").to_pylist()
                c, seq, y = (theirs.field(f).to_pylist() for f in ("c", "cand_seq", "y"))
                for start in range(0, len(n), 64):
                    most = bounds(x[start : start + 64], y)
                    found = []
                    for k, can in enumerate(most, start):
                        if best is None:
                            found += [(n[k], c[j], seq[j], None) for j in np.flatnonzero(can >= least)]
                            continue
                        top = []
                        order = np.argsort(-can, kind="stable")
                        for s in range(0, len(order), SCORED):
                            some = [j for j in order[s : s + SCORED].tolist() if can[j] >= least and (len(top) < best or can[j] >= -top[-1][0])]
                            if not some:
                                break
                            scores = similarity_pairs([x[k]] * len(some), [y[j] for j in some])
                            top = sorted([*top, *((-v, seq[j] is not None, seq[j] or 0, c[j], j) for v, j in zip(scores.tolist(), some, strict=True) if v >= least)])[:best]
                        found += [(n[k], c[j], seq[j], -s) for s, _, _, _, j in top]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found) if found else [[]] * 4, schema.types, strict=True)], schema=schema)

    return pairs.mapInArrow(scored, "n string, c string, cand_seq long, score double")


def scored_pairs(names: DataFrame, candidates: DataFrame, least: float, name: str = "name", candidate: str = "candidate") -> DataFrame:
    """Pairs of distinct names and candidates that can score ``least``, with their score."""
    left, right = _plain(names, candidates, name, candidate)
    if least >= names_index.LEAST:
        pairs = names_index.matches(left, right, least)
    else:
        pairs = _met(left, right, least, None).withColumn("score", similarity(F.col("n"), F.col("c")))
    return pairs.select(F.col("n").alias(name), F.col("c").alias(candidate), "cand_seq", "score")


def find_matches(names: DataFrame, candidates: DataFrame, least: float = 0.7) -> DataFrame:
    """All candidates that score ``least`` or more, a name's together and best first."""
    return scored_pairs(names, candidates, least).where(F.col("score") >= least).repartition("name").sortWithinPartitions("name", F.desc("score"), "cand_seq")


def _best(names: DataFrame, candidates: DataFrame, least: float, best: int) -> DataFrame:
    """(name, candidate, cand_seq, score, rank): the ``best`` of each name that score ``least`` or more.

    A name with that many of a step's threshold has its best among them; the others go on to the next step.
    """
    left, right = _plain(names, candidates, "name", "candidate")
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "cand_seq", "c"))
    ranked = lambda pairs: pairs.withColumn("rank", rank).where(F.col("rank") <= best)
    found = None
    steps = [t for t in STEPS if t > least] if left.count() * right.count() > PAIRS else []
    right = saved(right, "candidates") if steps else right
    for t in steps:
        tried = saved(ranked(names_index.matches(left, right, t)), "matches")
        done = tried.where(F.col("rank") == best).select("n")
        some = tried.join(done, "n", "left_semi")
        found = some if found is None else found.unionByName(some)
        left = saved(left.join(done, "n", "left_anti"), "names")
    rest = names_index.matches(left, right, least) if least >= names_index.LEAST else _met(left, right, least, best)
    last = ranked(rest.where(F.col("score") >= least))
    all_ = last if found is None else found.unionByName(last)
    return all_.select(F.col("n").alias("name"), F.col("c").alias("candidate"), "cand_seq", "score", "rank")


def nearest(names: DataFrame, candidates: DataFrame, least: float = 0.7) -> DataFrame:
    """For each name its best candidate above ``least``, the earliest of equals."""
    return _best(names, candidates, least, 1).where(F.col("score") > least).drop("rank")


def top_matches(names: DataFrame, candidates: DataFrame, n: int = 3, least: float = 0.0) -> DataFrame:
    """For each name its ``n`` best candidates that score ``least`` or more."""
    return _best(names, candidates, least, n)


def corrected_names(names: DataFrame, candidates: DataFrame, least: float = 0.85) -> DataFrame:
    """``names`` with ``corrected``: the nearest candidate, or the name itself."""
    best = nearest(names, candidates, least).select("name", F.col("candidate").alias("_best"))
    return names.join(best, "name", "left").withColumn("corrected", F.coalesce("_best", "name")).drop("_best")


def dictionary_corrected(rows: DataFrame, entries: list, column: str = "text") -> DataFrame:
    """``rows`` with the misreads of a dictionary replaced in turn and ``corrections`` counted.

    An entry meant for Hebrew surroundings applies between Hebrew letters only. A long dictionary goes through an
    automaton, and only texts that hold a misread are worked on.
    """
    live = [e for e in entries if e["misread"] != e["correction"]]
    if len(live) > ENTRIES:
        return _many_corrected(rows, live, column)
    text, count = F.col(column), F.lit(0)
    for e in live:
        if e["context"] == "hebrew_letter_in_numeric_field":
            pattern = f"(?<=[א-ת]){e['misread']}(?=[א-ת])"
            count = count + F.regexp_count(text, F.lit(pattern))
            text = F.regexp_replace(text, pattern, e["correction"])
        else:
            quoted = F.lit("\\Q" + e["misread"] + "\\E")
            whole = F.lit(f"(?<![א-ת])\\Q{e['misread']}\\E(?![א-ת])") if e["context"].startswith("hebrew") else quoted
            count = count + F.regexp_count(text, whole)
            text = F.regexp_replace(text, whole, F.lit(e["correction"]))
    return rows.withColumns({"corrected": text, "corrections": count})


def _surrounded(entry: dict) -> re.Pattern:
    """An entry's misread in the surroundings that it is meant for."""
    word = re.escape(entry["misread"])
    if entry["context"] == "hebrew_letter_in_numeric_field":
        return re.compile(f"(?<=[א-ת]){word}(?=[א-ת])")
    return re.compile(f"(?<![א-ת]){word}(?![א-ת])" if entry["context"].startswith("hebrew") else word)


def in_turn(text: str, entries: list[dict], patterns: list[re.Pattern], made: list) -> tuple[str, int]:
    """A text after all entries in turn, and how many places were corrected: after each the next entry is one whose misread the text then holds."""
    count, at = 0, 0
    while True:
        held = automaton.next_word(text, made, at)
        if held is None:
            return text, count
        text, n = patterns[held].subn(lambda _, to=entries[held]["correction"]: to, text)
        count, at = count + n, held + 1


def _many_corrected(rows: DataFrame, entries: list[dict], column: str) -> DataFrame:
    """``dictionary_corrected`` with a long dictionary; misreads are taken as they are, in any surroundings."""
    words = [e["misread"] for e in entries]
    made, patterns = automaton.automata(words), [_surrounded(e) for e in entries]

    @F.arrow_udf("struct<text:string,n:int>")
    def corrected(texts: pa.Array) -> pa.Array:
        plain = texts.to_pylist()
        first = automaton.first_words([x or "" for x in plain], made, len(words))
        done = [(x, 0) if x is None or f == len(words) else in_turn(x, entries, patterns, made) for x, f in zip(plain, first.tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in done], pa.string()), pa.array([None if t is None else n for t, n in done], pa.int32())], names=["text", "n"])

    found = rows.withColumn("_c", corrected(F.col(column).cast("string")))
    return found.withColumns({"corrected": F.col("_c.text"), "corrections": F.col("_c.n")}).drop("_c")
