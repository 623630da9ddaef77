"""Filter interaction audit: what each filter removes in every order of five filters.

Texts are dealt by ranges of (fingerprint, doc_id) and sorted by fingerprint, full text and doc_id, so equal texts stand
together, the least id first. A task compares each row with the one before it and measures the other filters on
the way; the first fingerprint of a partition may go on from the partitions before, so its texts are compared once
more between partitions. What is left of a document is a mask of failures; counts of masks add up, and all orders are worked
out from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import saved, string_bytes, tidy, whole_text

FILTERS = "ABCDE"
#: Limits of the filters: words at least, percent of distinct words at least, percent of capitals at most, signs.
WORDS_LEAST, DISTINCT_LEAST, CAPITALS_MOST, SIGNS = 100, 80, 10, b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_INSIDE = bytes(range(0x80, 0xC0))  # bytes that don't begin a character
#: Longer texts are cut into words in windows of so many bytes.
WINDOW = 1 << 20
_SPACE = b" \t\n\v\f\r"


def _windows(text: memoryview) -> Iterator[list[bytes]]:
    """The words of a text, window by window; a word that a window cuts goes to the next."""
    rest = b""
    for at in range(0, len(text), WINDOW):
        part = rest + bytes(text[at : at + WINDOW])
        words = part.split()
        rest = words.pop() if words and part[-1] not in _SPACE else b""
        yield words
    yield [rest] if rest else []


def word_counts(text: memoryview) -> tuple[int, bool]:
    """(words, whether fewer than DISTINCT_LEAST percent of them are distinct); words are what ASCII white space separates."""
    if len(text) <= WINDOW:
        words = bytes(text).split()
        return len(words), 100 * len(set(words)) < DISTINCT_LEAST * len(words)
    count, seen = sum(map(len, _windows(text))), set()
    for words in _windows(text):
        seen.update(words)
        if 100 * len(seen) >= DISTINCT_LEAST * count:
            return count, False
    return count, True


def failures(text: memoryview) -> int:
    """Bits of the filters A to D that a text fails."""
    count, few = word_counts(text)
    capitals = points = signs = 0
    for at in range(0, len(text), WINDOW):
        part = bytes(text[at : at + WINDOW])
        capitals += len(part) - len(part.translate(None, CAPITALS))
        points += len(part.translate(None, _INSIDE))
        signs += len(part) - len(part.translate(None, SIGNS))
    return (count < WORDS_LEAST) | few << 1 | (100 * capitals > CAPITALS_MOST * points) << 2 | (signs > 0) << 3


def fingerprint(text: Column) -> Column:
    """What texts are sorted by first; texts that share it are told apart by the whole text."""
    return F.xxhash64(text)


SCHEMA = "id long, part string, mask int, cut int, run int, mark long, text string, least long"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, part, mask, cut, run) of a sorted partition: E is set where a smaller id of the partition has the same text.

    run is the number of the row's text among those of the partition's first fingerprint, -1 behind it. The texts of
    the first and the last fingerprint follow as rows with mark, text and least id, mask -1.
    """
    cut = TaskContext.get().partitionId()
    first = mark = text = least = None
    run, current, first_done = -1, [], False
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64()]

    def edges(runs: list) -> pa.RecordBatch:
        columns = list(zip(*[(None, None, -1, cut, n, m, t, x) for n, m, t, x in runs], strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        ids, parts, marks, texts = (batch.column(i) for i in range(4))
        data, bounds = string_bytes(texts)
        view = memoryview(data)
        same = np.zeros(batch.num_rows, bool)
        if batch.num_rows > 1:
            same[1:] = pc.and_(pc.equal(marks.slice(1), marks.slice(0, batch.num_rows - 1)), pc.equal(texts.slice(1), texts.slice(0, batch.num_rows - 1))).to_numpy(zero_copy_only=False)
        known, values = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        marks_ = marks.to_numpy(zero_copy_only=False)
        masks, runs = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, -1, np.int32)
        bits = 0
        for i in range(batch.num_rows):
            if not same[i]:
                mine = view[bounds[i] : bounds[i + 1]]
                if i == 0 and text is not None and mark == marks_[0] and text == mine:
                    same[0] = True
                else:
                    if mark is not None and mark != marks_[i]:
                        if not first_done:
                            yield edges(current)
                            first_done = True
                        current = []
                    mark, run = int(marks_[i]), run + 1
                    first = mark if first is None else first
                    least = int(values[i]) if known[i] else None
                    current.append((run, mark, bytes(mine).decode("utf-8", "surrogatepass"), least))
                if i == 0 or not same[i]:
                    bits = failures(mine)
            masks[i] = bits | (16 if known[i] and least is not None and values[i] > least else 0)
            if mark == first and not first_done:
                runs[i] = run
        if batch.num_rows:
            text = bytes(view[bounds[-2] : bounds[-1]])
        none = [pa.nulls(batch.num_rows, k) for k in kinds[5:]]
        yield pa.RecordBatch.from_arrays([ids, parts, pa.array(masks), pa.array(np.full(batch.num_rows, cut, np.int32)), pa.array(runs), *none], names=names)
    yield edges(current)


def failure_masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, mask) of every row: the bits of A to E that it fails, E where a smaller id has the same text."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole_text(text).alias("text"))
    rows = rows.select("id", "part", fingerprint(F.col("text")).alias("mark"), "text")
    # the ranges are of fingerprint and id, so that Spark's sample of them holds no texts
    order = [F.col("id").asc_nulls_last()]
    dealt = rows.repartitionByRange(F.col("mark"), *order).sortWithinPartitions("mark", "text", *order)
    found = saved(dealt.mapInArrow(tidy(_compared), SCHEMA), "masks")
    edges = found.where("mask = -1").select("cut", "run", "mark", "text", "least").distinct()
    whole = edges.groupBy("mark", "text").agg(F.min("least").alias("_least"))
    heads = edges.join(whole, ["mark", "text"]).select("cut", "run", "_least")
    plain = found.where("mask >= 0 and run = -1").select("id", "part", "mask")
    begun = found.where("mask >= 0 and run >= 0").join(heads, ["cut", "run"])
    late = F.when(F.col("id") > F.col("_least"), 16).otherwise(0)
    return plain.unionByName(begun.select("id", "part", F.col("mask").bitwiseOR(late).alias("mask")))


def counters(masks: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic), a row for each mask of a part. A document is good or toxic if any of its labels says so."""
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    flags = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    each = masks.join(flags, "id", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return each.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), zero("good"), zero("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of the filters."""
    steps = []
    for order in permutations(FILTERS):
        for k, name in enumerate(order):
            steps.append(("".join(order), k + 1, 1 << FILTERS.index(name), sum(1 << FILTERS.index(x) for x in order[:k])))
    listed = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(e).alias("before")) for o, s, b, e in steps])
    rows = counts.withColumn("s", F.explode(listed)).select("*", "s.*")  # at most 32 masks of a part, 600 steps each
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    sums = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    out = rows.groupBy("part", "filter_order", "step", "bit").agg(
        sums(~fails & ~gone).alias("kept"), sums(fails & ~gone).alias("removed"), sums(fails & gone).alias("redundant"), sums(F.col("mask") == F.col("bit")).alias("unique_fails"),
        sums(fails & ~gone, "good").alias("good_lost"), sums(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    shares = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return out.join(shares, ["part", "bit"]).drop("bit")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """What each of five filters does at each step of each of their 120 orders, for each part of the documents.

    Null texts count as empty and null parts as the empty string. E fails a row if a smaller key of the table has the
    same text; a null key is neither smaller nor larger. Repeated rows count as often as they come. Long texts are
    measured in windows. Other columns play no part, whatever their names; an empty table gives no rows.
    """
    return interactions(counters(failure_masks(docs, key, text, part), labels, key))


def _oracle() -> str:
    orders = ", ".join(f"('{''.join(o)}')" for o in permutations(FILTERS))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (SELECT doc_id, part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: coalesce(CASE f WHEN 'A' THEN len(words) < 100 WHEN 'B' THEN 100 * list_unique(words) < 80 * len(words)
  WHEN 'C' THEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) WHEN 'D' THEN regexp_matches(text, '[#$%&*|]') ELSE doc_id > least END, false)) AS fails FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
g AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, fails),
s AS (SELECT filter_order, step, filter_order[step] AS f, string_split(left(filter_order, step - 1), '') AS before FROM (VALUES {orders}) o(filter_order), range(1, 6) t(step)),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, f, CAST(sum(CASE WHEN NOT list_contains(fails, f) AND NOT list_has_any(fails, before) THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN list_contains(fails, f) AND NOT list_has_any(fails, before) THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN list_contains(fails, f) AND list_has_any(fails, before) THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fails = [f] THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN list_contains(fails, f) AND NOT list_has_any(fails, before) THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN list_contains(fails, f) AND NOT list_has_any(fails, before) THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM g, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""


ORACLE = _oracle()
