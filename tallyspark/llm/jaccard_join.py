"""N-gram Jaccard join: documents whose sets of word n-grams overlap enough, and their components.

Exact up to 64-bit hashes of words and n-grams. The way there:

1. Each document's set is made in its task. Documents of equal sets form a class; one of them stands for it.
2. Two sets that overlap enough share an n-gram among the first n - ceil(t n) + 1 of each, in any order of all
   n-grams. The order puts n-grams that a sample of documents holds often last, so common passages bring hardly
   anyone together; n-grams of these prefixes are shuffled, and only those that several documents hold stay.
3. Where few documents share an n-gram, each pair of fitting sizes gets a count; pairs whose prefixes share too
   little for their sizes are dropped. Where many do, those whose n-grams behind it can't be enough for any of them leave, and no task gathers the others: a minimum for each n-gram names one of
   them, a salted join tells the others. Each document is first held against one such, its home; those that match it
   are linked to each other through it. What is left is held against the members of the homes it shares an n-gram with.
4. Candidates are counted in blocks: the product of two blocks' document by n-gram matrices has the overlaps,
   and pairs below the bound that their sizes set are dropped. Only links leave a task.
5. Links make components, by alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import CHUNK_BYTES, SpanHash, dropped, fresh, gathered, mixed, saved, spans, string_bytes, tidy, whole_text

#: Default n-gram length in words and least similarity in percent.
WORDS, PERCENT = 5, 75
#: Common n-grams are looked for in an eighth of the documents, but at least so many; at most so many n-grams are kept. They set an order, and so speed, never the result.
SAMPLE_SHARE, SAMPLE_LEAST, COMMON_MOST = 1 / 8, 2000, 1 << 20
#: Up to so many holders of an n-gram, the n-grams that each pair shares are counted.
FEW = 48
#: Rows of one n-gram are dealt to so many tasks by a salt.
SALTS = 32
#: Documents on a side of a block product and n-grams that they may hold together; columns of a dense product.
BLOCK, BLOCK_GRAMS, COLUMNS = 256, 1 << 19, 8192
#: Rows of Arrow batches of sets and of texts, while this module writes a table.
SET_ROWS, TEXT_ROWS = 128, 1000
#: Slots of the filter that keeps texts without candidates from the shuffle that fetches sets.
FILTER_BITS = 22

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


class Shingles:
    """Sorted distinct n-gram hashes of consecutive texts."""

    def __init__(self, words: int, window: int = CHUNK_BYTES) -> None:
        self.words, self.window, self.hash = words, window, SpanHash()

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, each text's first word)."""
        rows = len(offsets) - 1
        buffer = np.full(len(data) + rows, 10, np.uint8)
        buffer[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offsets))] = _LOW[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[buffer], [True])).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        return self.hash(buffer, begin, end), np.searchsorted(begin, offsets + np.arange(rows + 1))

    def _grams(self, word: np.ndarray) -> np.ndarray:
        grams = np.full(max(len(word) - self.words + 1, 0), np.uint64(self.words))
        for j in range(self.words if len(grams) else 0):
            grams = grams * np.uint64(0xD6E8FEB86659FD93) + word[j : j + len(grams)]
        return mixed(grams)

    def _long_text(self, data: np.ndarray) -> np.ndarray:
        """The set of one text, a window at a time: windows end at white space, the last words of one go on before the next."""
        at, last, sets = 0, np.zeros(0, np.uint64), []
        while at < len(data):
            size = self.window
            while True:
                end = min(at + size, len(data))
                cut = len(data) - at if end == len(data) else int(np.max(np.flatnonzero(_BLANK[data[at:end]]), initial=0))
                if cut:
                    break
                size *= 2
            word, _ = self._words(data[at : at + cut], np.array([0, cut]))
            word = np.concatenate([last, word])
            sets.append(np.unique(self._grams(word)))
            last, at = word[max(len(word) - self.words + 1, 0) :], at + cut
        found = np.unique(np.concatenate(sets))
        return found if len(found) else self._few(last)

    def _few(self, word: np.ndarray) -> np.ndarray:
        """The whole sequence of fewer words as one n-gram."""
        x = np.full(min(len(word), 1), np.uint64(len(word)))
        for w in word:
            x = x * np.uint64(0xD6E8FEB86659FD93) + w
        return mixed(x)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, offsets into them); a text of fewer words has its whole sequence as one n-gram."""
        if len(offsets) == 2 and len(data) > self.window:
            out = [self._long_text(data)]
        else:
            word, first = self._words(data, offsets)
            grams, k, out = self._grams(word), self.words, []
            for s, m in zip(first[:-1].tolist(), np.diff(first).tolist(), strict=True):
                if m >= k:
                    x = np.sort(grams[s : s + m - k + 1])
                    out.append(x[np.append(True, x[1:] != x[:-1])])
                else:
                    out.append(self._few(word[s : s + m]))
        return np.concatenate(out) if out else np.empty(0, np.uint64), np.append(0, np.cumsum([len(x) for x in out], dtype=np.int64))


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, first row, end row, hashes, offsets) of the texts in each batch's last column, a few MB at a time."""
    shingles = Shingles(words)
    for batch in batches:
        data, bounds = string_bytes(batch.column(batch.num_columns - 1))
        for a, b in spans(bounds):
            yield batch, a, b, *shingles(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def common_ngrams(docs: DataFrame, key: str, text: str, words: int, most: int = COMMON_MOST) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the n-grams that at least two sampled documents hold, the ``most`` frequent."""
    rows = docs.count()
    take = max(rows * SAMPLE_SHARE, SAMPLE_LEAST)
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("ngrams")), F.lit(1 << 30))
    some = docs.where(draw < int(min(1.0, take / max(rows, 1)) * (1 << 30))).select(whole_text(text).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, hashes, _ in _sets(batches, words):
            found, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_long(found)), pa.array(n, pa.int64())], names=["h", "n"])

    scratch: list[str] = []
    found = saved(some.mapInArrow(tidy(counted), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "common", scratch)
    if found.count() > most:
        found = found.orderBy(F.desc("n"), "h").limit(most)
    table = found.toArrow()
    dropped(docs.sparkSession, scratch)
    h, n = np.asarray(table.column("h"), np.int64).view(np.uint64), np.asarray(table.column("n"), np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _bound(a, b, percent: int):
    """Least overlap of linked sets of sizes a and b: 100 o >= p (a + b - o)."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def signatures(docs: DataFrame, key: str, text: str, words: int, percent: int, most: int = COMMON_MOST) -> DataFrame:
    """(id, n, k1, k2, prefix): set size, a 128-bit name of the set, and the n-grams that a linked set must share one of, rarest first."""
    h, n = common_ngrams(docs, key, text, words, most)
    shared = docs.sparkSession.sparkContext.broadcast((h, n))  # at most `most` numbers each

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, weight = shared.value
        marks = np.zeros(1 << 22, bool)
        marks[(hot & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for batch, a, b, hashes, ends in _sets(batches, words):
            rank = np.zeros(len(hashes), np.int64)
            maybe = np.flatnonzero(marks[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
            if len(maybe):
                at = np.minimum(np.searchsorted(hot, hashes[maybe]), len(hot) - 1)
                rank[maybe] = np.where(hot[at] == hashes[maybe], weight[at], 0)
            size = np.diff(ends)
            keep = np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)
            order = np.arange(len(hashes))
            for i in np.flatnonzero(np.add.reduceat(np.append(rank, 0), ends[:-1]) * (size > 0)).tolist():
                s, e = ends[i], ends[i + 1]
                order[s:e] = s + np.argsort(rank[s:e], kind="stable")
            prefix = hashes[order[gathered(np.arange(len(hashes)), ends[:-1], keep)]] if len(hashes) else hashes
            names = [np.where(size > 0, np.add.reduceat(np.append(mixed(hashes ^ np.uint64(salt)), np.uint64(0)), ends[:-1]), 0).astype(np.uint64) for salt in (0x51ED270B, 0xA24BAED4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size, pa.int64()), *[pa.array(_long(x)) for x in names], pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(keep)), pa.int32()), pa.array(_long(prefix)))], names=["id", "n", "k1", "k2", "prefix"])

    return docs.select(F.col(key).cast("long").alias("id"), whole_text(text).alias("text")).mapInArrow(tidy(rows), "id long, n long, k1 long, k2 long, prefix array<long>")


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(h)))


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("c", pa.int64())])
#: Rows of (h, id, n) that a task takes together; n-grams in them have few holders each, so they make at most FEW / 2 times as many pairs.
MEET_ROWS = 1 << 16


def _meetings(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of (h, id, n) sorted by h, where few rows share an h: pairs of fitting sizes and how many n-grams of these rows they share."""

    def met(h: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        at, size = _runs(h)
        left = np.arange(len(h))
        after = np.repeat(at + size, size) - left - 1
        a, b = np.repeat(left, after), gathered(left, left + 1, after)
        fits = (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent) & (ids[a] != ids[b])
        a, b = a[fits], b[fits]
        swap = ids[a] > ids[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        order = np.lexsort((n[b], n[a], ids[b], ids[a]))
        a, b = a[order], b[order]
        new = np.append(True, (ids[a][1:] != ids[a][:-1]) | (ids[b][1:] != ids[b][:-1]) | (n[a][1:] != n[a][:-1]) | (n[b][1:] != n[b][:-1])) if len(a) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([*[pa.array(x[k]) for x, k in ((ids, a[first]), (ids, b[first]), (n, a[first]), (n, b[first]))], pa.array(np.diff(np.append(first, len(a))), pa.int64())], schema=_MET)

    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([np.asarray(c) for c in batch.columns])
        if sum(len(x[0]) for x in held) >= MEET_ROWS:
            h, ids, n = (np.concatenate([p[k] for p in held]) for k in range(3))
            cut = int(np.searchsorted(h, h[-1]))  # the last n-gram may go on
            if cut:
                yield met(h[:cut], ids[:cut], n[:cut])
            held = [[h[cut:], ids[cut:], n[cut:]]]
    if held:
        yield met(*(np.concatenate([p[k] for p in held]) for k in range(3)))


def _salts():
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))


def _least(n, m, percent: int):
    """``_bound`` of columns."""
    return F.floor((percent * (n + m) + 99 + percent) / F.lit(100 + percent))


def _enough(n, rest, low, most, percent: int):
    """Whether a set of ``n`` n-grams with ``rest`` behind a shared one can link to any of ``low`` n-grams or more that have at most ``most`` behind it, if it is the first that both share.

    All else that they share comes behind it in both, so their overlap is at most one more than what either has there.
    """
    return 1 + F.least(rest, most) >= _least(n, F.greatest(low, F.ceil(n * percent / F.lit(100))), percent)


def shared_ngrams(entries: DataFrame, percent: int, few: int, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pairs, stars) of the (h, id, n, pos) of all prefixes.

    Pairs (a, b, na, nb, c) share c n-grams that at most ``few`` hold. Stars (h, leader, id, n, rest, live) are the holders of
    the other n-grams, how many of theirs stand behind it, whether that can be enough, and each one's leader: a holder in whose prefix the n-gram stands first, so one with few
    n-grams of its own.

    n-grams are counted by a partial aggregate. Those that one document holds, nearly all, stay behind before rows
    are dealt by n-gram, as far as a filter tells. A second filter, of the n-grams that many hold, sends only rows of those
    through the aggregate that names leaders and a join that deals them by a salt too; other rows are dealt once, where they meet.
    """
    held = saved(entries.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "held", scratch)
    maybe = marked(entries, held.select(F.col("h").alias("id")), "h", "maybe").where("maybe").select("h", "id", "n", "pos")
    holders = saved(marked(maybe, held.where(F.col("k") > few).select(F.col("h").alias("id")), "h", "often"), "holders", scratch)
    hot = holders.where("often").withColumns({"rest": F.col("n") - F.col("pos") - 1, "salt": F.pmod(F.xxhash64("id"), F.lit(SALTS))})
    often = hot.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min_by("id", "pos").alias("leader"), F.min("n").alias("low"), F.max("rest").alias("most")).where(F.col("k") > few)
    often = saved(often, "often", scratch).select("h", "leader", "low", "most", _salts().alias("salt"))
    live = _enough(F.col("n"), F.col("rest"), F.col("low"), F.col("most"), percent)
    met = saved(hot.join(often, ["h", "salt"], "left").select("h", "leader", "id", "n", "rest", live.alias("live")), "stars", scratch)
    some = holders.where("not often").select("h", "id", "n").unionByName(met.where("leader is null").select("h", "id", "n")).repartition("h").sortWithinPartitions("h")
    return some.mapInArrow(tidy(lambda b: _meetings(b, percent)), "a long, b long, na long, nb long, c long"), met.where("leader is not null")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Matrix of overlap counts: the product of two blocks' document by n-gram matrices."""
    nl, nr = len(left), len(right)
    lh, rh = np.concatenate(left), np.concatenate(right)
    lr, rr = np.repeat(np.arange(nl), [len(x) for x in left]), np.repeat(np.arange(nr), [len(x) for x in right])
    order = np.argsort(rh, kind="stable")
    rh, rr = rh[order], rr[order]
    lo, hi = np.searchsorted(rh, lh, "left"), np.searchsorted(rh, lh, "right")
    if (hi - lo).sum() <= 1 << 21:
        pairs = np.repeat(lr, hi - lo) * nr + gathered(rr, lo, hi - lo)
        return np.bincount(pairs, minlength=nl * nr).reshape(nl, nr)
    columns = np.unique(lh[hi > lo])
    total = np.zeros((nl, nr), np.float32)
    for c in range(0, len(columns), COLUMNS):
        some = columns[c : c + COLUMNS]
        dense = []
        for h, r, rows in ((lh, lr, nl), (rh, rr, nr)):
            at = np.minimum(np.searchsorted(some, h), len(some) - 1)
            hit = some[at] == h
            one = np.zeros((rows, len(some)), np.float32)
            one[r[hit], at[hit]] = 1
            dense.append(one)
        total += dense[0] @ dense[1].T
    return np.rint(total).astype(np.int64)


def _blocks(rows: list[tuple[int, np.ndarray, int]]) -> Iterator[list[tuple[int, np.ndarray, int]]]:
    """Runs of at most BLOCK rows that hold at most BLOCK_GRAMS n-grams together, or of one row."""
    some, held = [], 0
    for row in rows:
        if some and (len(some) == BLOCK or held + len(row[1]) > BLOCK_GRAMS):
            yield some
            some, held = [], 0
        some.append(row)
        held += len(row[1])
    if some:
        yield some


def _products(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between the left (side 0) and right (side 1) rows of each task; rows come sorted by task.

    (id, other, linked): a right row tied to its home stands for the home; a left row without any link is named once.
    """
    task, sides = None, None

    def close() -> pa.RecordBatch:
        out: list[tuple[int, int, bool]] = []
        for left in _blocks(sides[0]):
            linked = [set() for _ in left]
            for right in _blocks(sides[1]):
                count = _overlaps([x[1] for x in left], [x[1] for x in right])
                least = _bound(np.array([[len(x[1])] for x in left]), np.array([[len(x[1]) for x in right]]), percent)
                for i, j in zip(*np.nonzero(count >= least), strict=True):
                    if left[i][0] != right[j][0]:
                        linked[i].add(right[j][2])
            for x, others in zip(left, linked, strict=True):
                out += [(x[0], y, True) for y in sorted(others)] or [(x[0], task[0], False)]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_())], names=["id", "other", "linked"])

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("gid", "part", "side", "id", "stands")), strict=True))
        bounds, values = np.asarray(batch.column("grams").offsets), np.asarray(batch.column("grams").values)
        for row, (gid, part, side, ident, stands) in enumerate(keys):
            if (gid, part) != task:
                if task is not None:
                    yield close()
                task, sides = (gid, part), ([], [])
            sides[side].append((ident, values[bounds[row] : bounds[row + 1]].copy(), stands))
    if task is not None:
        yield close()


def _compared(left: DataFrame, right: DataFrame, sets: DataFrame, percent: int, scratch: list[str]) -> DataFrame:
    """Holds each left (gid, id) against each right (gid, id, stands) of the same gid and a size that can match, in tasks of about BLOCK by BLOCK rows.

    Tasks are planned on ids and sizes; sets join the plan last.
    """
    sizes = sets.select("id", "n")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    left = left.join(sizes, "id").withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    right = right.join(sizes, "id").withColumn("band", band)
    counted = lambda side, name: side.groupBy("gid", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    # a table of its own, so that Spark can split a large group where rows join it
    parts = saved(counted(left, "pl").join(counted(right, "pr"), ["gid", "band"]), "parts", scratch)
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    lefts = left.join(parts, ["gid", "band"]).select("gid", "band", own("pl").alias("l"), each("pr").alias("r"), F.lit(0).alias("side"), "id", "n", F.col("id").alias("stands"))
    rights = right.join(parts, ["gid", "band"]).select("gid", "band", each("pl").alias("l"), own("pr").alias("r"), F.lit(1).alias("side"), "id", "n", "stands")
    plan = lefts.unionByName(rights).select("gid", F.concat_ws(".", "band", "l", "r").alias("part"), "side", "id", "n", "stands")
    tasks = plan.join(sets, ["id", "n"]).select("gid", "part", "side", "id", "stands", "grams")
    return tasks.repartition("gid", "part").sortWithinPartitions("gid", "part", "side").mapInArrow(tidy(lambda b: _products(b, percent)), "id long, other long, linked boolean")


def marked(rows: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with ``flag``, a new column: false only where ``key`` isn't in ``ids`` (id).

    Goes by hashes in a table of at most 2 ** (FILTER_BITS - 6) words of bits that all tasks get, so that a join
    need shuffle few other rows. Null keys are false.
    """
    word, bits, bit = (fresh([*rows.columns, flag], x) for x in ("word", "bits", "bit"))
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << FILTER_BITS))
    place = lambda c: F.pmod(slot(c), F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bit))
    table = ids.where("id is not null").select(F.shiftright(slot("id"), 6).alias(word), place("id").alias(bit)).groupBy(word).agg(F.bit_or(one).alias(bits))
    found = rows.withColumn(word, F.shiftright(slot(key), 6)).join(F.broadcast(table), word, "left")
    hit = F.call_function("bit_get", F.col(bits), place(key)) == 1
    return found.withColumn(flag, F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull()).select(*rows.columns, flag)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, the one with the least key; of rows with equal keys the one with the least text.

    Documents without a match stay as they are, and so do rows without a key, which can't be told apart, and null
    and blank texts. Other columns stay, whatever their names; an empty table stays empty.
    """
    scratch: list[str] = []
    found = saved(jaccard_join(docs, key, text, words, percent), "components")
    gone = found.where(F.col(key) > F.col("component_id")).select(F.col(key).alias("id"))
    twice = found.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).count().where("count > 1").select("id")
    suspects = saved(gone.unionByName(twice).distinct(), "suspects", scratch)
    flag, row = fresh(docs.columns, "suspect"), fresh([*docs.columns, "suspect"], "row")
    parted = marked(docs, suspects, key, flag)
    left = parted.where(F.col(flag)).join(gone.select(F.col("id").alias(key)).distinct(), key, "left_anti")
    first = Window.partitionBy(key).orderBy(text, *[c for c in docs.columns if c not in (key, text)])
    single = left.withColumn(row, F.row_number().over(first)).where(F.col(row) == 1)
    return parted.where(~F.col(flag)).select(docs.columns).unionByName(single.select(docs.columns))


def _wanted_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, n, grams) of the documents in ``ids``. A filter goes to all tasks first, so that most other texts aren't shuffled."""
    named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("raw"))
    near = marked(named, ids, "id", "maybe").where("maybe").select("id", whole_text("raw").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, hashes, ends in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_long(hashes)))], names=["id", "grams"])

    return near.join(ids, "id", "left_semi").mapInArrow(tidy(rows), "id long, grams array<long>").withColumn("n", F.size("grams").cast("long")).where("n > 0")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id that each id of ``links`` (a, b) reaches, by alternating large and small stars.

    Hubs are never gathered: a star is a minimum for each id, saved so that Spark can split a hub's rows where they
    join it. Tables of former rounds are deleted.
    """
    spark, scratch = links.sparkSession, []
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", scratch)
    mark = None
    while True:
        old, scratch = scratch, []
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", old)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # ids that nothing smaller led to keep their edge to the least neighbour
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = saved(small, "edges", scratch)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(spark, old)
        if now == mark:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = now


def _near_pairs(met: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """(gid, id): pairs whose prefixes share enough.

    Of linked sets of sizes a and b, all but the prefix of one of them is at most max(ceil(t a), ceil(t b)) - 1
    n-grams, so the prefixes share the rest of the least overlap. n-grams with many holders aren't counted for
    each pair; a pair may share as many of them as its members hold at most.
    """
    many = stars.groupBy("id", "n").agg(F.count(F.lit(1)).alias("m"))
    counts = met.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    for side in ("a", "b"):
        counts = counts.join(many.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("m").alias(f"m{side}")), [side, f"n{side}"], "left")
    share = F.col("c") + F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0)))
    rest = F.expr(f"(greatest(na, nb) * {percent} + 99) div 100 - 1")
    least = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    return counts.where(share + rest >= least).select(F.col("a").alias("gid"), F.col("b").alias("id")).distinct()


def _across(stars: DataFrame, homes: DataFrame, percent: int) -> DataFrame:
    """(id, gid): each id with the smaller homes that hold one of its n-grams in a member of fitting size, if what both have left behind it can be enough.

    Homes of an n-gram are rows, never gathered; an n-gram's holders are dealt by a salt.
    """
    placed = stars.select("h", "id", "n", "rest").join(homes, "id")
    held = placed.groupBy("h", "home").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("most"))
    several = held.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h")
    held = held.join(several, "h", "left_semi").select("h", F.col("home").alias("gid"), "low", "high", "most", _salts().alias("salt"))
    met = placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).join(held, ["h", "salt"])
    enough = _enough(F.col("n"), F.col("rest"), F.col("low"), F.col("most"), percent)
    return met.where((F.col("gid") < F.col("home")) & (F.col("high") * 100 >= F.col("n") * percent) & (F.col("low") * percent <= F.col("n") * 100) & enough).select("id", "gid").distinct()


def candidate_links(docs: DataFrame, met: DataFrame, stars: DataFrame, key: str, text: str, words: int, percent: int, scratch: list[str]) -> DataFrame:
    """(a, b): links that hold every component together, from shared n-grams."""
    pairs = saved(_near_pairs(met, stars, percent), "pairs", scratch)
    stars = stars.where("live")
    ids = pairs.select(F.explode(F.array("gid", "id")).alias("id")).unionByName(stars.select(F.explode(F.array("id", "leader")).alias("id"))).distinct()
    sets = saved(_wanted_sets(docs, ids, key, text, words), "sets", scratch, TEXT_ROWS)
    votes = stars.groupBy("id", "leader").agg(F.count(F.lit(1)).alias("c"))
    homes = saved(votes.groupBy("id").agg(F.max(F.struct("c", (-F.col("leader")).alias("l"))).alias("best")).select("id", (-F.col("best.l")).alias("home")), "homes", scratch)
    first = pairs.unionByName(homes.where("id <> home").select(F.col("home").alias("gid"), "id")).distinct()
    alone = first.select("gid").distinct().select("gid", F.col("gid").alias("id"), F.col("gid").alias("stands"))
    one = saved(_compared(first, alone, sets, percent, scratch), "links", scratch, SET_ROWS)
    links = one.where("linked").select(F.col("id").alias("a"), F.col("other").alias("b"))
    if homes.isEmpty():
        return links
    tied = one.where("linked").select("id", F.col("other").alias("home"), F.lit(True).alias("tied")).distinct()
    members = homes.join(tied, ["id", "home"], "left").withColumn("tied", F.coalesce("tied", F.col("id") == F.col("home")))
    members = saved(members.unionByName(homes.select(F.col("home").alias("id"), "home", F.lit(True).alias("tied"))).groupBy("id", "home").agg(F.max("tied").alias("tied")), "members", scratch)
    loose = members.where("not tied").select("id", F.col("home").alias("gid"))
    right = members.select(F.col("home").alias("gid"), "id", F.when(F.col("tied"), F.col("home")).otherwise(F.col("id")).alias("stands"))
    left = saved(_across(stars, homes, percent).unionByName(loose).distinct(), "loose", scratch)
    two = saved(_compared(left, right, sets, percent, scratch), "links", scratch, SET_ROWS)
    return links.unionByName(two.where("linked").select(F.col("id").alias("a"), F.col("other").alias("b")))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, few: int = FEW, common: int = COMMON_MOST) -> DataFrame:
    """(key, n_shingles, component_id) of every row.

    Texts are lower-cased in A-Z and cut at ASCII white space; a set holds the distinct n-grams of ``words``
    words, or the whole sequence where a text has fewer. Rows link when 100 * overlap >= percent * union;
    component_id is the least key that links lead to. Null or blank texts have an empty set, link with
    nothing and keep their own key. Rows of an equal key count as versions of one document. A null key takes
    the component of its equal texts, else null. Long texts go through in windows. Other columns play no part,
    whatever their names; empty tables give no rows. ``few`` and ``common`` set how pairs are found, never which.
    """
    scratch: list[str] = []
    signed = saved(signatures(docs, key, text, words, percent, common), "signatures", None, TEXT_ROWS)
    classes = saved(signed.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("id").alias("id")), "classes")
    entries = signed.join(classes.where("id is not null"), ["id", "n", "k1", "k2"], "left_semi").select("id", "n", F.posexplode("prefix").alias("pos", "h"))
    met, stars = shared_ngrams(entries, percent, few, scratch)
    found = components(candidate_links(docs, met, stars, key, text, words, percent, scratch))
    dropped(docs.sparkSession, scratch)
    named = classes.join(found, "id", "left").select("n", "k1", "k2", F.coalesce("component", "id").alias("component"))
    return signed.select("id", "n", "k1", "k2").join(named, ["n", "k1", "k2"], "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
