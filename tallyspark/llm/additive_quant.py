"""Approximate nearest neighbours by additive quantisation.

A vector is a coarse codeword, its cell, and the rest: a norm times the sum of one full-dimensional codeword of each
codebook, found by beam search over the rest divided by its norm, so that dense and sparse places are told apart
alike. Cell, codes, the rest's norm and the squared norm of the whole sum are the index. A query scores codes through
a table of its inner products with all codewords, and the best are ranked again by the original vectors, first in
their shard, so that as many can be as the codes need: which share of the rows scored is measured, on rows that the
codebooks weren't fitted on where there are any.

So that a query needn't score every code, it meets those cells whose codewords have the largest inner products with
it; how many is measured on the sample. Cells are packed into shards of bounded size. The index is dealt to its shards once, queries go to the shards of their
cells, each shard answers with its best, and only the best of all shards are joined with vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import dropped, saved, string_bytes, tidy

#: Codebooks, codewords in each, beams, and rounds of training.
BOOKS, WORDS, BEAM, ROUNDS = 24, 256, 3, 8
#: The codebooks are fitted on at most this many vectors, drawn by a hash of the id.
SAMPLE = 16_384
#: Candidates of each query that are ranked again.
RERANK = 64
#: Cells for each root of the number of vectors, and most cells.
CELLS, MOST_CELLS = 2, 4096
#: Share of the sample's true neighbours that a query's cells must hold, and sampled queries that it is measured with.
COVER, TRIALS = 0.99, 512
#: Further rows drawn, on which the share of rows that are ranked again is measured.
MEASURED = 8192
#: Index rows of a shard, and queries that a task takes to it.
INDEX_BLOCK, QUERY_BLOCK = 1 << 14, 1 << 12
#: Queries scored together, and vectors encoded at once.
TABLES, PASS = 64, 4096
#: Rows of one vector are dealt to so many tasks by a salt where they join it.
SALTS = 16


@dataclass(frozen=True)
class Codebooks:
    """words: books x codewords x dimensions, float32."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared norms of the sums) of the rows of ``x``: at each codebook the ``beam`` best partial sums go on."""
        books, k, d = self.words.shape
        codes, norms = np.zeros((len(x), books), np.uint8), np.zeros(len(x), np.float32)
        square = (self.words.astype(np.float64) ** 2).sum(2).astype(np.float32)
        for s in range(0, len(x), PASS):
            rest = x[s : s + PASS].astype(np.float32)[:, None, :]
            kept = np.zeros((len(rest), 1, 0), np.uint8)
            for m in range(books):
                n, width = rest.shape[:2]
                gain = (rest.reshape(-1, d) @ self.words[m].T).reshape(n, width, k)
                cost = ((rest**2).sum(2)[:, :, None] + square[m] - 2 * gain).reshape(n, width * k)
                best = min(beam if m + 1 < books else 1, width * k)
                pick = np.argpartition(cost, best - 1, axis=1)[:, :best]
                at, word = pick // k, pick % k
                rest = np.take_along_axis(rest, at[:, :, None], 1) - self.words[m][word]
                kept = np.concatenate([np.take_along_axis(kept, at[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
            codes[s : s + PASS] = kept[:, 0]
            norms[s : s + PASS] = ((x[s : s + PASS] - rest[:, 0]) ** 2).sum(1)
        return codes, norms

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The sums that codes stand for."""
        out = np.zeros((len(codes), self.words.shape[2]), np.float32)
        for m, words in enumerate(self.words):
            out += words[codes[:, m]]
        return out


def train(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS) -> Codebooks:
    """Residual codebooks by k-means from a seeded start; at most as many codewords as vectors."""
    draw = np.random.default_rng(7)
    rest = sample.astype(np.float32).copy()
    k = max(1, min(words, len(rest)))
    out = np.zeros((books, k, rest.shape[1]), np.float32)
    for m in range(books):
        centre = rest[draw.permutation(len(rest))[:k]].copy() if len(rest) else out[m]
        for _ in range(rounds if len(rest) else 0):
            near = np.argmin((centre**2).sum(1) - 2 * rest @ centre.T, 1)
            count = np.bincount(near, minlength=k)
            order = np.argsort(near, kind="stable")
            some = np.flatnonzero(count)
            centre[some] = np.add.reduceat(rest[order], np.append(0, np.cumsum(count[some]))[:-1]) / count[some, None]
            lone = np.flatnonzero(count == 0)
            if len(lone):
                centre[lone] = rest[draw.integers(0, len(rest), len(lone))]
        out[m] = centre
        if len(rest):
            rest -= centre[np.argmin((centre**2).sum(1) - 2 * rest @ centre.T, 1)]
    return Codebooks(out)


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of rows with a key whose vector has only finite components, not all zero; components keep their type."""
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))


@dataclass(frozen=True)
class Space:
    """Dimensions that shorter vectors are filled up to with zeros, and the largest component's size, which all are divided by."""

    size: int
    scale: float

    def matrix(self, column: pa.Array) -> np.ndarray:
        values, bounds = np.asarray(column.flatten(), np.float64) / self.scale, np.asarray(column.offsets) - column.offsets[0].as_py()
        widths = np.diff(bounds)
        if (widths == self.size).all():
            return values.reshape(-1, self.size).astype(np.float32)
        out = np.zeros((len(column), self.size), np.float32)
        out[np.repeat(np.arange(len(column)), widths), np.arange(len(values)) - np.repeat(bounds[:-1], widths)] = values
        return out


@dataclass(frozen=True)
class Cells:
    """centres: cells x dimensions; a query meets ``probes`` of them, and the best ``share`` of their rows by code are ranked again."""

    centres: np.ndarray
    probes: int
    share: float = 0.0

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.centres**2).sum(1) - 2 * x @ self.centres.T, 1)

    def rest(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what the cells leave of the vectors, of length 1 or 0; its length)."""
        left = x - self.centres[cell]
        norm = np.sqrt((left**2).sum(1))
        return left / np.where(norm > 0, norm, 1)[:, None], norm

    def met(self, q: np.ndarray) -> np.ndarray:
        """Cells of each query, those with the largest inner products."""
        n = min(self.probes, len(self.centres))
        return np.argpartition(-(q @ self.centres.T), n - 1, axis=1)[:, :n]


def train_cells(sample: np.ndarray, cells: int, top: int, cover: float = COVER) -> Cells:
    """Cells by k-means, and as many probes as hold ``cover`` of the sampled queries' ``top`` true neighbours in the sample."""
    centres = train(sample, books=1, words=cells).words[0]
    order = np.argsort((centres - centres.mean(0)) @ np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0], kind="stable")
    centres = centres[order]  # neighbouring cells share a shard
    asked = np.random.default_rng(11).permutation(len(sample))[:TRIALS]
    product = sample[asked] @ sample.T
    product[np.arange(len(asked)), asked] = -np.inf
    n = min(top, len(sample) - 1)
    if n < 1:
        return Cells(centres, len(centres))
    found = np.argpartition(-product, n - 1, axis=1)[:, :n]
    place = np.argsort(np.argsort(-(sample[asked] @ centres.T), 1, kind="stable"), 1, kind="stable")
    ranks = np.sort(np.take_along_axis(place, Cells(centres, 1).nearest(sample)[found], 1).ravel())
    return Cells(centres, int(ranks[min(len(ranks) - 1, int(np.ceil(cover * len(ranks))) - 1)]) + 1)


def share_needed(rows: np.ndarray, books: Codebooks, cells: Cells, top: int, cover: float = COVER) -> float:
    """The share of ``rows`` that must be taken, best codes first, to hold ``cover`` of sampled queries' ``top`` true neighbours among them."""
    asked = np.random.default_rng(13).permutation(len(rows))[:TRIALS]
    n = min(top, len(rows) - 1)
    if n < 1:
        return 1.0
    cell = cells.nearest(rows)
    rest, gain = cells.rest(rows, cell)
    coded = cells.centres[cell] + gain[:, None] * books.decode(books.encode(rest)[0])
    ranks = []
    for i in asked:
        true, near = rows @ rows[i], coded @ rows[i]
        true[i] = near[i] = -np.inf
        best = np.argpartition(-true, n - 1)[:n]
        ranks.append(len(near) - np.searchsorted(np.sort(near), near[best]))
    ranks = np.sort(np.concatenate(ranks))
    return float(ranks[min(len(ranks) - 1, int(np.ceil(cover * len(ranks))) - 1)]) / len(rows)


def build_index(distinct: DataFrame, rows: int, space: Space, top: int, scratch: list[str], sample: int = SAMPLE) -> tuple[Codebooks, Cells, DataFrame]:
    """Codebooks and cells fitted on at most ``sample`` drawn vectors, and (gid, cell, codes, gain, norm, v) of every (gid, v)."""
    some = distinct.orderBy(F.xxhash64("gid", F.lit("codebooks")), "gid").limit(sample + MEASURED).select("v").toArrow()
    measured = space.matrix(some.column("v").combine_chunks())
    drawn, measured = measured[:sample], measured[-MEASURED:]
    cells = train_cells(drawn, max(1, min(MOST_CELLS, int(CELLS * rows**0.5))), top)
    books = train(cells.rest(drawn, cells.nearest(drawn))[0])
    cells = replace(cells, share=share_needed(measured, books, cells, top))
    shared = distinct.sparkSession.sparkContext.broadcast((books, cells))  # BOOKS * WORDS codewords and MOST_CELLS centres at most

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, coarse = shared.value
        for batch in batches:
            x = space.matrix(batch.column("v"))
            cell = coarse.nearest(x)
            rest, gain = coarse.rest(x, cell)
            codes, _ = words.encode(rest)
            whole = coarse.centres[cell] + gain[:, None] * words.decode(codes)
            yield pa.RecordBatch.from_arrays([batch.column("gid"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(gain, pa.float32()), pa.array((whole**2).sum(1), pa.float32()), batch.column("v")], names=["gid", "cell", "codes", "gain", "norm", "v"])

    kind = distinct.schema["v"].dataType.simpleString()
    return books, cells, saved(distinct.select("gid", "v").mapInArrow(tidy(coded), f"gid long, cell int, codes binary, gain float, norm float, v {kind}"), "codes", scratch)


def shards(index: DataFrame, cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, number of shards) of each cell: cells in a row share a shard of at most INDEX_BLOCK rows, a larger one has several of its own."""
    count = np.zeros(len(cells.centres), np.int64)
    for r in index.groupBy("cell").count().collect():  # MOST_CELLS rows at most
        count[r.cell] = r["count"]
    first, many = np.zeros(len(count), np.int64), np.maximum(-(-count // INDEX_BLOCK), 1)
    shard = held = 0
    for c, n in enumerate(count.tolist()):
        if held and held + n > INDEX_BLOCK:
            shard, held = shard + 1, 0
        first[c] = shard
        held += n
        if many[c] > 1:
            shard, held = shard + int(many[c]), 0
    return first, many


def shortlists(index: DataFrame, books: Codebooks, cells: Cells, queries: DataFrame, space: Space, keep: int, scratch: list[str], metric: str = "ip") -> DataFrame:
    """(query, gid): the ``keep`` best of each (gid, v) of ``queries`` over the cells that it meets, and all that tie with the last of them.

    In each shard the best by the query's table, ``cells.share`` of the rows and ``keep`` at least, are ranked again by their vectors. A query's own vector is among them where it scores so.
    """
    spark = index.sparkSession
    first, many = shards(index, cells)
    shared = spark.sparkContext.broadcast((books, cells, first, many))
    plan = spark.createDataFrame([(c, int(f), int(m)) for c, (f, m) in enumerate(zip(first, many, strict=True))], "cell int, first long, many long")

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, coarse, starts, numbers = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            met = coarse.met(space.matrix(batch.column("v")))
            each = numbers[met].ravel()
            place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)  # of a shard among its cell's
            asking = np.repeat(np.repeat(np.arange(len(met)), met.shape[1]), each)
            shard, cell = np.repeat(starts[met].ravel(), each) + place, np.repeat(met.ravel(), each)
            order = np.lexsort((cell, shard, asking))
            asking, shard, cell = asking[order], shard[order], cell[order]
            first = np.flatnonzero(np.append(True, (asking[1:] != asking[:-1]) | (shard[1:] != shard[:-1])))
            rows = pa.array(asking[first])
            mine = pa.ListArray.from_arrays(pa.array(np.append(first, len(cell)), pa.int32()), pa.array(cell, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(shard[first], pa.int64()), batch.column("gid").take(rows), batch.column("v").take(rows), mine], names=["shard", "gid", "v", "cells"])

    kind = queries.schema["v"].dataType.simpleString()
    asked = saved(queries.select("gid", "v").mapInArrow(tidy(sent), f"shard long, gid long, v {kind}, cells array<int>"), "asked", scratch)
    chunks = saved(asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("long").alias("chunks")), "chunks", scratch)
    ours = index.join(F.broadcast(plan), "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("gid"), F.col("many"))).join(chunks, "shard")
    ours = ours.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "gid", "cell", "codes", "gain", "norm", "v", F.lit(None).cast("array<int>").alias("cells"))
    theirs = asked.join(chunks, "shard").select("shard", F.pmod(F.xxhash64("gid"), F.col("chunks")).alias("chunk"), F.lit(1).alias("side"), "gid", F.lit(None).cast("int").alias("cell"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("gain"), F.lit(None).cast("float").alias("norm"), "v", "cells")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value[0].words
        m, k, d = words.shape
        flat = words.reshape(-1, d)
        task, held, ready = None, [], None

        def answered(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, codes, gains, norms, vectors, starts = ready
            asks, found, scores = batch.column("gid").to_pylist(), [], []
            q = space.matrix(batch.column("v"))
            for one, table, bases, mine in zip(q, q @ flat.T, q @ shared.value[1].centres.T, batch.column("cells").to_pylist(), strict=True):
                rows = np.concatenate([np.arange(starts[c], starts[c + 1]) for c in mine])
                some = codes[rows]
                score = table[some[:, 0]]
                for j in range(1, m):
                    score += table[some[:, j]]
                score = gains[rows] * score + np.repeat(bases[mine], [starts[c + 1] - starts[c] for c in mine])
                if metric == "l2":
                    score = 2 * score - norms[rows]
                n = min(max(keep, int(np.ceil(shared.value[1].share * len(rows)))), len(rows))
                rows = rows[np.flatnonzero(score >= np.partition(score, len(rows) - n)[len(rows) - n])] if n else rows
                own = vectors[rows]
                score = own @ one
                if metric == "l2":
                    score = 2 * score - (own**2).sum(1)
                n = min(keep, len(rows))
                best = np.flatnonzero(score >= np.partition(score, len(rows) - n)[len(rows) - n]) if n else np.zeros(0, np.int64)
                found.append(ids[rows[best]])
                scores.append(score[best])
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(asks, np.int64), [len(f) for f in found])), pa.array(np.concatenate(found), pa.int64()), pa.array(np.concatenate(scores), pa.float32())], names=["query", "gid", "near"])

        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "chunk", "side")), strict=True))
            at = 0
            while at < len(names):
                end = at
                while end < len(names) and names[end] == names[at]:
                    end += 1
                some, (shard, chunk, side) = batch.slice(at, end - at), names[at]
                at = end
                if (shard, chunk) != task:
                    task, held, ready = (shard, chunk), [], None
                if side == 0:
                    data, bounds = string_bytes(some.column("codes"))
                    held.append((np.asarray(some.column("gid")), np.asarray(some.column("cell")), data[bounds[0] : bounds[-1]].reshape(-1, m).copy(), np.asarray(some.column("gain")), np.asarray(some.column("norm")), space.matrix(some.column("v"))))
                    continue
                if ready is None:
                    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, m), np.uint8), np.zeros(0, np.float32), np.zeros(0, np.float32), np.zeros((0, d), np.float32)
                    ids, cell, codes, gains, norms, vectors = (np.concatenate([h[i] for h in held]) for i in range(6)) if held else none
                    order = np.argsort(cell, kind="stable")
                    ready = ids[order], codes[order].astype(np.int32) + np.arange(m, dtype=np.int32) * k, gains[order], norms[order], vectors[order], np.searchsorted(cell[order], np.arange(len(shared.value[1].centres) + 1))
                for s in range(0, some.num_rows, TABLES):
                    yield answered(some.slice(s, TABLES))

    met = ours.unionByName(theirs).repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", "side").mapInArrow(tidy(scored), "query long, gid long, near float")
    best = Window.partitionBy("query").orderBy(F.desc("near"))
    return met.withColumn("place", F.rank().over(best)).where(F.col("place") <= keep).select("query", "gid")


def search(table: DataFrame, asks, key: str = "vec_id", vector: str = "embedding", top: int = 20, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each usable row where ``asks(id)`` holds, its ``top`` nearest other rows found.

    Nearness is the inner product of the original vectors in double precision, summed in component order; vectors of
    fewer dimensions count as having zeros there. Ties go to the smaller id. Rows that repeat an id are rows of their
    own, which ask and answer each for itself. Rows without a key or a usable vector neither ask nor answer; with
    fewer candidates than ``top`` all that are found come back. Other columns play no part, whatever their names; an
    empty table gives no rows.
    """
    scratch: list[str] = []
    # numbers that tell rows apart, fixed by the table that holds them
    vectors = saved(usable(table, key, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    size, scale = vectors.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    if size is None:
        return vectors.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    space = Space(size, float(scale))
    # each distinct vector is indexed once; its rows of the smallest ids answer for it, one more than asked for, as a query's own row doesn't answer
    alike = Window.partitionBy("v").orderBy("id", "row")
    members = saved(vectors.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= top + 1), "members", scratch)
    first = members.where("n = 1").select("v", F.col("row").alias("gid"), F.col("id").alias("low"))
    distinct = saved(first, "distinct", scratch)
    members = members.join(distinct.select("v", "gid"), "v").select("gid", "row", "id")
    rows = vectors.where(asks(F.col("id")))
    queries = saved(distinct.join(rows.select("v").distinct(), "v", "left_semi"), "queries", scratch)
    books, cells, index = build_index(distinct, distinct.count(), space, top, scratch)
    pairs = shortlists(index, books, cells, queries, space, max(rerank, top) + 1, scratch)
    near = pairs.join(distinct.select("gid", "low", "v"), "gid").join(queries.select(F.col("gid").alias("query"), F.col("v").alias("w")), "query")
    product = F.zip_with("v", "w", lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    exact = F.aggregate(product, F.lit(0.0), lambda a, b: a + b)
    closest = near.select("query", "gid", "low", exact.alias("score")).withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "low"))).where(F.col("n") <= top + 1)
    answers = closest.select("query", "gid", "score").join(members, "gid").withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "row"))).where(F.col("n") <= top + 1)
    answers = saved(answers.select("query", "score", "id", "row"), "answers")
    # the rows that ask, each with its vector's answers: rows of one vector are dealt by a salt
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    named = rows.withColumn("salt", F.pmod("row", F.lit(SALTS))).join(queries.select("v", F.col("gid").alias("query"), salts.alias("salt")), ["v", "salt"])
    named = saved(named.select("query", F.pmod("row", F.lit(SALTS)).alias("salt"), F.col("id").alias("query_id"), F.col("row").alias("asking")), "asking")
    dropped(table.sparkSession, scratch)
    found = named.join(answers.select("query", "score", "id", "row", salts.alias("salt")), ["query", "salt"]).where("row <> asking")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("asking").orderBy(F.desc("score"), "id", "row"))).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
