"""Vector code compression: product quantisation in whole numbers, entries found through a vantage-point tree.

Each part position has its own codebook and a tree over its entries. A tree's branches are left out only where the
triangle inequality, on radii rounded away from the query, shows that no entry in them can be as near as the best so
far; what is visited is compared in whole numbers, so codes are those of a full comparison, ties to the lower entry.
Tasks sum the parts of each entry, Spark adds the sums up; only codebooks pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import saved, tidy

#: Parts of a vector, entries of a codebook, rounds of learning, and the whole numbers in 1.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a tree's leaf; values of vectors that a task compares at once.
LEAF, VALUES = 8, 1 << 20
#: A label table of at most so many rows goes to all tasks; a longer one is joined by shuffle.
SMALL = 50_000
#: By how much a float square root is moved outwards: far more than it is rounded.
SLACK = 1e-12


@dataclass
class Node:
    """A vantage point with the entries nearer than and beyond the middle distance, each with the least and greatest distance in it; or a leaf of entries."""

    entries: np.ndarray
    point: int = -1
    middle: float = 0.0
    children: tuple = ()
    reach: tuple = ()


def distances(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    away = rows - entry
    return np.einsum("...i,...i->...", away, away)


def tree(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The tree over a codebook's entries. The vantage point is the entry farthest from the first, so that distances from it differ."""
    entries = np.arange(len(book)) if entries is None else entries
    if len(entries) <= LEAF:
        return Node(entries)
    point = int(entries[distances(book[entries], book[entries[0]]).argmax()])
    rest = entries[entries != point]
    far = np.sqrt(distances(book[rest], book[point]).astype(np.float64))
    order = np.argsort(far, kind="stable")
    half = len(order) // 2
    halves = (np.sort(rest[order[:half]]), np.sort(rest[order[half:]]))
    reach = tuple((far[o].min() * (1 - SLACK), far[o].max() * (1 + SLACK)) for o in (order[:half], order[half:]))
    return Node(entries, point, float(far[order[half]]), tuple(tree(book, h) for h in halves), reach)


def nearest(rows: np.ndarray, book: np.ndarray, root: Node) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row, by branch and bound for all rows at once."""
    least = np.full(len(rows), np.iinfo(np.int64).max)
    entry = np.full(len(rows), len(book))

    def offered(at: np.ndarray, away: np.ndarray, which: np.ndarray | int) -> None:
        better = (away < least[at]) | ((away == least[at]) & (which < entry[at]))
        put = at[better]
        least[put] = away[better]
        entry[put] = which[better] if isinstance(which, np.ndarray) else which

    def visit(node: Node, at: np.ndarray) -> None:
        if not node.children:
            away = distances(rows[at][:, None, :], book[node.entries])
            first = away.argmin(1)  # entries are in order, so this is the lowest of the nearest
            offered(at, away[np.arange(len(at)), first], node.entries[first])
            return
        away = distances(rows[at], book[node.point])
        offered(at, away, node.point)
        far = np.sqrt(away.astype(np.float64))
        inner = far < node.middle
        for mine, order in ((inner, (0, 1)), (~inner, (1, 0))):
            some, d = at[mine], far[mine]
            for k in order:
                if not len(some):
                    break
                low, high = node.reach[k]
                bound = np.maximum(np.maximum(d * (1 - SLACK) - high, low - d * (1 + SLACK)), 0)
                # an equal bound is visited too: an entry as near may have a lower number
                go = bound * bound * (1 - SLACK) <= least[some].astype(np.float64) * (1 + SLACK)
                if go.any():
                    visit(node.children[k], some[go])

    if len(rows):
        visit(root, np.arange(len(rows)))
    return entry, least


def whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of PARTS x ``width`` whole numbers, floor(SCALE * x), zeros behind a shorter vector's end."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    flat = np.floor(np.asarray(column.values, np.float64)[offsets[0] : offsets[-1]] * SCALE)
    most = isqrt((2**63 - 1) // max(PARTS * width, 1)) // 2
    if len(flat) and max(-flat.min(), flat.max()) > most:
        raise ValueError(f"a component of {most // SCALE} or more has no squared distance in 64 bits")
    out = np.zeros((len(column), PARTS * width), np.int64)
    sizes = np.diff(offsets)
    out[np.arange(PARTS * width) < sizes[:, None]] = flat.astype(np.int64)
    return out


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray, place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a batch, their parts in whole numbers, codes, squared distances), VALUES at a time."""
    trees = [tree(b) for b in books]
    width = books.shape[2]
    for batch in batches:
        step = max(1, VALUES // max(PARTS * width, 1))
        for at in range(0, batch.num_rows, step):
            some = batch.slice(at, step)
            parts = whole_numbers(some.column(place), width).reshape(some.num_rows, PARTS, width)
            found = [nearest(np.ascontiguousarray(parts[:, p]), books[p], trees[p]) for p in range(PARTS)]
            yield some, parts, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def sums_of_entries(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, sums): for each entry that any part is nearest to, the number of such parts and their sum."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for _, parts, codes, _ in _coded(batches, books, 0):
            for p in range(PARTS):
                count[p] += np.bincount(codes[:, p], minlength=books.shape[1])
                np.add.at(total[p], codes[:, p], parts[:, p])
        part, entry = np.nonzero(count)
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total[part, entry].ravel()), max(books.shape[2], 1)) if books.shape[2] else pa.array([[]] * len(part), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), sums.cast(pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return vectors.mapInArrow(tidy(rows), "part int, entry int, n long, sums array<long>")


def learned(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floored means of the parts nearest to them; unused entries stay."""
    found = sums_of_entries(vectors, books).select("part", "entry", "n", F.posexplode_outer("sums").alias("at", "x"))
    new = books.copy()
    whole = F.sum(F.col("x").cast("decimal(38,0)")).alias("x")
    for r in found.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), whole).where("at is not null").toLocalIterator():  # a codebook's size, whatever the rows
        new[r["part"], r.entry, r["at"]] = int(r.x) // r.n
    return new


def first_books(vectors: DataFrame, key: str, column: str, width: int) -> np.ndarray:
    """Codebooks of the parts of the ENTRIES smallest keys, ascending; of equal keys the least vector first, null keys last."""
    first = vectors.orderBy(F.col(key).asc_nulls_last(), column).limit(ENTRIES).select(F.col(column).cast("array<double>")).collect()
    rows = whole_numbers(pa.array([r[0] for r in first], pa.list_(pa.float64())), width)
    return np.ascontiguousarray(rows.reshape(len(first), PARTS, width).transpose(1, 0, 2))


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of each vector without null or non-finite components.

    code is the number of each part's entry in two hex digits, error the squared distances summed, label_error the
    errors of the label summed, nulls together; codebooks_sha256 is of all entries' decimal components, part by part.
    Vectors that are null or not finite give no row, empty ones count as zeros, and vectors shorter than the longest,
    or than a multiple of PARTS, as zeros behind their end. Rows of equal or null keys are each coded; fewer than
    ENTRIES rows make as many entries. A component so large that its square leaves 64 bits is an error. Other columns
    play no part, whatever their names; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col(column))).select(F.col(key).alias("key"), F.col(column).alias("vector"), F.col(label).alias("label"))
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    schema = f"key {kept.schema['key'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    if longest is None:
        coded, digest = spark.createDataFrame([], schema), ""
    else:
        width = -(-longest // PARTS)
        books = first_books(kept, "key", "vector", width)
        bare = kept.select(F.col("vector").cast("array<double>").alias("vector"))
        for _ in range(rounds):
            books = learned(bare, books)
        digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some, _, codes, errors in _coded(batches, books, 2):
                digits = codes.astype(np.uint8).tobytes().hex()
                shown = [digits[i : i + 2 * PARTS] for i in range(0, len(digits), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(shown, pa.string()), pa.array(errors.sum(1))], names=["key", "label", "code", "error"])

        # written once: both the sums of labels and the rows read it
        coded = saved(kept.select("key", "label", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(tidy(rows), schema), "codes")
    each = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    near = F.broadcast(each) if each.count() <= SMALL else each
    found = coded.join(near, F.col("label").eqNullSafe(F.col("_label")))
    return found.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


_AWAY = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _oracle() -> str:
    steps = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, label, CAST(part AS INT) AS part, q[part * len(q) // 16 + 1 : (part + 1) * len(q) // 16] AS x FROM v, range(16) t(part))",
        "c0 AS MATERIALIZED (SELECT part, f.entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 64) f USING (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, any_value(label) AS label, any_value(x) AS x, arg_min(entry, row(d, entry)) AS entry, min(d) AS d FROM (SELECT p.vec_id, p.label, p.part, p.x, c.entry, {_AWAY} AS d FROM p JOIN c{k} c USING (part)) GROUP BY vec_id, part)")
        if k < ROUNDS:
            steps.append(f"m{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (SELECT part, entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{k}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY part, entry, i) GROUP BY part, entry)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.entry = c.entry)")
    steps.append(f"r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)")
    return "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256 FROM r"


#: The same by full comparison, for rows of distinct ids and vectors of one length, a multiple of PARTS.
ORACLE = _oracle()
