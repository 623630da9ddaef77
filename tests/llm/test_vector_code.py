import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import vector_code

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 64), st.integers(1, 5), st.sampled_from([2, 9, 300, 10**6]), st.integers(0, 2**32 - 1))
def test_tree_finds_what_a_full_comparison_finds(entries, width, most, seed):
    draw = np.random.default_rng(seed)
    book, rows = draw.integers(-most, most, (entries, width)), draw.integers(-most, most, (200, width))
    rows[:20] = book[draw.integers(0, entries, 20)]
    away = ((rows[:, None, :] - book[None]) ** 2).sum(2)
    entry, least = vector_code.nearest(rows, book, vector_code.tree(book))
    assert entry.tolist() == away.argmin(1).tolist() and least.tolist() == away.min(1).tolist()


def test_tree_leaves_branches_out(monkeypatch):
    draw = np.random.default_rng(1)
    book = draw.integers(-1000, 1000, (64, 2))
    met, plain = [], vector_code.distances
    monkeypatch.setattr(vector_code, "distances", lambda rows, entry: (met.append(np.broadcast(rows, entry).size // 2), plain(rows, entry))[1])
    vector_code.nearest(np.repeat(book, 50, 0), book, vector_code.tree(book))
    assert sum(met) < 3200 * 64 / 2


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [int(np.floor(256 * x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), lab) for i, v, lab in kept]
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    first = [cut(v) for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    books = [[f[p] for f in first] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def code(v):
        return [min((away(x, e), k) for k, e in enumerate(books[p]))[::-1] for p, x in enumerate(cut(v))]

    for _ in range(rounds):
        sums = {}
        for _, v, _ in kept:
            for p, ((k, _), x) in enumerate(zip(code(v), cut(v), strict=True)):
                sums.setdefault((p, k), []).append(x)
        for (p, k), xs in sums.items():
            books[p][k] = tuple(sum(x[j] for x in xs) // len(xs) for j in range(width))
    out = [(i, lab, code(v)) for i, v, lab in kept]
    errors = {}
    for _, lab, c in out:
        errors[lab] = errors.get(lab, 0) + sum(d for _, d in c)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for k, _ in c), sum(d for _, d in c), errors[lab], sha) for i, lab, c in out), key=str)


def vectors(n, dims, seed=3):
    draw = np.random.default_rng(seed)
    return [(int(i), (draw.normal(size=dims) / 4).round(2).tolist(), int(i) % 3 if i % 4 else None) for i in draw.permutation(n)]


@pytest.mark.parametrize("rows", [
    vectors(150, 32),
    vectors(20, 16),
    [*vectors(90, 32), (None, [0.25] * 32, 1), (5, [0.5] * 32, 1), (5, [0.5] * 32, 1), (6, None, 2), (7, [None, *[0.5] * 31], 2), (8, [float("nan")] * 32, 2), (9, [float("-inf")] * 32, 2)],
    [*vectors(70, 35), (100, [1.5], 0), (101, [], 0)],
    [(i, [0.5] * 16, None) for i in range(100)],
    [(1, [1000.25, -1000.75] * 8, 4)],
])
def test_equals_brute_force(spark, rows):
    frame = spark.createDataFrame([(*r, "c", "e") for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, vector_code.compress(frame).collect()), key=str) == brute(rows)


def test_equals_sql(spark):
    rows = [*vectors(200, 32), (500, None, 1), (501, [float("inf")] * 32, 1)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, vector_code.compress(frame).collect())) == sorted(con.sql(vector_code.ORACLE).fetchall())


def test_nothing_to_code(spark):
    assert vector_code.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vector_code.compress(spark.createDataFrame([(1, None, 2, "c", "e")], SCHEMA)).count() == 0
    assert [r.code for r in vector_code.compress(spark.createDataFrame([(1, [], 2, "c", "e")], SCHEMA)).collect()] == ["00" * 16]


def test_components_beyond_64_bits_are_an_error():
    with pytest.raises(ValueError, match="64 bits"):
        vector_code.whole_numbers(pa.array([[1e300] * 16]), 1)


def test_many_labels_meet_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vector_code, "SMALL", 0)
    rows = vectors(80, 16)
    assert sorted(map(tuple, vector_code.compress(spark.createDataFrame([(*r, "c", "e") for r in rows], SCHEMA)).collect()), key=str) == brute(rows)
