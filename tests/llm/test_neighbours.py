import numpy as np

from tallyspark.llm import additive_quant as A

FOLDER = "/root/testdata/sf0.01"


def test_recall_against_brute_force(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in table.collect()}
    got = {}
    for r in A.search(table, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i in rows if i % 20 == 0}
    hits = []
    for q, found in got.items():
        want = sorted(((-float(rows[q] @ rows[i]), i) for i in rows if i != q))[:20]
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(s - float(rows[q] @ rows[i])) < 1e-9 for i, s in found)
        hits.append(len({i for i, _ in found} & {i for _, i in want}) / 20)
    assert np.mean(hits) >= 0.9


def test_unusable_vectors_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (1, [1.0, 1.0]), (2, [1.0, -1.0]), (3, [None, 1.0]), (4, [1.0, 2.0, 3.0]), (2, [1.0, -1.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, v string, id int")
    got = [tuple(r) for r in A.search(table, lambda i: i % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 2, 1.0), (0, 4, 4, 1.0)]
    assert A.search(table.limit(0), lambda i: i % 20 == 0).count() == 0


def test_beam_search_is_no_worse_than_greedy():
    x = np.random.default_rng(2).normal(size=(300, 16)).astype(np.float32)
    books = A.train(x, books=6, words=16)

    def loss(beam):
        codes, norms = books.encode(x, beam)
        sums = sum(books.words[m][codes[:, m]] for m in range(6))
        assert np.allclose(norms, (sums**2).sum(1), atol=1e-3)
        return ((x - sums) ** 2).sum()

    assert loss(8) <= loss(1) * 1.001


def test_copies_answer_by_their_smallest_ids(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(900, 8)).astype(np.float32)
    x[100:800] = x[100]  # 700 copies, more than are ranked again
    ids = [int(i) for i in draw.permutation(900)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    one = ids[100]
    copies = sorted(i for i, v in zip(ids, x, strict=True) if (v == x[100]).all() and i != one)
    best = {i: float(v.astype(np.float64) @ x[100].astype(np.float64)) for i, v in zip(ids, x, strict=True)}
    want = [i for _, i in sorted((-s, i) for i, s in best.items() if i != one)][:20]
    got = [r.vec_id for r in A.search(table, lambda i: i == one).orderBy("rank").collect()]
    assert got == want and set(copies[:5]) & set(got)


def by_hand(rows, asks, top=20):
    """(query_id, rank, vec_id, score) by comparing all pairs of (id, vector)."""
    out = []
    for i, (a, x) in enumerate(rows):
        if asks(a):
            order = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), b) for j, (b, y) in enumerate(rows) if j != i)
            out += [(a, k, b, -s) for k, (s, b) in enumerate(order[:top], 1)]
    return sorted(out)


def test_repeated_ids_other_dimensions_and_doubles_by_brute_force(spark):
    draw = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in draw.integers(-4, 5, int(draw.integers(1, 5)))]) for i in draw.integers(0, 40, 90)]
    rows = [(i, v) for i, v in rows if any(v)] + [(0, [1e300, 1.0]), (1, [1e-300, 0.1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, A.search(table, lambda i: i % 5 == 0, rerank=100).collect()))
    assert got == by_hand(rows, lambda i: i % 5 == 0)


def test_recall_where_few_candidates_are_ranked_again(spark):
    draw = np.random.default_rng(4)
    centre = draw.normal(size=(40, 32))
    x = (centre[draw.integers(0, 40, 20_000)] + draw.normal(size=(20_000, 32)) * 0.7).astype(np.float32)
    x[:6000] = x[0] + draw.normal(size=(6000, 32)) * 1e-3  # nearly one vector
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in A.search(table, lambda i: i % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert A.RERANK < 0.005 * len(x) and set(got) == set(range(0, 20_000, 100)) and {len(v) for v in got.values()} == {20}
    exact, hits = x.astype(np.float64), []
    for q, found in got.items():
        product = exact @ exact[q]
        product[q] = -np.inf
        least = np.sort(product)[-20]
        hits.append(np.mean([product[i] >= least - 1e-9 for i, _ in found]))
        assert all(abs(product[i] - s) < 1e-9 for i, s in found)
    assert np.mean(hits) >= 0.9


def test_probes_follow_the_data():
    draw = np.random.default_rng(1)
    centre = draw.normal(size=(30, 16)) * 5
    apart = (centre[draw.integers(0, 30, 3000)] + draw.normal(size=(3000, 16)) * 0.1).astype(np.float32)
    mixed = draw.normal(size=(3000, 16)).astype(np.float32)
    near, far = A.train_cells(apart, 60, 20), A.train_cells(mixed, 60, 20)
    assert near.probes < far.probes <= 60 and near.probes < 20


def test_shards_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(A, "INDEX_BLOCK", 10)
    index = spark.createDataFrame([(c,) for c, n in enumerate([4, 5, 3, 25, 0, 10, 1]) for _ in range(n)], "cell int")
    first, many = A.shards(index, A.Cells(np.zeros((7, 2)), 1))
    assert many.tolist() == [1, 1, 1, 3, 1, 1, 1] and first.tolist() == [0, 0, 1, 2, 5, 5, 6]


def test_recall_on_vectors_without_structure(spark):
    draw = np.random.default_rng(21)
    for d, some in ((64, lambda x: x), (256, lambda x: x), (32, lambda x: x * np.where(draw.random((len(x), 1)) < 0.003, 50, 1))):
        x = some(draw.normal(size=(4000, d))).astype(np.float32)
        table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
        got = {}
        for r in A.search(table, lambda i: i % 20 == 0).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        x = x.astype(np.float64)
        hits = [len(got[q] & {int(i) for i in np.argsort(-np.where(np.arange(len(x)) == q, -np.inf, x @ x[q]), kind="stable")[:20]}) for q in range(0, len(x), 20)]
        assert sum(hits) >= 0.95 * 20 * len(hits), d
