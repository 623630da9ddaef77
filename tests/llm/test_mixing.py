import duckdb
import pytest

from tallyspark.llm import mixing

from .conftest import ROWS


def test_edge_cases_equal_sql(spark, odd, none):
    got = sorted((r.doc_id if r.doc_id is not None else -99, r.size, r.source_size, r.target, r.taken) for r in mixing.taken_words(odd).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, s) for i, t, _, s in ROWS])
    want = sorted((r[0] if r[0] is not None else -99, *r[1:]) for r in con.sql(mixing.ORACLE).fetchall())
    assert got == want
    assert mixing.taken_words(none).count() == 0


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 0)], "source string, size long")
    got = {r.source: (r.target, r.quota) for r in mixing.targets(sizes).collect()}
    # 3015 words by 5, 2, 1, 5: a and d stop at twice their size, and the rest goes 2 to 1 until b stops as well
    assert got["a"] == (20.0, 20) and got["d"][0] == 0.0
    assert got["b"][0] == pytest.approx(2995 * 2 / 3) and got["c"][0] == pytest.approx(3015 - 20 - got["b"][0])


def test_schedule_is_even_and_reruns_agree(spark):
    sources = spark.createDataFrame([("a", 1, 5000), ("b", 2, 2500), ("c", 3, 3)], "source string, ord int, quota long")
    slots = sorted((r.slot, r.ord, r.rank, r.slots) for r in mixing.schedule(sources, 10).collect())
    assert slots == sorted((r.slot, r.ord, r.rank, r.slots) for r in mixing.schedule(sources, 10).collect())
    for source in (1, 2, 3):
        assert [r[2] for r in slots if r[1] == source] == list(range(sum(r[1] == source for r in slots)))
    for upto in (50, 200, 700):
        assert abs(sum(r[1] == 1 for r in slots[:upto]) - upto * 2 / 3) < 8


def test_blocks_hold_equal_words_and_all_of_the_quota(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "repeat('w ', cast(id % 17 as int)) as text", "concat('s', id % 3) as source")
    sizes = mixing.word_sizes(docs, "doc_id", "source", "text")
    sources = mixing.targets(sizes).cache()
    pieces = mixing.mix(sizes, sources, 20)
    words = {}
    for r in pieces.groupBy("ord", "rank").sum("words").collect():
        words.setdefault(r.ord, []).append(r["sum(words)"])
    quota = {r.ord: r.quota for r in sources.collect()}
    assert {k: sum(v) for k, v in words.items()} == quota
    assert all(max(v) - min(v) <= 1 for v in words.values())
    took = {r.doc_id: (r.size, r.taken) for r in mixing.taken_words(docs, slot_words=20).collect()}
    assert all(t <= 2 * s for s, t in took.values()) and sum(t for _, t in took.values()) == sum(quota.values())
