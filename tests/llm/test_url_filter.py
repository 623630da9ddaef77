import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import url_filter

URLS = [
    "http://example.org/es/1", "https://a.EXAMPLE.org/en/123?x=1", "https://notexample.org/es/1", "http://org/", "http://x.org", "http://x.org?q=/es/", "http://b.com/fr/2#top", "http://com/de/",
    "no scheme", "", None, "://", "http://:80/x", "HTTP://Spam-Farm.example.net/en/5?utm_source=a&b=2&a=1#f", "http://spam-farm.example.net/en/5/?a=1&b=2", "http://spam-farm.example.org/es/9", "http://m.free-bets.example.com/fr/1",
    "http://clean.example.net/en/5", "http://a..org/x", "http://x.example.org:80/es/", "ftp://u@example.org/en/1é", "http://y.net/" + "p" * 300_000, "http://" + "a." * 3000 + "org/q", "x://y://example.org/es/",
]


def judged(spark, urls, **how):
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, rule string, block int")
    return url_filter.judge(pages, spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string"), url_filter.site_urls(pages), **how)


def rows(frame):
    return sorted(map(tuple, frame.select("page_id", "host", "path", "rule", "verdict", "listed").collect()), key=str)


def by_sql(urls):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    return sorted(con.sql(f"SELECT page_id, host, path, rule, verdict, listed FROM ({url_filter.ORACLE})").fetchall(), key=str)


@pytest.mark.parametrize("blocks", [1, url_filter.MOST_BLOCKS])
def test_equals_sql_whatever_the_filter_lets_through(spark, monkeypatch, blocks):
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", blocks)
    got = rows(judged(spark, URLS))
    assert got == by_sql(URLS)
    assert {r[0]: r[3] for r in got}[1] == "example.org/en/1" and {r[0]: r[3:5] for r in got}[2] == ("org/", "allow")


def test_canonical_form(spark):
    forms = spark.createDataFrame([(u,) for u in URLS[13:15]], "url string").select(url_filter.host_and_path(F.col("url"))[2].alias("c"))
    assert {r.c for r in forms.collect()} == {"spam-farm.example.net/en/5?a=1&b=2"}


def test_hot_keys_repeated_rows_and_null_keys(spark):
    urls = ["http://a.org/x"] * 400 + [f"http://b{i}.com/{'de' if i % 2 else 'fr'}/" for i in range(50)] + ["http://casino-win.example.net/1"] * 3
    assert rows(judged(spark, urls)) == by_sql(urls)
    pages = spark.createDataFrame([(None, "http://a.org/x"), (None, "http://a.org/x"), (None, "http://z.com/de/"), (7, None)], "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string"), url_filter.site_urls(pages))
    assert sorted((r.rule or "", r.verdict) for r in got.collect()) == [("", "allow"), ("com/de/", "block"), ("org/", "allow"), ("org/", "allow")]


def test_longest_rule_and_block_of_equal_ones(spark):
    rules = [("allow", "a.net", "/"), ("block", "a.net", "/"), ("allow", "net", "/x/yz"), ("block", "b.net", "/x/"), ("allow", "net", "/x/q1"), ("block", None, "/"), ("allow", "c.net", None), ("maybe", "d.net", "/")]
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.net/x/yz"), (3, "http://b.net/x/q1"), (4, "http://c.net/"), (5, "http://d.net/")], "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), spark.createDataFrame([], "url string"))
    # of rules as long as each other, the longer host wins
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == {1: ("a.net/", "block"), 2: ("b.net/x/", "block"), 3: ("b.net/x/", "block"), 4: (None, "allow"), 5: (None, "allow")}


def test_empty_tables(spark):
    none, pages = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules, urls = spark.createDataFrame([], "verdict string, host string, path string"), spark.createDataFrame([], "url string")
    assert url_filter.judge(none, rules, urls).count() == 0
    assert [tuple(r) for r in url_filter.judge(pages, rules, urls).collect()] == [(1, "a.org", "/", None, "allow", False)]


def test_filter_keeps_all_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("substr(key, -1) = '7'")
    filter_, blocks = url_filter.bloom(listed, listed.count())
    passed = url_filter.possible(keys, filter_, blocks)
    assert passed.join(listed, "key", "left_semi").count() == 2000
    assert passed.count() < 2000 + 18_000 * 0.01
