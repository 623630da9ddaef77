"""URL filters: rules of hosts and paths, and a list of canonical URLs, behind a blocked Bloom filter.

Rules and listed URLs are one table of keys. A page asks for few keys: its canonical URL, and what its host ends
with and its path starts with, at the lengths that rules have. The filter, of bounded size and the same for all tasks,
lets possible hits through; an exact hash join with the table takes false positives out. Everything is in DataFrame
operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import saved

#: Bits of the filter for each key; bits of a block, four words of 64; blocks at most (8 MB of bits): with more keys the filter passes more, the join still decides.
KEY_BITS, BLOCK_BITS, MOST_BLOCKS = 16, 256, 1 << 18
#: A key that a greater share of all possible hits asks for is joined apart, so there are at most so many such keys.
HOT_KEYS = 256
#: Query parameters that don't change what a URL names.
TRACKING = r"^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, canonical URL) of a URL; without a scheme's :// or for null: empty, empty, null.

    The host is what follows the first ://, A-Z in lower case; the path goes on to the query or fragment. The
    canonical URL has no scheme, fragment, slash at the path's end or tracking parameters, and its parameters in order.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"\A[^?#]*", 0)
    host = F.translate(raw, _UPPER, _LOWER)
    query = F.regexp_extract(F.substr(rest, F.length(raw) + F.length(path) + 1), r"\A\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    canonical = F.concat(host, F.regexp_replace(path, r"/\z", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit("")), canonical


def _rule_key(host_chars: Column, host: Column, path: Column) -> Column:
    return F.concat(F.lit("rule "), host_chars.cast("string"), F.lit(" "), host, path)


def listing(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(key, rule, host_chars, path_chars, verdict), a row for each key: ``rules`` (verdict, host, path) and listed ``urls`` (url), which are blocked.

    Rules without a host or path, verdicts other than allow and block, and URLs without :// are left out. The same
    rule twice counts once, block before allow; so does a URL. Empty tables list nothing.
    """
    host = F.translate("host", _UPPER, _LOWER)
    fine = rules.where("host <> '' and path is not null and verdict in ('allow', 'block')")
    some = fine.select(_rule_key(F.length("host"), host, F.col("path")).alias("key"), F.concat(host, "path").alias("rule"), F.length("host").alias("host_chars"), F.length("path").alias("path_chars"), "verdict")
    named = urls.select(host_and_path(F.col("url"))[2].alias("url")).where("url is not null").distinct()
    none = F.lit(None).cast("int")
    named = named.select(F.concat(F.lit("url "), "url").alias("key"), F.lit(None).cast("string").alias("rule"), none.alias("host_chars"), none.alias("path_chars"), F.lit("block").alias("verdict"))
    return some.groupBy("key", "rule", "host_chars", "path_chars").agg(F.max("verdict").alias("verdict")).unionByName(named)


def asked_keys(host: Column, path: Column, canonical: Column, lengths: list[tuple[int, int]]) -> Column:
    """Array of the keys that a URL can have in a listing whose rules have ``lengths``, the pairs of characters of host and path."""
    url = F.array(F.concat(F.lit("url "), canonical))
    if not lengths:
        return F.array_compact(url)
    all_ = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p in lengths])
    whole = lambda x: (F.length(host) == x["h"]) | ((F.length(host) > x["h"]) & (F.substr(host, F.length(host) - x["h"], F.lit(1)) == "."))
    fit = F.filter(all_, lambda x: whole(x) & (F.length(path) >= x["p"]))
    return F.concat(F.array_compact(url), F.transform(fit, lambda x: _rule_key(x["h"], F.right(host, x["h"]), F.left(path, x["p"]))))


def _bits(key: str, blocks: int) -> list[Column]:
    """A key's block and the two bits that it sets in each of the block's four words."""
    mark = F.xxhash64(F.lit(11), key)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(mark, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *[bit(2 * i).bitwiseOR(bit(2 * i + 1)).alias(f"w{i}") for i in range(4)]]


def bloom(listed: DataFrame, keys: int) -> tuple[DataFrame, int]:
    """(filter, number of its blocks): (block, f0 to f3), a row for each block that any of ``keys`` keys is in, MOST_BLOCKS at most."""
    blocks = 1
    while blocks < MOST_BLOCKS and blocks * BLOCK_BITS < keys * KEY_BITS:
        blocks *= 2
    return listed.select(*_bits("key", blocks)).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"f{i}") for i in range(4)]), blocks


def possible(asked: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``asked`` whose ``key`` can be in the filter: all that are, and few others."""
    met = asked.select("*", *_bits("key", blocks)).join(F.broadcast(filter_), "block")  # MOST_BLOCKS rows at most
    every = F.lit(True)
    for i in range(4):
        every = every & (F.col(f"f{i}").bitwiseAND(F.col(f"w{i}")) == F.col(f"w{i}"))
    return met.where(every).select(*asked.columns)


def exact(hits: DataFrame, listed: DataFrame) -> DataFrame:
    """Hits whose key is listed. Keys that many rows ask for, HOT_KEYS at most, go to all tasks; the others meet by shuffle."""
    counts = hits.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    all_ = hits.count()
    hot = counts.where(F.col("n") * HOT_KEYS > all_).select("key")
    often = hits.join(F.broadcast(listed.join(F.broadcast(hot), "key", "left_semi")), "key")
    return often.unionByName(hits.join(F.broadcast(hot), "key", "left_anti").join(listed, "key"))


def judge(pages: DataFrame, rules: DataFrame, urls: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, listed) of every row.

    A rule fits its host and the hosts under it where the path starts with the rule's; the longest wins, of equal
    ones that of the longer host. Where none fits, a URL is blocked if its canonical form is listed, else allowed. A null
    url or one without :// has an empty host and path and is allowed. Rows of equal or null keys are each judged by
    their own url, repeated rows alike; urls of any length are taken whole. Other columns play no part, whatever
    their names; an empty table gives no rows.
    """
    listed = saved(listing(rules, urls), "listing")
    lengths = [tuple(r) for r in listed.where("rule is not null").select("host_chars", "path_chars").distinct().collect()]  # pairs of lengths
    filter_, blocks = bloom(listed, listed.count())
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"))
    asked = rows.where("u is not null").select("k", "u", F.explode(asked_keys(*host_and_path(F.col("u")), sorted(lengths))).alias("key"))
    hits = saved(possible(asked, filter_, blocks), "hits")
    ruled = F.col("rule").isNotNull()
    best = F.max_by(F.struct("rule", "verdict"), F.when(ruled, F.struct(F.length("rule"), "host_chars")))
    found = exact(hits, listed).groupBy("k", "u").agg(best.alias("best"), F.max(~ruled).alias("listed"))
    found = found.select(F.col("k").alias("_k"), F.col("u").alias("_u"), F.when(F.col("best.rule").isNotNull(), F.col("best")).alias("best"), "listed")
    host, path, _ = host_and_path(F.col("u"))
    all_ = rows.join(found, F.col("k").eqNullSafe(F.col("_k")) & (F.col("u") == F.col("_u")), "left")
    listed_ = F.coalesce("listed", F.lit(False))
    return all_.select(F.col("k").alias(key), host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(listed_, "block").otherwise("allow")).alias("verdict"), listed_.alias("listed"))


#: The rules of the query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Sites whose pages' canonical URLs the query lists: names under example.com, .net and .org.
SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def site_urls(pages: DataFrame, sites: tuple[str, ...] = SITES, url: str = "url") -> DataFrame:
    """(url) of all pages of listed sites, by the names in their hosts."""
    return pages.where(F.exists(F.split(host_and_path(F.col(url))[0], r"\."), lambda name: name.isin(*sites))).select(F.col(url).alias("url"))


ORACLE = f"""
WITH r AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '\\A[^/?#]*') AS raw FROM r),
p AS (SELECT *, coalesce(translate(raw, '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '\\A[^?#]*'), '') AS path FROM h),
c AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(substr(rest, length(raw) + length(path) + 1), '\\A\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))) AS kept FROM p),
u AS (SELECT *, CASE WHEN rest IS NOT NULL THEN host || regexp_replace(path, '/\\z', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM c),
l AS (SELECT DISTINCT canonical FROM u WHERE canonical IS NOT NULL AND len(list_intersect(string_split(host, '.'), {list(SITES)})) > 0),
s AS (SELECT * FROM (VALUES {", ".join(str(r) for r in RULES)}) s(verdict, rule_host, rule_path)),
f AS (SELECT page_id, host, path, canonical, (SELECT arg_max({{'rule': rule_host || rule_path, 'verdict': s.verdict}}, length(rule_host || rule_path)) FROM s WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best, canonical IS NOT NULL AND canonical IN (SELECT canonical FROM l) AS listed FROM u)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM f
"""
