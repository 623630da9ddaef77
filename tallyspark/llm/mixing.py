"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Every slot of the schedule gets a golden-ratio point, which the cumulative targets map to a source. A
source's slots are ranked; the source's documents, shuffled by a hash and laid end to end, are cut into as
many equal blocks of words, and the slot of rank r takes block r. A source whose target is above its size
runs through its documents again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import saved

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating; share of all words that the mix holds; most passes over a source.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Words a slot is meant to hold; slots ranked together; cells of the unit interval that slots and sources meet in.
SLOT_WORDS, RANKED, CELLS = 4096, 1 << 14, 1024
#: A source table of at most so many rows goes to all tasks; a longer one is joined by shuffle.
SMALL = 50_000

GOLDEN = (5**0.5 - 1) / 2


def _near(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= SMALL else table


def word_sizes(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(key, source, size, draw, turn): words of the whole text, null as 0, the hash that shuffles, and what tells rows of one key apart: the text's hash and a number.

    Rows without a key are shuffled by their text, so that no bucket of the hash holds them all.
    """
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    mark = F.hex(F.xxhash64(F.col(text).cast("string")))
    draw = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null "), mark)), F.lit(":mix")).cast("binary"))
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), size.alias("size"), draw.alias("draw"), mark.alias("mark"))
    number = F.row_number().over(Window.partitionBy("source", "key", "size", "mark").orderBy("draw"))
    return rows.withColumn("turn", F.concat_ws(".", "mark", F.lpad(number.cast("string"), 10, "0"))).drop("mark")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, ord, weight, source_size, target, quota) for each source.

    Sources stand in code point order, null last. Targets share ``share`` of all words by weight; one above
    ``passes`` times its source stops there and the excess is shared again by weight until none is above, which
    comes to one level: sources are filled in order of limit over weight. quota is the whole words of the target.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # a row for each source: these windows are over the catalogue of sources, not over documents
    each = each.withColumn("ord", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    each = each.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("ord") - 1) % len(weights) + 1))
    each = each.withColumn("most", F.col("source_size") * passes)
    before = Window.orderBy(F.col("most") / F.col("weight"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    pool, heavy = F.sum("source_size").over(every) * F.lit(float(share)), F.sum("weight").over(every)
    each = each.withColumn("level", (pool - F.coalesce(F.sum("most").over(before), F.lit(0))) / (heavy - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    each = each.withColumn("full", F.col("level") > F.col("most") / F.col("weight"))
    level = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), "ord"))).over(every)
    each = each.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * level))
    return each.select("source", "ord", "weight", "source_size", "target", F.least(F.floor("target"), F.col("most")).cast("long").alias("quota"))


def schedule(sources: DataFrame, slot_words: int = SLOT_WORDS) -> DataFrame:
    """(slot, ord, rank, slots): the source of each slot, its rank among the source's slots from 0, and their number.

    A source too small to be met has one slot behind all others.
    """
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    count = -(-total // slot_words)
    rows = sources.count()
    upto = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    ends = sources.where("quota > 0").select("ord", "quota", F.sum("quota").over(upto).alias("end"))
    spans_ = ends.select("ord", ((F.col("end") - F.col("quota")) / total).alias("low"), (F.col("end") / total).alias("high")) if total else ends.select("ord", F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    cells = spans_.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.col("high") * CELLS))))
    slots = sources.sparkSession.range(count).withColumnRenamed("id", "slot")
    slots = slots.withColumn("u", (F.col("slot") + 1) * GOLDEN - F.floor((F.col("slot") + 1) * GOLDEN)).withColumn("cell", F.floor(F.col("u") * CELLS))
    met = slots.join(_near(cells, rows + CELLS), "cell").where("u >= low and u < high").select("slot", "ord", F.floor(F.col("slot") / RANKED).alias("part"))
    counts = met.groupBy("ord", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("ord").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("ord", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("ord")).alias("slots"))
    inner = F.row_number().over(Window.partitionBy("ord", "part").orderBy("slot")) - 1
    ranked = met.withColumn("inner", inner).join(bases, ["ord", "part"]).select("slot", "ord", (F.col("base") + F.col("inner")).alias("rank"), "slots")
    unmet = sources.where("quota > 0").join(met.select("ord").distinct(), "ord", "left_anti").select((F.col("ord") + count).alias("slot"), "ord", F.lit(0).cast("long").alias("rank"), F.lit(1).cast("long").alias("slots"))
    return ranked.unionByName(unmet)


def mix(sizes: DataFrame, sources: DataFrame, slot_words: int = SLOT_WORDS) -> DataFrame:
    """(slot, ord, rank, key, turn, size, from_word, words): the pieces of documents that fill each slot."""
    rows = sources.count()
    near = _near(sources.select(F.col("source").alias("_source"), "ord", "source_size", "quota"), rows)
    docs = sizes.where("size > 0").join(near, F.col("source").eqNullSafe(F.col("_source"))).select("key", "size", "draw", "turn", "ord", "source_size", "quota", F.substring("draw", 1, 3).alias("bucket"))
    # positions: buckets of the hash in order, then documents in each, so that no window holds a whole source
    earlier = Window.partitionBy("ord").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = docs.groupBy("ord", "bucket").agg(F.sum("size").alias("n")).select("ord", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("ord", "bucket").orderBy("draw", "key", "size", "turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bases, ["ord", "bucket"]).withColumn("at", F.col("base") + F.col("inner"))
    runs = placed.where("at < quota").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(quota - 1 - at) div source_size"))))
    runs = runs.withColumn("p", F.col("pass") * F.col("source_size") + F.col("at")).withColumn("words", F.least("size", F.col("quota") - F.col("p")))
    slots = schedule(sources, slot_words)
    blocks = slots.where("rank = 0").select("ord", "slots")
    blocks = blocks.join(sources.select("ord", "quota"), "ord").select("ord", F.least("slots", "quota").alias("blocks"), "quota").select("ord", "blocks", F.expr("quota div blocks").alias("width"), F.expr("quota % blocks").alias("extra"))
    runs = runs.join(_near(blocks, rows), "ord")
    number = lambda p: F.expr(f"if({p} < extra * (width + 1), {p} div (width + 1), extra + ({p} - extra * (width + 1)) div width)")
    start = lambda r: F.expr(f"{r} * width + least({r}, extra)")
    cut = runs.withColumn("rank", F.explode(F.sequence(number("p"), number("(p + words - 1)"))))
    cut = cut.withColumn("low", F.greatest(F.col("p"), start("rank"))).withColumn("high", F.least(F.col("p") + F.col("words"), start("(rank + 1)")))
    pieces = cut.select("ord", "rank", "key", "turn", "size", (F.col("low") - F.col("p")).alias("from_word"), (F.col("high") - F.col("low")).alias("words"))
    return pieces.join(slots.select("slot", "ord", "rank"), ["ord", "rank"]).select("slot", "ord", "rank", "key", "turn", "size", "from_word", "words")


def taken_words(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, slot_words: int = SLOT_WORDS) -> DataFrame:
    """(key, source, size, source_size, target, taken) for every row: the words that the mix takes of it, repeats counted.

    Null texts have size 0; null is a source of its own, the last. Rows of no words take nothing. Of rows that
    share key, source and size it is open which is which; a rerun gives the same rows. An empty table gives none.
    """
    sizes = saved(word_sizes(docs, key, source, text), "sizes")
    sources = saved(targets(sizes, weights, share, passes), "sources")
    took = mix(sizes, sources, slot_words).groupBy("ord", "key", "size", "turn").agg(F.sum("words").alias("taken"))
    took = took.select(F.col("ord").alias("_ord"), F.col("key").alias("_key"), F.col("size").alias("_size"), F.col("turn").alias("_turn"), "taken")
    near = _near(sources.select(F.col("source").alias("_source"), "ord", "source_size", "target"), sources.count())
    rows = sizes.join(near, F.col("source").eqNullSafe(F.col("_source")), "left")
    rows = rows.join(took, (F.col("ord") == F.col("_ord")) & F.col("key").eqNullSafe(F.col("_key")) & (F.col("size") == F.col("_size")) & (F.col("turn") == F.col("_turn")), "left")
    return rows.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


#: The same rows in one closed form for DuckDB: what the blocks take together is a stretch of each source's order.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix') AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM s),
w AS (SELECT *, CAST([5, 2, 1][(ord - 1) % 3 + 1] AS BIGINT) AS weight, 2 * source_size AS most FROM o),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
             - CAST(coalesce(sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY CAST(most AS DOUBLE) / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM w),
f AS (SELECT *, level > CAST(most AS DOUBLE) / weight AS full_ FROM l),
v AS (SELECT arg_min(level, row(CAST(most AS DOUBLE) / weight, ord)) AS level FROM f WHERE NOT full_),
t AS (
  SELECT source, source_size, CASE WHEN full_ THEN CAST(most AS DOUBLE) ELSE weight * v.level END AS target, most
  FROM f, v),
q AS (SELECT *, least(CAST(floor(target) AS BIGINT), most) AS quota FROM t),
p AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.quota,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS at_
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0
            ELSE size * (quota // source_size) + greatest(0, least(size, quota % source_size - at_)) END AS BIGINT) AS taken
FROM p
"""
