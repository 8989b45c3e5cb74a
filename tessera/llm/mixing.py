"""Mixing sources to target weights by Pareto order sampling, entirely in DataFrame operations.

A source's target over its size is how often its documents should appear. The whole part is certain copies of each
document; the rest is a sample without replacement of a fixed size in words. Every document has its own inclusion
probability, larger for short documents, so that the sum comes nearer to the target, and such that the words expected
are those that are left of it. Documents are ranked by random odds over inclusion odds, u / (1 - u) : p / (1 - p), and
the lowest are taken while their words fit. The gap that remains gets the one further document whose size is nearest
to it, if that brings the sum nearer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, cut, small, uniform

#: Splits of a source's rank axis at each level; below LEVELS of them, the rows left in one split are sorted.
SPLITS, LEVELS = 4096, 2
#: Parts of a source that look for its closing document apart; the best of theirs is the source's.
SALTS = 64


def source_targets(sizes: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """(source, source_size, sid, target) of a table of (source, source_size), a row for each source.

    Sources by code point, null last, weigh 1, 2, ... cycle, repeating. Targets share the sum of all sizes by
    weight, none above `most` times its source's size: with sources ordered by cap over weight, those before the
    first whose cap exceeds its share get their cap and the others share what is left.
    """
    first = Window.orderBy(F.asc_nulls_last("source"))
    rows = sizes.withColumn("sid", F.row_number().over(first).cast("long")).withColumn("w", (F.col("sid") - 1) % cycle + 1).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy((F.col("cap").cast("double") / F.col("w")), "sid")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    rows = rows.withColumn("weights", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).withColumn("place", F.row_number().over(order))
    free = F.col("cap").cast("double") * F.col("weights") > F.col("w").cast("double") * F.col("left")
    start = F.min(F.when(free, F.struct("place", "left", "weights"))).over(every)
    share = (F.col("w") * F.col("start.left")).cast("double") / F.col("start.weights")
    return rows.withColumn("start", start).select("source", "source_size", "sid", F.when(F.col("place") >= F.col("start.place"), share).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, cycle: int = 3, most: int = 3, key: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, key) for every row of docs; key is the given column, a long, or null.

    size is the row's words (a null text: 0), taken = copies * size, copies from 0 to `most`. Draws depend on the id and seed only, so reruns agree;
    rows that repeat an id tie, and are taken by size. A null source is a source. Rows without id draw by their texts.
    Texts of any length are counted whole. Other columns of docs, of any name, are not read. An empty table gives no
    rows; where all texts are empty, targets are 0.

    A source's rows are never gathered: sums over splits of the rank axis find the one split in which the target
    falls, twice over, and only the rows in it are sorted. The table of sources has a row a source.
    """
    draw = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.xxhash64(text_col).cast("string")))
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), uniform(draw, F.lit(seed)).alias("u"), (F.lit(None) if key is None else key).cast("long").alias("key")).withColumn("row", F.monotonically_increasing_id()))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = cut(source_targets(sizes, cycle, most).join(sizes.select(F.col("source").alias("of"), F.floor(F.col("source_size") / F.col("n")).alias("mean")), F.col("source").eqNullSafe(F.col("of"))).drop("source"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("mean", F.greatest(F.col("mean"), F.lit(1)).cast("long"))
    rows = rows.join(small(sources), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # With g = min(1, mean / size) and G its mean over words, p = f (1 + c (g - G)) expects f of all words, and c keeps p between 0 and 1.
    short = cut(rows.groupBy("sid").agg(F.sum(F.least("size", "mean")).alias("short")))
    rows = rows.join(small(short), "sid")
    f = F.col("rest") / F.nullif(F.col("source_size"), F.lit(0))
    c = F.least(F.lit(1.0), (1.0 - f) / F.nullif(f, F.lit(0.0)))
    g = F.least(F.lit(1.0), F.col("mean").cast("double") / F.greatest(F.col("size"), F.lit(1)))
    part = f * (1.0 + c * (g - F.col("short") / F.nullif(F.col("source_size"), F.lit(0))))
    rank = (F.col("u") / (1 - F.col("u"))) / F.nullif(part / (1 - part), F.lit(0.0))
    rows = rows.withColumn("rank", rank).withColumn("axis", F.col("rank") / (1 + F.col("rank")))
    none, open_ = rows.where("rank is null"), rows.where("rank is not null").withColumn("begin", F.lit(0).cast("long"))
    done = [none.withColumn("chosen", F.lit(0))]
    keys = ["sid"]
    for level in range(1, LEVELS + 1):
        split = f"split{level}"
        open_ = open_.withColumn(split, F.floor(F.col("axis") * float(SPLITS**level)))
        before = Window.partitionBy(*keys).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
        sums = open_.groupBy(*keys, split).agg(F.sum("size").alias("within"), F.first("begin").alias("base"))
        sums = sums.select(*keys, split, "within", (F.col("base") + F.coalesce(F.sum("within").over(before), F.lit(0))).alias("start"))
        keys.append(split)
        open_ = cut(open_.drop("begin").join(sums, keys))
        done += [open_.where("start + within <= rest").withColumn("chosen", F.lit(1)), open_.where("start > rest and start + within > rest").withColumn("chosen", F.lit(0))]
        open_ = open_.where("start <= rest and start + within > rest").withColumnRenamed("start", "begin").drop("within")
    upto = Window.partitionBy(*keys).orderBy("rank", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = open_.withColumn("chosen", F.when(F.col("begin") + F.sum("size").over(upto) <= F.col("rest"), 1).otherwise(0))
    names = ["doc_id", "source", "size", "source_size", "target", "whole", "chosen", "sid", "rest", "rank", "row", "key"]
    out = last.select(*names)
    for x in done:
        out = out.unionByName(x.select(*names))
    out = cut(out)
    gaps = out.groupBy("sid").agg((F.first("rest") - F.sum(F.col("size") * F.col("chosen"))).alias("gap"))
    off = F.abs(F.col("size") - F.col("gap"))
    gaps = cut(gaps).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    fits = out.where("chosen = 0 and rank is not null").withColumn("salt", (F.col("row") % SALTS).cast("int")).join(small(gaps), ["sid", "salt"]).where(off < F.col("gap"))
    best = fits.groupBy("sid", "salt").agg(F.min(F.struct(off, "rank", "doc_id", "size", "row")).alias("best"))
    fill = best.groupBy("sid").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    out = out.join(fill.withColumn("fill", F.lit(1)), "row", "left").withColumn("chosen", F.coalesce("fill", "chosen"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("chosen")).alias("copies"), ((F.col("whole") + F.col("chosen")) * F.col("size")).alias("taken"), "key")


#: The same mix for one engine's SQL: one window over each source stands for the splits.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':17'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM {docs}
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(greatest(floor(CAST(sum(size) AS DOUBLE) / count(*)), 1) AS BIGINT) AS mean FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid, 3 * source_size AS cap FROM s
), w AS (
  SELECT *, (sid - 1) % 3 + 1 AS w FROM r
), o AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(cap) OVER b AS BIGINT), 0) AS remaining,
         CAST(sum(w) OVER () AS BIGINT) - coalesce(CAST(sum(w) OVER b AS BIGINT), 0) AS weights,
         row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / w, sid) AS place
  FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT place, remaining, weights FROM o WHERE CAST(cap AS DOUBLE) * weights > CAST(w AS DOUBLE) * remaining ORDER BY place LIMIT 1
), t AS (
  SELECT o.source, o.source_size, o.mean, o.sid,
         CASE WHEN o.place >= f.place THEN CAST(o.w * f.remaining AS DOUBLE) / f.weights ELSE CAST(o.cap AS DOUBLE) END AS target
  FROM o LEFT JOIN f ON true
), j AS (
  SELECT d.*, t.source_size, t.mean, t.sid, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, target - whole * source_size AS rest, CAST(sum(least(size, mean)) OVER (PARTITION BY sid) AS BIGINT) AS short FROM j
), h AS (
  SELECT *, rest / nullif(source_size, 0) AS f FROM p
), y AS (
  SELECT *, f * (1 + least(1, (1 - f) / nullif(f, 0)) * (least(1, CAST(mean AS DOUBLE) / greatest(size, 1)) - CAST(short AS DOUBLE) / nullif(source_size, 0))) AS part FROM h
), q AS (
  SELECT *, (u / (1 - u)) / nullif(part / (1 - part), 0) AS rank FROM y
), c AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY sid ORDER BY floor(rank / (1 + rank) * 4096.0), floor(rank / (1 + rank) * 16777216.0), rank, doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM q WHERE rank IS NOT NULL
), k AS (
  SELECT *, CASE WHEN upto <= rest THEN 1 ELSE 0 END AS chosen FROM c
), g AS (
  SELECT *, rest - CAST(sum(size * chosen) OVER (PARTITION BY sid) AS BIGINT) AS gap FROM k
), e AS (
  SELECT *, row_number() OVER (PARTITION BY sid ORDER BY chosen, abs(size - gap), rank, doc_id, size) AS nearest FROM g
), x AS (
  SELECT doc_id, size, source_size, target, whole + CASE WHEN chosen = 0 AND nearest = 1 AND abs(size - gap) < gap THEN 1 ELSE chosen END AS copies FROM e
  UNION ALL SELECT doc_id, size, source_size, target, whole FROM q WHERE rank IS NULL
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM x
"""
