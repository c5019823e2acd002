"""Mixing sources to target weights along a curriculum.

Shares. The sources, by code point with null last, weigh 1, 2, 3 and again; together their targets are all sizes. A target stops at `most` times its source's
size, and the excess goes to the others by weight until none is above: the water level L with sum(min(L * weight, most * size)) = total, found by rounds of sums
over one row per source. Weights and slopes are parameters.

Curriculum. In a source's schedule the weight at time t of [0, 1] is proportional to 1 + slope * (2t - 1), whose integral is the share of its target
demanded by t; slopes repeat -0.5, 0, 0.5 along the sources. The source's documents, in the order of md5(doc_id), stand one after
another on a line of words, once for each of `most` rounds. A copy whose middle lies before the target is taken. A source has two lines: long documents,
of over 1/`fine` of its target each, whose target is their part of the source's words, and the others, who get what the long ones leave of the
source's target; so a source ends within 1/`fine` of its target if it has such others. A copy's training position is the time at which the cumulative demand
on its line reaches its middle: the inverse of the integral. Results are sorted by range of the position.

Scale. Running sums within a source use two levels: sums of (source, bucket), buckets being leading digits of the md5, then sums inside a
bucket; the number of buckets grows with the rows, so that no task holds a source.

Cases. Null and empty texts have size 0, are never taken and have a null position. Null sources are one source, the last. Repeated rows (equal id, source and size)
follow each other and count each. A source without words has target 0. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from textloom.operators.tables import numbered

from .common import fresh, load, written

#: Weights and slopes of the sources in order, repeating.
WEIGHTS, SLOPES = (1.0, 2.0, 3.0), (-0.5, 0.0, 0.5)
#: Words of a text.
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shares(sizes: DataFrame, most: int = 3, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """sizes: source, source_size -> source, source_size, target, slope. Sources may be many: they are numbered over ranges, and the water level comes by rounds of sums. A round takes the
    sources that are full at the level so far out of it, until no more are; the level only rises."""
    ranked = numbered(sizes.withColumn("last", F.col("source").isNull()), "last", "source", name="k").drop("last")
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("k") % len(values) + 1).cast("int"))
    s = written(ranked.select("source", F.col("source_size"), pick(weights).alias("w"), (most * F.col("source_size")).cast("double").alias("top"), pick(slopes).alias("slope")), "mix-sources")
    level, left = 0.0, -1
    while True:
        free = F.col("top") / F.col("w") >= level
        total, full, open_, count = s.agg(F.sum("source_size"), F.sum(F.when(~free, F.col("top"))), F.sum(F.when(free, F.col("w"))), F.count_if(free)).first()  # single numbers
        if not count or count == left:
            break
        level, left = (float(total) - (full or 0.0)) / open_, count
    return s.select("source", "source_size", F.least(F.col("top"), F.lit(level) * F.col("w")).alias("target"), "slope")


def copies_at(before: Column, size: Column, line_size: Column, line_target: Column, most: int) -> Column:
    """How many of a document's places, one in each round of its line, have their middle ahead of the line's target."""
    taken = [F.when((size > 0) & (2 * (p * line_size + before) + size < 2 * line_target), 1).otherwise(0) for p in range(most)]
    return sum(taken[1:], taken[0])


def placed(docs: DataFrame, most: int = 3, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, rows_per_bucket: int = 20_000, fine: int = 40) -> DataFrame:
    """docs: doc_id, source, text -> doc_id, source, size, source_size, target, slope, copies, line_size, line_target, before (words of its line ahead of it)."""
    base = written(docs.select("doc_id", "source", size_of("text").alias("size"), F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")).alias("h")), "mix-sizes")
    rows = base.count()
    digits = 2
    while 16**digits * rows_per_bucket < rows:
        digits += 1
    target = written(shares(base.groupBy("source").agg(F.sum("size").alias("source_size")), most, weights, slopes), "mix-targets").withColumnRenamed("source", "s0")
    lines = base.join(target, F.col("source").eqNullSafe(F.col("s0"))).drop("s0").withColumn("long", F.col("size") * fine > F.col("target")).withColumn("bucket", F.substring("h", 1, digits))
    sums = written(lines.groupBy("source", "long", "bucket").agg(F.sum("size").alias("n")), "mix-sums")
    line = W.Window.partitionBy("source", "long")
    ahead = F.coalesce(F.sum("n").over(line.orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("s1"), F.col("long").alias("l1"), F.col("bucket").alias("b1"), ahead.alias("ahead"), F.sum("n").over(line).alias("line_size"))
    inside = F.sum("size").over(W.Window.partitionBy("source", "long", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.Window.unboundedPreceding, -1))
    out = lines.withColumn("inside", F.coalesce(inside, F.lit(0)))
    out = out.join(sums, F.col("source").eqNullSafe(F.col("s1")) & (F.col("long") == F.col("l1")) & (F.col("bucket") == F.col("b1"))).withColumn("before", F.col("ahead") + F.col("inside"))
    out = written(out.select("doc_id", "source", "size", "source_size", "target", "slope", "long", "line_size", "before"), "mix-lines")

    copies = lambda df: df.withColumn("copies", copies_at(F.col("before"), F.col("size"), F.col("line_size"), F.col("line_target"), most))
    first = copies(out.where("long").withColumn("line_target", F.col("target") * F.col("line_size") / F.col("source_size")))
    used = first.groupBy(F.col("source").alias("s1")).agg(F.sum(F.col("copies") * F.col("size")).alias("used"))
    rest = out.where("not long").join(used, F.col("source").eqNullSafe(F.col("s1")), "left")
    rest = copies(rest.withColumn("line_target", F.greatest(F.col("target") - F.coalesce("used", F.lit(0)), F.lit(0.0)))).drop("s1", "used")
    return first.unionByName(rest).drop("long")


def position(at, target, slope) -> Column:
    """Inverse of the demand: t with t + slope * (t^2 - t) = at / target."""
    y = at / target
    b = 1 - slope
    return F.when(slope == 0, y).otherwise((F.sqrt(b * b + 4 * slope * y) - b) / (2 * slope))


def mix(docs: DataFrame, most: int = 3, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """A row per document with taken, and the positions of its first and last copy, sorted by the first."""
    p = placed(docs, most, weights, slopes)
    mid = F.col("before") + F.col("size") / 2
    first = F.when(F.col("copies") > 0, position(mid, F.col("line_target"), F.col("slope")))
    last = F.when(F.col("copies") > 0, position(mid + (F.col("copies") - 1) * F.col("line_size"), F.col("line_target"), F.col("slope")))
    out = p.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", first.alias("first_position"), last.alias("last_position"))
    return out.orderBy(F.col("first_position").asc_nulls_last(), "size", "doc_id")


def mixed_documents(docs: DataFrame, most: int = 3, name: str = "mix_position", weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """The mix itself: docs' columns, each document as often as it is taken, and its position in column `name` (in place of one of that name), sorted by it. The places of
    rows of equal id, source and size are given to them in the order of their texts' hashes, so that each row has its own and the mix takes what `mix` says."""
    docs = docs.drop(name)
    i, s, n, texts, *line = fresh(docs.withColumn(name, F.lit(None)), "mix_id", "mix_source", "mix_size", "mix_hash", "mix_before", "mix_line", "mix_target", "mix_slope")
    # no key is null: an id becomes text, and a source has a letter before it
    key = lambda size: [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(i), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias(s), size.alias(n)]
    p = placed(docs, most, weights, slopes).where("copies > 0").select(*key(F.col("size")), "before", "line_size", "line_target", "slope")
    p = p.groupBy(i, s, n).agg(F.min("before").alias(line[0]), *[F.max(c).alias(x) for c, x in zip(("line_size", "line_target", "slope"), line[1:], strict=True)])
    d = docs.select("*", *key(size_of("text")), F.xxhash64("text").alias(texts)).where(F.col(n) > 0)
    out = d.hint("merge").join(p, [i, s, n])
    # rows of equal id, source and size follow each other on their line
    before = F.col(line[0]) + (F.row_number().over(W.Window.partitionBy(i, s, n).orderBy(texts)) - 1) * F.col(n)
    size, line_size, line_target, slope = F.col(n), *map(F.col, line[1:])
    out = out.withColumn(line[0], before).withColumn(texts, copies_at(F.col(line[0]), size, line_size, line_target, most)).where(F.col(texts) > 0)
    out = out.withColumn(texts, F.explode(F.sequence(F.lit(0), F.col(texts) - 1)))
    out = out.withColumn(name, position(F.col(line[0]) + size / 2 + F.col(texts) * line_size, line_target, slope))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], name).orderBy(name, F.col("doc_id").asc_nulls_last())


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mix, repeated as often as taken, in training order, with their own columns."""
    (name,) = fresh(docs, "mix_position")
    return mixed_documents(docs, name=name).drop(name)


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce(md5(doc_id::VARCHAR), '') AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM s),
w AS (SELECT *, ((k - 1) % 3 + 1)::DOUBLE AS w, (3 * source_size)::DOUBLE AS top FROM k),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY top / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
m AS (SELECT *, max(CASE WHEN level <= top / w THEN level END) OVER () AS water FROM l),
t AS (SELECT source, source_size, least(top, coalesce(water * w, top)) AS target, ((k - 1) % 3 - 1) * 0.5::DOUBLE AS slope FROM m),
p AS (SELECT d.*, source_size, target, slope, size * 40 > target AS long FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, sum(size) OVER (PARTITION BY source, long)::BIGINT AS line_size, coalesce(sum(size) OVER (PARTITION BY source, long ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM p),
f AS (SELECT *, target * line_size / source_size AS line_target FROM n WHERE long),
f2 AS (SELECT *, CASE WHEN size > 0 THEN (2 * before + size < 2 * line_target)::INT + (2 * (line_size + before) + size < 2 * line_target)::INT + (2 * (2 * line_size + before) + size < 2 * line_target)::INT ELSE 0 END AS copies FROM f),
u AS (SELECT source, sum(copies * size)::BIGINT AS used FROM f2 GROUP BY source),
g AS (SELECT n.*, greatest(target - coalesce(used, 0), 0) AS line_target FROM n LEFT JOIN u ON n.source IS NOT DISTINCT FROM u.source WHERE NOT long),
c AS (SELECT * FROM f2 UNION ALL SELECT *, CASE WHEN size > 0 THEN (2 * before + size < 2 * line_target)::INT + (2 * (line_size + before) + size < 2 * line_target)::INT + (2 * (2 * line_size + before) + size < 2 * line_target)::INT ELSE 0 END AS copies FROM g),
y AS (SELECT *, (before + size / 2.0::DOUBLE) / nullif(line_target, 0) AS a, (before + size / 2.0::DOUBLE + (copies - 1) * line_size) / nullif(line_target, 0) AS b FROM c)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies,
  CASE WHEN copies > 0 THEN CASE WHEN slope = 0 THEN a ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * a) - (1 - slope)) / (2 * slope) END END AS first_position,
  CASE WHEN copies > 0 THEN CASE WHEN slope = 0 THEN b ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * b) - (1 - slope)) / (2 * slope) END END AS last_position
FROM y
"""
