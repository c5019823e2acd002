"""Fuzzy matching through delete neighbourhoods: an edit-distance join becomes an equi-join on what is left after deletions.

The index is a table (edit, word, count), a row for each word and each distinct string that at most k deletions leave of it. A query's own deletions are joined to it. The string is then a
subsequence of the word, so that their distance is len(word) - len(edit), without any distance function. Ranks:

- first: the first variant of the query that meets a word, by (deletes, code); there by distance, count, word. What the known library does.
- layer: deletes, distance, count, code, word.
- full: distance; among exact hits the earliest variant, else the highest count; then deletes, code, word.

Words are compared by code points and never folded. Joins on edits are merge joins (`on_edit`), in which a hot edit is split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from textloom.functions.text import DEDUPS, delete_edits, delete_variants, layered_edits, osa_within

from .tables import InvalidTypeInfo, schema_equal

FIRST, LAYER, FULL = "first", "layer", "full"
INDEX = T.StructType().add("edit", "string").add("word", "string").add("count", "long")


def build_index(dictionary: DataFrame, k: int = 2, complete: bool = False, max_distance: Column | None = None, dedup: str = "hash", p: float = 0.01) -> DataFrame:
    """dictionary: word, count. max_distance: per-word limit of at most k. dedup: one of DEDUPS. A posting comes once at any rate, so that none, hash and lru give one index; bloom loses
    some variants, at a rate of about p, and with them matches."""
    if dedup not in DEDUPS:
        raise ValueError(f"{dedup}: not one of {DEDUPS}")
    if dedup == "bloom":
        edits = lambda d: F.array_distinct(F.transform(layered_edits("word", d, "bloom", p=p), lambda e: e["edit"]))
    else:
        edits = lambda d: delete_edits("word", d, complete)
    if max_distance is None:
        each = edits(k)
    else:
        each = reduce(lambda c, d: c.when(max_distance == d, edits(d)), range(1, k + 1), F.when(max_distance == 0, edits(0)))
    return dictionary.select(F.explode(each).alias("edit"), "word", F.col("count").cast("long").alias("count"))


def store_index(index: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> None:
    """A bucketed table, at path or in the warehouse, so that later joins on edit need no shuffle of the index. It is built once; load_index reads it for any number of lookups."""
    out = index.select("edit", "word", "count").write.bucketBy(buckets, "edit").sortBy("edit").mode("overwrite")
    (out.option("path", path) if path else out).saveAsTable(table)


def load_index(spark: SparkSession, table: str) -> DataFrame:
    """A stored index; InvalidTypeInfo if the table isn't one."""
    index = spark.table(table)
    if not schema_equal(index.schema, INDEX):
        raise InvalidTypeInfo(f"{table}: {index.schema.simpleString()} instead of {INDEX.simpleString()}")
    return index


def on_edit(variants: DataFrame, index: DataFrame) -> DataFrame:
    """Their join on edit. What explode gives has the size of the words it was made from in Spark's eyes, so that its size check would broadcast postings of any number by way of the driver."""
    return variants.hint("merge").join(index, "edit")


def met(queries: DataFrame, index: DataFrame, k: int = 2, complete: bool = False) -> DataFrame:
    """queries: query (distinct) -> query, word, count, edit_distance, delete_distance, code: a row for each variant that meets a word within the limits."""
    variants = queries.select("query", F.explode(delete_variants("query", k, complete)).alias("v")).select("query", F.col("v.edit").alias("edit"), F.col("v.d").alias("delete_distance"), F.col("v.code").alias("code"))
    distance = F.char_length("word") - F.char_length("edit")
    found = on_edit(variants, index).where((F.abs(F.char_length("word") - F.char_length("query")) <= k) & (distance <= k))
    return found.select("query", "word", "count", distance.alias("edit_distance"), "delete_distance", "code")


def candidates(queries: DataFrame, index: DataFrame, k: int = 2, complete: bool = False) -> DataFrame:
    """met, each word of a query once, at its first variant. The least code of each number of deletions is a plain number, so the sums are hashed and merged before the shuffle; and
    with the number of deletions the distance is given: len(word) - len(query) + deletions."""
    least = [F.min(F.when(F.col("delete_distance") == d, F.col("code"))).alias(f"c{d}") for d in range(k + 1)]
    best = met(queries, index, k, complete).groupBy("query", "word", "count").agg(*least)
    deletes = F.coalesce(*[F.when(F.col(f"c{d}").isNotNull(), F.lit(d)) for d in range(k + 1)])
    distance = F.char_length("word") - F.char_length("query") + deletes
    return best.select("query", "word", "count", distance.alias("edit_distance"), deletes.alias("delete_distance"), F.coalesce(*[F.col(f"c{d}") for d in range(k + 1)]).alias("code"))


def order_of(mode: str) -> list[Column]:
    if mode == FIRST:
        return [F.col("delete_distance"), F.col("code"), F.col("edit_distance"), -F.col("count"), F.col("word")]
    if mode == LAYER:
        return [F.col("delete_distance"), F.col("edit_distance"), -F.col("count"), F.col("code"), F.col("word")]
    if mode == FULL:
        return [F.col("edit_distance"), F.when(F.col("edit_distance") == 0, 0).otherwise(-F.col("count")), F.col("delete_distance"), F.col("code"), F.col("word")]
    raise ValueError(f"{mode}: not one of {(FIRST, LAYER, FULL)}")


def lookup_all(queries: DataFrame, index: DataFrame, k: int = 2) -> DataFrame:
    return candidates(queries, index, k).select("query", "word", "edit_distance", "delete_distance", "count")


def lookup_topk(queries: DataFrame, index: DataFrame, k: int = 2, top: int = 3, mode: str = FIRST) -> DataFrame:
    ranked = candidates(queries, index, k).withColumn("rank", F.row_number().over(W.Window.partitionBy("query").orderBy(*order_of(mode))))
    return ranked.where(F.col("rank") <= top).select("query", "rank", "word", "edit_distance", "delete_distance", "count")


def lookup_top(queries: DataFrame, index: DataFrame, k: int = 2, mode: str = FIRST) -> DataFrame:
    """The best hit of each query that has one: a minimum over all variants that meet a word. No mode ranks a word's later variant above its first, so words need not be
    made distinct ahead of it, and partial minima are merged before the only shuffle behind the join."""
    keys = [c.alias(f"o{i}") for i, c in enumerate(order_of(mode))]
    hit = F.struct("word", "edit_distance", "delete_distance", "count").alias("hit")
    best = met(queries, index, k).groupBy("query").agg(F.min(F.struct(*keys, hit)).alias("b"))
    return best.select("query", "b.hit.*")


def lookup_miss(queries: DataFrame, index: DataFrame, k: int = 2) -> DataFrame:
    return queries.join(candidates(queries, index, k).select("query").distinct(), "query", "left_anti")


def probe(queries: DataFrame, index: DataFrame, k: int = 2) -> DataFrame:
    """queries: query (distinct) -> query, edit, word: every posting that a query's own deletions meet, before any rank or filter."""
    return on_edit(queries.select("query", F.explode(delete_edits("query", k)).alias("edit")), index).select("query", "edit", "word")


def too_long(queries: DataFrame, longest: int, k: int = 2) -> DataFrame:
    """The queries that no word of at most `longest` characters can match."""
    return queries.where(F.char_length("query") > longest + k)


def fuzzy_join(left: DataFrame, right: DataFrame, on_left: str, on_right: str, k: int = 1, metric: str | Callable[[Column, Column], Column] = "levenshtein") -> DataFrame:
    """All pairs of different or equal texts within distance k: both sides' complete deletions are joined, then the true distance is taken. metric: levenshtein, osa, or a function of two columns
    that is at least the number of deletions either side needs to meet the other, as edit distances are. A text of at most k characters can lose all of them, so the empty string counts here. Each
    distinct pair comes once; null texts have none."""

    def side(df: DataFrame, c: str, name: str) -> DataFrame:
        texts = df.select(F.col(f"`{c}`").alias(name)).distinct()
        edits = F.concat(delete_edits(name, k, True), F.when(F.char_length(name) <= k, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
        return texts.select(name, F.explode(F.array_distinct(edits)).alias("edit"))

    x, y = F.col("_left"), F.col("_right")
    pairs = on_edit(side(left, on_left, "_left"), side(right, on_right, "_right")).where(F.abs(F.char_length(x) - F.char_length(y)) <= k).select(x, y).distinct()
    distance = F.levenshtein(x, y, k) if metric == "levenshtein" else osa_within(x, y, k) if metric == "osa" else metric(x, y)
    out = pairs.withColumn("_distance", distance.cast("int")).where(F.col("_distance").between(0, k))
    return out.select(x.alias(on_left), y.alias(on_right if on_right != on_left else on_right + "_r"), F.col("_distance").alias("distance"))
