"""Dictionaries: (word, count) tables, from a table, from text files or from a corpus; statistics and misspelled samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import binomial, max_deletes


def from_table(df: DataFrame, word: str = "word", count: str = "count") -> DataFrame:
    """Equal words are one, with the sum of their counts; null and empty words go."""
    return df.where(F.col(word).isNotNull() & (F.col(word) != "")).groupBy(F.col(word).alias("word")).agg(F.sum(count).cast("long").alias("count"))


def from_corpus(docs: DataFrame, text: str = "text", pattern: str = "[a-z]+") -> DataFrame:
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("count"))


def usable(dictionary: DataFrame, least: int = 5, shortest: int = 3, longest: int = 12) -> DataFrame:
    return dictionary.where((F.col("count") >= least) & F.char_length("word").between(shortest, longest))


def stats(dictionary: DataFrame, k: int = 2, max_distance: Column | None = None) -> DataFrame:
    """One row: longest word in bytes and characters, the distance, sum of counts, largest C(len, k) and sum of C(len, 0..k), and whether all counts are equal. max_distance: a distance of each
    word's own, of at most k. An empty dictionary has zeros, and equal counts."""
    n = F.char_length("word")
    own = F.lit(k) if max_distance is None else max_distance
    of = lambda f: reduce(lambda c, d: c.when(own == d, f(n, d)), range(1, k + 1), F.when(own == 0, f(n, 0)))
    whole = lambda c: F.coalesce(F.max(c).cast("long"), F.lit(0).cast("long"))
    distance = F.lit(k).cast("long") if max_distance is None else whole(own)
    return dictionary.agg(
        whole(F.octet_length("word")).alias("word_max_bytes"), whole(n).alias("word_max_len"), distance.alias("max_distance"), F.coalesce(F.sum("count").cast("long"), F.lit(0).cast("long")).alias("count_sum"),
        whole(of(binomial)).alias("edits_layer_num_max"), whole(of(max_deletes)).alias("edits_num_max"), F.coalesce(F.min("count") == F.max("count"), F.lit(True)).alias("count_uniform"),
    )


def misspelled(words: DataFrame) -> DataFrame:
    """(query, truth): by length of the word a letter in its middle is dropped, doubled, swapped with the next, or replaced by x."""
    n = F.char_length("word")
    p = F.greatest(F.floor(n / 2).cast("int"), F.lit(1))
    left, here, after, rest = F.substr("word", F.lit(1), p - 1), F.substr("word", p, F.lit(1)), F.substr("word", p + 1, F.lit(1)), F.substr("word", p + 2)
    query = F.when(n % 4 == 0, F.concat(left, after, rest)).when(n % 4 == 1, F.concat(left, here, here, after, rest)).when(n % 4 == 2, F.concat(left, after, here, rest)).otherwise(F.concat(left, F.lit("x"), after, rest))
    return words.select(query.alias("query"), F.col("word").alias("truth"))
