"""Text sources: sections of `word count`, `query -> expected` and `text -> a|b` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def section(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Lines between @name and @name_END, trimmed, without comments (#) and blank lines; such files are small test inputs, read whole."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", rf"(?s)@{name}\s*\n(.*?)@{name}_END", 1).alias("t"))
    lines = text.select(F.explode(F.split("t", "\n")).alias("line")).select(F.trim(F.regexp_replace("line", "\t", " ")).alias("line"))
    return lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def dictionary_lines(lines: DataFrame) -> DataFrame:
    """(word, count); the count stands behind the last blank, so words may hold blanks."""
    m = lambda k: F.regexp_extract("line", r"^(.*) (\d+)$", k)
    return lines.where(F.col("line").rlike(r"^.* \d+$")).select(m(1).alias("word"), m(2).cast("long").alias("count"))


def pair_lines(lines: DataFrame) -> DataFrame:
    """(query, expected); null where nothing is expected."""
    parts = F.split("line", "->", 2)
    return lines.select(F.trim(parts[0]).alias("query"), F.nullif(F.trim(parts[1]), F.lit("")).alias("expected"))


def segmentation_lines(lines: DataFrame) -> DataFrame:
    pairs = pair_lines(lines)
    return pairs.select(F.col("query").alias("text"), F.split("expected", r"\|").alias("expected"))
