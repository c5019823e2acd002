"""Splitting and correcting run-together phrases: every part of a phrase is looked up, each distinct part once and in bulk, and an ordered fold chooses the split.

Cost of a part: its edit distance to the hit (a miss costs its length), removed marks, and 1 where it doesn't begin with a separator; probability: log10(count / sum), a miss 10 / (sum * length^10). A split replaces a stored one if
its distance is smaller, or as large (with or without the separator's 1) and more probable; this depends on the order of parts, hence a fold over (start, length)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import lookup_top


@dataclass
class Options:
    #: What is removed from a part, and what joins the parts.
    punctuation: tuple[str, ...] = (",", "]", "[", ")", "(", "}", "{", ".")
    separators: tuple[str, ...] = (" ",)
    token: str = " "


def clean_part(raw: Column, options: Options | None = None) -> tuple[Column, Column, Column]:
    """(the part without separators and punctuation, bytes removed besides a leading separator, whether a separator leads)."""
    o = options or Options()
    led, body = F.lit(False), raw
    for s in o.separators:
        led = led | raw.startswith(s)
        body = F.when(raw.startswith(s), F.substr(raw, F.lit(len(s) + 1))).otherwise(body)
    clean = F.regexp_replace(body, "|".join(re.escape(m) for m in (*o.separators, *o.punctuation)), "") if o.separators or o.punctuation else body
    return clean, F.octet_length(body) - F.octet_length(clean), led


def hit_score(count: Column, count_sum: int) -> Column:
    return F.log10(count / F.lit(float(count_sum)))


def miss_score(length: Column, count_sum: int) -> Column:
    return F.log10(F.lit(10.0) / (F.lit(float(count_sum)) * F.pow(length.cast("double"), F.lit(10.0))))


#: What is known of the best split of a beginning of the phrase.
STATE = "struct<distance:bigint,log:double,segmented:string,corrected:string>"


def chosen(now: Column, head: Column, part: Column, token: str) -> Column:
    """The better of the split that is known up to a part's end (now, or null) and head, the split up to its beginning, with the part behind it."""
    plain = head["distance"] + part["cost"]
    whole = plain + part["gap"]
    log = head["log"] + part["log"]
    better = now.isNull() | (now["distance"].isin(plain, whole) & (now["log"] < log)) | (whole < now["distance"])
    longer = F.struct(
        whole.alias("distance"), log.alias("log"), F.concat(head["segmented"], F.lit(token), part["part"]).alias("segmented"), F.concat(head["corrected"], F.lit(token), part["word"]).alias("corrected")
    ).cast(STATE)
    return F.when(head.isNotNull() & better, longer).otherwise(now)


def fold(starts: Column, reach: Column, token: str) -> Column:
    """starts: for each place of the phrase in order the parts that begin there, by length. The splits that end within reach of the present place are carried along, nearest end first, so that a
    step costs no more than its parts."""
    none = F.lit(None).cast(STATE)

    def first(p: Column) -> Column:
        return F.struct(p["cost"].cast("bigint").alias("distance"), p["log"].alias("log"), p["part"].alias("segmented"), p["word"].alias("corrected")).cast(STATE)

    def step(ends: Column, parts: Column) -> Column:
        head = F.element_at(ends, 1)
        moved = F.transform(parts, lambda p, i: chosen(F.get(ends, i + 1), head, p, token))
        rest = F.slice(ends, F.size(parts) + 2, F.greatest(F.size(ends) - F.size(parts) - 1, F.lit(0)))
        return F.concat(moved, rest)

    opened = F.transform(F.element_at(starts, 1), first)
    return F.element_at(F.aggregate(F.slice(starts, F.lit(2), F.size(starts)), F.concat(opened, F.array_repeat(none, reach - F.size(opened))), step), 1)


def segment(phrases: DataFrame, index: DataFrame, k: int = 2, word_max: int = 12, count_sum: int = 1, options: Options | None = None, mode: str = "first") -> DataFrame:
    """phrases: phrase (distinct) -> phrase and the best split; null for an empty phrase. count_sum: of the dictionary; word_max: its longest word. The parts of one phrase come together in
    its row; a phrase has at most (word_max + k) of them for each of its characters."""
    o = options or Options()
    n = F.char_length("phrase")
    reach = word_max + k
    spans = F.flatten(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.transform(F.sequence(F.lit(1), F.least(F.lit(reach), n - j)), lambda i: F.struct(j.alias("j"), i.alias("i")))))
    parts = phrases.select("phrase", F.explode(spans).alias("s")).select("phrase", "s.j", "s.i", F.substr("phrase", F.col("s.j") + 1, F.col("s.i")).alias("raw"))
    clean, removed, led = clean_part(F.col("raw"), o)
    parts = parts.select("phrase", "j", "i", clean.alias("query"), removed.alias("removed"), F.when(led, 0).otherwise(1).alias("gap"))
    hits = lookup_top(parts.select("query").distinct(), index, k, mode)
    cost = (F.col("removed") + F.coalesce("edit_distance", F.char_length("query"))).alias("cost")
    log = F.coalesce(hit_score(F.col("count"), count_sum), miss_score(F.greatest(F.char_length("query"), F.lit(1)), count_sum)).alias("log")
    known = parts.join(hits, "query", "left").select("phrase", "j", F.struct("i", F.col("query").alias("part"), F.coalesce("word", "query").alias("word"), cost, "gap", log).alias("p"))
    starts = known.groupBy("phrase", "j").agg(F.array_sort(F.collect_list("p")).alias("p")).groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("j", "p"))).alias("s"))
    best = fold(F.transform(F.col("s"), lambda x: x["p"]), F.lit(reach), o.token)
    split = phrases.join(starts.select("phrase", best.alias("b")), "phrase", "left")
    return split.select("phrase", "b.segmented", "b.corrected", F.col("b.distance").alias("distance_sum"), F.col("b.log").alias("probability_log_sum"))
