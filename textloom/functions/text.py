"""Column functions: deletions of a word, distances, counts of them."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How variants are freed of repetitions within each number of deletions: not at all, exactly, by a Bloom filter (which loses a few), or by the variants met last (which keeps a few twice).
DEDUPS = ("none", "hash", "bloom", "lru")
#: Bits of a variant's code.
CODE_BITS = 60


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def place_bits(k: int) -> int:
    """Bits for each deleted position in a code of at most k of them."""
    return CODE_BITS // max(k, 1)


def one_less(n: Column, depth: int, bits: int) -> Callable[[Column], Column]:
    """From a variant with `depth` deletions to all with one more, behind its last; positions count from 1 in the whole word of n characters."""
    top = 1 << bits

    def cut(e: Column, p: Column) -> Column:
        return F.concat(F.substr(e["edit"], F.lit(1), p - 1 - depth), F.substr(e["edit"], p + 1 - depth))

    def without(e: Column) -> Column:
        places = F.when(e["last"] < n, F.sequence(e["last"] + 1, n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda p: F.struct(cut(e, p).alias("edit"), p.alias("last"), F.lit(depth + 1).alias("d"), (e["code"] * top + (top - 1 - p)).alias("code")))

    return without


def delete_variants(word: Column | str, k: int, complete: bool = False) -> Column:
    """array<struct<edit, d, code>>: the word without each set P of at most k positions, never empty. d is the size of P, and code holds P's positions in ascending order, each
    as what it lacks to the largest, so that (d, code) is the order of generation: deletions at the end come first. Without `complete` the set of the first k positions is left out, as it always
    has been: the segmentation of known samples depends on it. One string can come by several sets. Null gives an empty array. The length of words is bounded by the code alone: over
    a million characters for k up to 3, 32,766 for 4, 4,094 for 5; a longer word raises an error."""
    w = col(word)
    n = F.char_length(w)
    bits = place_bits(k)
    layer = F.array(F.struct(w.alias("edit"), F.lit(0).alias("last"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("code")))
    layers = [layer]
    for depth in range(k):
        layer = F.flatten(F.transform(layer, one_less(n, depth, bits)))
        layers.append(layer)
    every = reduce(lambda a, b: F.concat(a, b), layers)
    first = reduce(lambda code, p: (code << bits) + (1 << bits) - 1 - p, range(1, k + 1), 0)
    kept = F.filter(every, lambda e: (e["edit"] != "") & (F.lit(complete) | (e["d"] != k) | (e["code"] != first)))
    out = F.transform(kept, lambda e: F.struct(e["edit"].alias("edit"), e["d"].alias("d"), e["code"].alias("code")))
    if bits < 31:
        out = F.when(n < (1 << bits) - 1, out).otherwise(F.raise_error(F.concat(F.lit("too long for its code: "), F.substr(w, F.lit(1), F.lit(40)))))
    return F.when(n > 0, out).otherwise(F.array().cast("array<struct<edit:string,d:int,code:bigint>>"))


def delete_edits(word: Column | str, k: int, complete: bool = False) -> Column:
    """The distinct strings of delete_variants."""
    return F.array_distinct(F.transform(delete_variants(word, k, complete), lambda e: e["edit"]))


def without_recent(items: Column, capacity: int) -> Column:
    """An array of strings without those that are among the `capacity` distinct ones met last; meeting one again makes it the last."""
    start = F.struct(F.array().cast("array<string>").alias("recent"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        recent = F.slice(F.concat(F.array(x), F.filter(s["recent"], lambda y: y != x)), 1, capacity)
        return F.struct(recent.alias("recent"), F.when(F.array_contains(s["recent"], x), s["out"]).otherwise(F.concat(s["out"], F.array(x))).alias("out"))

    return F.aggregate(items, start, step, lambda s: s["out"])


def without_bloom(items: Column, p: float, least_bits: int = 256, most_hashes: int = 6) -> Column:
    """An array of strings without those that a Bloom filter of the ones before takes for known: all repetitions, and others at a rate of about p."""
    hashes = min(most_hashes, max(1, math.floor(-math.log(p) / math.log(2))))
    top = 1 << 31

    def width(x: Column) -> Column:
        n = F.greatest(F.size(x), F.lit(1)).cast("double")
        return F.greatest(F.floor(-n * math.log(p) / math.log(2) ** 2), F.lit(least_bits)).cast("long")

    # an item that the filter takes for known sets no new bit, so that the filter has the bits of all items before, and lets through those that meet a bit first; each transform of
    # a single struct keeps what the next one needs, as it would be computed anew for each item
    a = F.transform(F.array(items), lambda x: F.struct(x.alias("x"), width(x).alias("bits")))
    a = F.transform(a, lambda s: F.struct(s["x"].alias("x"), F.array_sort(F.flatten(F.transform(s["x"], lambda x, i: F.array(*[F.pmod(F.xxhash64(F.lit(h), x), s["bits"]) * top + i for h in range(hashes)])))).alias("met")))
    first = lambda met: F.filter(met, lambda v, i: (i == 0) | (F.shiftright(v, 31) != F.shiftright(F.get(met, i - 1), 31)))
    a = F.transform(a, lambda s: F.struct(s["x"].alias("x"), F.array_sort(F.array_distinct(F.transform(first(s["met"]), lambda v: v.bitwiseAND(top - 1).cast("int")))).alias("let")))
    return F.get(F.transform(a, lambda s: F.transform(s["let"], lambda i: F.get(s["x"], i))), F.lit(0))


def layered_edits(word: Column | str, k: int, dedup: str = "hash", capacity: int = 32, p: float = 0.01) -> Column:
    """array<struct<d, edit>>: the strings of delete_variants by number of deletions, in the order of generation; repetitions within a number go as `dedup` says (capacity for lru, p for bloom)."""
    if dedup not in DEDUPS:
        raise ValueError(f"{dedup}: not one of {DEDUPS}")
    clean = {"none": lambda a: a, "hash": F.array_distinct, "bloom": lambda a: without_bloom(a, p), "lru": lambda a: without_recent(a, capacity)}[dedup]

    def layer(every: Column, d: int) -> Column:
        own = F.transform(F.filter(every, lambda e: e["d"] == d), lambda e: e["edit"])
        return F.transform(clean(own), lambda e: F.struct(F.lit(d).alias("d"), e.alias("edit")))

    # sorted once for all layers: the transform of a single array keeps what each of them would compute anew
    every = F.array_sort(F.transform(delete_variants(word, k), lambda e: F.struct(e["d"].alias("d"), e["code"].alias("code"), e["edit"].alias("edit"))))
    return F.get(F.transform(F.array(every), lambda every: F.concat(*[layer(every, d) for d in range(k + 1)])), F.lit(0))


def next_permutation(items: Column | str) -> Column:
    """The next larger arrangement of an array's items; null for the last one, and for arrays of fewer than two."""
    a = col(items)
    n = F.size(a)
    rises = F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.element_at(a, i) < F.element_at(a, i + 1))
    i = F.when(n >= 2, F.array_max(rises))
    pivot = F.element_at(a, i)
    j = F.array_max(F.filter(F.sequence(i + 1, n), lambda x: F.element_at(a, x) > pivot))
    tail = F.transform(F.slice(a, i + 1, n), lambda x, at: F.when(at + i + 1 == j, pivot).otherwise(x))
    return F.when(i.isNotNull(), F.concat(F.slice(a, F.lit(1), i - 1), F.array(F.element_at(a, j)), F.reverse(tail)))


def deep_bytes(df_schema: T.StructType) -> Column:
    """Bytes of a row's values: texts and binaries by their length, other types by their width; nulls none. Nested values are measured in their JSON form."""
    widths = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8}
    parts = []
    for f in df_schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(c)
        elif type(f.dataType) in widths:
            size = F.lit(widths[type(f.dataType)])
        else:
            size = F.octet_length(F.to_json(F.struct(c)))
        parts.append(F.when(c.isNull(), 0).otherwise(size).cast("long"))
    return reduce(lambda a, b: a + b, parts, F.lit(0).cast("long"))


def random_text(key: Column | str, length: int, seed: int = 0) -> Column:
    """A text of letters and digits that depends on key and seed alone."""
    letters = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))
    return F.concat(*[F.substr(F.lit(letters), F.pmod(F.xxhash64(F.lit(seed), F.lit(i), col(key)), F.lit(62)).cast("int") + 1, F.lit(1)) for i in range(length)])


def binomial(n: Column | str, k: int) -> Column:
    """C(n, k), 0 where k is larger."""
    n = col(n).cast("long")
    out = F.lit(1).cast("long")
    for i in range(k):
        out = F.floor((out * (n - i)).cast("decimal(38,0)") / (i + 1)).cast("long")
    return F.when(n < k, F.lit(0).cast("long")).otherwise(out)


def max_deletes(n: Column | str, d: int) -> Column:
    return reduce(lambda a, b: a + b, (binomial(n, i) for i in range(d + 1)))


def is_subsequence(text: Column | str, part: Column | str) -> Column:
    """Whether part's characters come in text in their order."""
    t, p = col(text), col(part)
    chars = F.filter(F.split(t, ""), lambda c: c != "")
    got = F.aggregate(chars, F.lit(0), lambda at, c: F.when(F.substr(p, at + 1, F.lit(1)) == c, at + 1).otherwise(at))
    return got >= F.char_length(p)


def code_points(text: Column | str) -> Column:
    """array<int> of a text's code points; null where it isn't UTF-8."""
    t = F.try_validate_utf8(col(text))
    each = F.transform(F.split(t, ""), F.ascii)  # a text's first code point, of any size
    return F.when(F.char_length(t) == 0, F.array().cast("array<int>")).otherwise(each)


def levenshtein(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(col(a), col(b))


def osa_distance(a: str, b: str) -> int:
    """Edits and swaps of neighbours, no part of a text being edited twice."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            best = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before = above
    return row[-1]


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def osa(a: Column | str, b: Column | str) -> Column:
    """osa_distance as an expression: a row of the table of distances for each character of a, from the two rows before."""
    y = characters(col(b))
    zero = F.sequence(F.lit(0), F.size(y))
    # b's characters are carried along: a step would split b anew
    start = F.struct(y.alias("y"), zero.alias("before"), zero.alias("above"), F.lit("").alias("last"), F.lit(0).alias("i"))

    def next_row(s: Column, c: Column) -> Column:
        def cell(row: Column, own: Column, j: Column) -> Column:
            """j: place of b's character from 0; row has the cells up to it."""
            best = F.least(F.get(s["above"], j + 1) + 1, F.element_at(row, -1) + 1, F.get(s["above"], j) + (own != c).cast("int"))
            swap = (s["i"] > 0) & (j > 0) & (F.get(s["y"], j - 1) == c) & (s["last"] == own)
            return F.concat(row, F.array(F.when(swap, F.least(best, F.get(s["before"], j - 1) + 1)).otherwise(best)))

        row = F.aggregate(s["y"], F.array(s["i"] + 1), lambda r, own: cell(r, own, F.size(r) - 1))
        return F.struct(s["y"].alias("y"), s["above"].alias("before"), row.alias("above"), c.alias("last"), (s["i"] + 1).alias("i"))

    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.aggregate(characters(col(a)), start, next_row, lambda s: F.element_at(s["above"], -1)))


def is_swap(a: Column, b: Column) -> Column:
    """Whether two texts of one length are the same but for a swap of neighbours, the first of which is where they begin to differ."""
    p = F.array_position(F.zip_with(characters(a), characters(b), lambda x, y: x != y), True).cast("int")
    piece = lambda at, n: F.substr(a, at, n)
    # the place is kept by the transform of a single number
    swapped = F.transform(F.array(p), lambda p: F.concat(piece(F.lit(1), p - 1), piece(p + 1, F.lit(1)), piece(p, F.lit(1)), F.substr(a, p + 2)))
    return F.get(swapped, F.lit(0)) == b


def osa_within(a: Column | str, b: Column | str, k: int) -> Column:
    """osa up to k, else -1. It is at most the Levenshtein distance and at least half of it; where that is 2 it is 1 for a swap and else 2, so only pairs of 3 and more need the table."""
    a, b = col(a), col(b)
    lev = F.levenshtein(a, b, 2 * k)
    exact = F.when(lev < 2, lev).when(lev == 2, F.when((F.char_length(a) == F.char_length(b)) & is_swap(a, b), 1).otherwise(2))
    if k > 1:
        exact = exact.when(lev > 2, osa(a, b))
    return F.when(exact <= k, exact).when(exact.isNotNull(), F.lit(-1))


def starts_with_any(text: Column | str, marks: list[str]) -> Column:
    """Bytes of the first mark that text begins with, or 0."""
    t = col(text)
    return reduce(lambda rest, m: F.when(t.startswith(m), F.lit(len(m.encode()))).otherwise(rest), reversed(marks), F.lit(0))
