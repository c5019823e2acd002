"""Bit vectors as rows (pos, bit): rank, select, next; and bits of integers and of '01' texts, most significant first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .tables import numbered, running


#: In the message of the error that a place outside of the vector raises.
OUT_OF_BOUNDS = "OutOfBounds"


def vector(df: DataFrame, bit: Column, *order: str) -> DataFrame:
    """(pos, bit) from 0 in the given order."""
    return numbered(df.select(*order, bit.cast("int").alias("bit")), *order, name="pos").select("pos", "bit")


def rank(bits: DataFrame, one: int = 1) -> DataFrame:
    """(i, rank): how many of the first i bits equal `one`, for i from 1 to the length."""
    hit = bits.select("pos", (F.col("bit") == one).cast("long").alias("hit"))
    return running(hit, "pos", "hit", "rank").select((F.col("pos") + 1).alias("i"), "rank")


def select(bits: DataFrame, one: int = 1) -> DataFrame:
    """(i, pos): the position of the i-th bit that equals `one`, i from 1."""
    return rank(bits, one).join(bits.where(F.col("bit") == one).select((F.col("pos") + 1).alias("i")), "i").select(F.col("rank").alias("i"), (F.col("i") - 1).alias("pos"))


def checked(found: DataFrame, asked: str, value: str) -> DataFrame:
    """found, but a row without a value raises an error."""
    miss = F.raise_error(F.concat(F.lit(f"{OUT_OF_BOUNDS}: "), F.col(asked).cast("string")))
    return found.withColumn(value, F.when(F.col(value).isNotNull(), F.col(value)).otherwise(miss))


def rank_at(bits: DataFrame, asked: DataFrame, one: int = 1, strict: bool = True) -> DataFrame:
    """asked: i -> i, rank; an i outside of 1 to the length raises an error, or without strict gives null."""
    found = asked.select(F.col("i").cast("long").alias("i")).join(rank(bits, one), "i", "left").select("i", "rank")
    return checked(found, "i", "rank") if strict else found


def select_at(bits: DataFrame, asked: DataFrame, one: int = 1, strict: bool = True) -> DataFrame:
    """asked: i -> i, pos; an i outside of 1 to the number of such bits raises an error, or without strict gives null."""
    found = asked.select(F.col("i").cast("long").alias("i")).join(select(bits, one), "i", "left").select("i", "pos")
    return checked(found, "i", "pos") if strict else found


def filled(bits: DataFrame, one: int) -> DataFrame:
    """All bits set, or cleared."""
    return bits.select("pos", F.lit(one).alias("bit"))


def next_bit(bits: DataFrame, starts: DataFrame, one: int = 1) -> DataFrame:
    """starts: start -> start, pos: the first position at or behind start with that bit, or null."""
    from .sequences import next_geq

    found = next_geq(bits.where(F.col("bit") == one).select(F.col("pos").alias("value")), starts.select(F.col("start").cast("long").alias("x")))
    return found.select(F.col("x").alias("start"), F.col("value").alias("pos"))


def bit_text(value: Column | str, width: Column | int) -> Column:
    """The low `width` bits of a number, up to 64; none for width 0."""
    v = (F.col(value) if isinstance(value, str) else value).cast("long")
    w = F.lit(width) if isinstance(width, int) else width
    return F.right(F.lpad(F.bin(v), 64, "0"), w)


def pack(df: DataFrame, order: str, value: str, width: str | int, by: list[str] | None = None) -> DataFrame:
    """Numbers appended to one text of bits a group, in order; a group is a row of its result and must fit one."""
    keys = by or []
    bits = bit_text(value, width if isinstance(width, int) else F.col(width))
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), bits.alias("b")))).alias("l"))
    return grouped.select(*keys, F.array_join(F.transform("l", lambda x: x["b"]), "").alias("bits"))


def with_range(bits: Column | str, at: Column | int, value: Column | str, width: Column | int) -> Column:
    """A text of bits with the low `width` bits of value in place of those from position `at` (from 0); null if they pass its end."""
    b = F.col(bits) if isinstance(bits, str) else bits
    a, w = (F.lit(x) if isinstance(x, int) else x for x in (at, width))
    return F.when((a >= 0) & (a + w <= F.char_length(b)), F.concat(F.substr(b, F.lit(1), a), bit_text(value, w), F.substr(b, a + w + 1)))


def unpack(bits: Column | str, at: Column | int, width: Column | int) -> Column:
    """The number of `width` bits at position `at` (from 0); null beyond the end."""
    b = F.col(bits) if isinstance(bits, str) else bits
    a, w = (F.lit(x) if isinstance(x, int) else x for x in (at, width))
    return F.when((a >= 0) & (a + w <= F.char_length(b)), F.conv(F.substr(b, a + 1, w), 2, 10).cast("long"))


def is_set(word: Column | str, i: Column | int) -> Column:
    """Bit i of a 64-bit word, the most significant being 0."""
    w = (F.col(word) if isinstance(word, str) else word).cast("long")
    return F.getbit(w, F.lit(63) - i) == 1


def with_bit(word: Column | str, i: int, on: bool) -> Column:
    w = (F.col(word) if isinstance(word, str) else word).cast("long")
    mask = 1 << (63 - i)
    mask -= (mask >> 63) << 64
    return w.bitwiseOR(F.lit(mask)) if on else w.bitwiseAND(F.lit(~mask))


def nth_set_bit(word: Column | str, n: Column | int, lsb: bool = False) -> Column:
    """Position of the n-th set bit (from 1) of a 64-bit word, counted from the most, or least, significant; null if there is none."""
    w = (F.col(word) if isinstance(word, str) else word).cast("long")
    n = F.lit(n) if isinstance(n, int) else n
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(w, i if lsb else F.lit(63) - i) == 1)
    return F.when(n >= 1, F.get(places, n - 1))


def shift_left(value: Column | str, n: Column | str) -> Column:
    """0 where n is 64 or more."""
    v, m = (F.col(x) if isinstance(x, str) else x for x in (value, n))
    return F.when(m >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", v, m.cast("int")))


def multiplicative_chain(first: int, hints: list[int]) -> list[int]:
    """The largest value up to `first` that is divided by ever smaller ones near the hints: each is the last one over a whole number."""
    for top in range(first, 0, -1):
        chain = [top]
        for hint in hints:
            fits = [d for d in range(min(hint, chain[-1]), 0, -1) if chain[-1] % d == 0]
            if not fits or (fits[0] == 1 and hint > 1):
                break
            chain.append(fits[0])
        else:
            return chain
    raise LookupError("no chain")
