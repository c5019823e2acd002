import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import arith, bits, filters, hashing, matching, segment, sequences, tables
from textloom.sources import text as sources
from textloom.streaming import lookup


def variants(w, k, complete=False):
    return {"".join(c for i, c in enumerate(w) if i not in p) for d in range(k + 1) for p in itertools.combinations(range(len(w)), d) if d < len(w) and (complete or p != tuple(range(k)))}


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_variants(spark, k):
    words = ["a", "ab", "abc", "wwwing", "hello", "マダオ", "éàé"]
    df = spark.createDataFrame([(w,) for w in [*words, "", None]], "word string")
    got = {r.word: set(r.e) for r in df.select("word", X.delete_edits("word", k).alias("e")).collect()}
    assert got == {w: variants(w, k) for w in words} | {"": set(), None: set()}


def test_known_samples(spark):
    d = spark.createDataFrame([(w, 100) for w in ("never", "gonna", "let", "you", "down")], "word string, count long")
    index = matching.build_index(d, 1)
    q = spark.createDataFrame([("neer",), ("zzzzz",)], "query string")
    for mode in (matching.FIRST, matching.LAYER, matching.FULL):
        rows = matching.lookup_top(q, index, 2, mode).collect()
        assert [(r.query, r.word, r.edit_distance) for r in rows] == [("neer", "never", 1)]
    assert [r.query for r in matching.lookup_miss(q, index, 2).collect()] == ["zzzzz"]
    p = spark.createDataFrame([("neergonaltyudow",), ("",)], "phrase string")
    best = {r.phrase: r for r in segment.segment(p, index, 1, 5, 500).collect()}
    assert (best["neergonaltyudow"].segmented, best["neergonaltyudow"].corrected, best["neergonaltyudow"].distance_sum) == ("neer gona lt yu dow", "never gonna let you down", 9)
    assert best[""].segmented is None


def test_rank_modes(spark):
    d = spark.createDataFrame([("cat", 50), ("car", 900)], "word string, count long")
    q = spark.createDataFrame([("catr",)], "query string")
    word = lambda mode: matching.lookup_top(q, matching.build_index(d, 2), 2, mode).first().word
    assert (word("first"), word("layer")) == ("cat", "car")


def test_closed_form_and_osa(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 7))) for _ in range(60)}
    df = spark.createDataFrame([(w,) for w in words], "a string")
    got = {(r.a, r.b): r.distance for r in matching.fuzzy_join(df, df.withColumnRenamed("a", "b"), "a", "b", 2, "osa").collect()}
    assert got == {(x, y): X.osa_distance(x, y) for x in words for y in words if X.osa_distance(x, y) <= 2}
    assert (X.osa_distance("bobby", "obbby"), X.osa_distance("ca", "abc"), X.osa_distance("unexpectable", "lovely")) == (1, 3, 10)


def test_counts(spark):
    r = spark.range(1).select(X.binomial(F.lit(6), 2).alias("b"), X.binomial(F.lit(1), 2).alias("z"), X.max_deletes(F.lit(6), 2).alias("m"), X.code_points(F.lit("aé")).alias("c")).first()
    assert (r.b, r.z, r.m, r.c) == (15, 0, 22, [97, 233])


def test_sequences(spark):
    values = [1, 599, 864, 991, 1024, 9999]
    s = sequences.build(spark.createDataFrame([(v,) for v in values], "v long"), "v", "v")
    assert [r.value for r in s.orderBy("ord").collect()] == values
    x = spark.createDataFrame([(v,) for v in (0, 5000, 9999, 10000, 992)], "x long")
    assert {r.x: r.value for r in sequences.next_geq(s, x, 100).collect()} == {0: 1, 5000: 9999, 9999: 9999, 10000: None, 992: 1024}
    assert not sequences.decreasing(s).count()


def test_bits(spark):
    text = "000011100000111100001111"
    b = bits.vector(spark.createDataFrame(list(enumerate(text)), "k int, c string"), F.col("c") == "1", "k")
    assert {r.i: r.rank for r in bits.rank(b, 1).collect()}[16] == 7
    assert {r.i: r.rank for r in bits.rank(b, 0).collect()}[16] == 9
    one, zero = ({r.i: r.pos for r in bits.select(b, k).collect()} for k in (1, 0))
    assert (one[1], one[4], zero[10]) == (4, 12, 16)
    df = spark.createDataFrame([(1, 0xF0, 4), (2, 1, 1), (3, 0x10, 5), (4, 7, 3)], "o int, v long, w int")
    assert bits.pack(df, "o", "v", "w").first().bits == "0000110000111"
    i = spark.createDataFrame([(0,), (24,), (25,)], "i long")
    assert {r.i: r["rank"] for r in bits.rank_at(b, i, strict=False).collect()} == {0: None, 24: 11, 25: None}
    assert bits.rank_at(b, i.where("i = 24")).first()["rank"] == 11 and bits.select_at(b, i.where("i = 0"), strict=False).first().pos is None
    for bad in (bits.rank_at(b, i), bits.select_at(b, i)):
        with pytest.raises(Exception, match=bits.OUT_OF_BOUNDS):
            bad.collect()
    assert {r.bit for r in bits.filled(b, 1).collect()} == {1}
    r = spark.range(1).select(bits.with_range(F.lit("0000000"), 2, F.lit(13), 3).alias("a"), bits.with_range(F.lit("0000"), 2, F.lit(1), 3).alias("b"), bits.bit_text(F.lit(-1), 64).alias("c"), bits.bit_text(F.lit(5), 0).alias("d")).first()
    assert tuple(r) == ("0010100", None, "1" * 64, "")
    r = spark.range(1).select(bits.nth_set_bit(F.lit(5), 1).alias("a"), bits.nth_set_bit(F.lit(5), 1, True).alias("b"), bits.nth_set_bit(F.lit(5), 3).alias("c"), bits.is_set(F.lit(1), 63).alias("s")).first()
    assert (r.a, r.b, r.c, r.s) == (61, 0, None, True)
    assert bits.multiplicative_chain(12, [6, 4]) == [12, 6, 3]


def test_hashing(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(500)], "key string")
    slots = sorted(r.slot for r in hashing.assign(keys).collect())
    assert slots == list(range(500))
    with pytest.raises(hashing.Collision):
        hashing.assign(keys.union(keys.limit(1)))
    assert hashing.Config(97).table_size == 101
    c = hashing.Config(1000)
    assert (c.buckets, c.table_size, c.size, hashing.Config(1000, minimal=True).size, hashing.Config(1000, num_buckets=7).buckets) == (166, 1032, 1032, 1000, 7)
    assert (hashing.Config(10).eps, hashing.Config(10**8).eps) == (1.0, 1024 / 50000)
    assert hashing.bucketed(keys, hashing.Config(500)).count() == 500
    with pytest.raises(hashing.BucketOverflow):
        hashing.bucketed(keys, hashing.Config(500, num_buckets=3, max_bucket=100), "skewed")


def test_filters(spark):
    assert (filters.bloom_bits(7, 0.01), filters.bloom_hashes(7, 0.01)) == (67, 6)
    keys, others = (spark.createDataFrame([(f"{p}{i}",) for i in range(1000)], "key string") for p in "ab")
    f = filters.bloom_build(keys, "key", 1000)
    assert filters.bloom_contains(f, keys, "key", 1000).where("maybe").count() == 1000
    assert filters.bloom_contains(f, others, "key", 1000).where("maybe").count() <= 20
    names = "never gonna run around never gonna run around and never".split()
    e = spark.createDataFrame([(1, i, w) for i, w in enumerate(names)], "g int, i int, w string")
    assert [r.hit for r in filters.lru_hits(e, "g", "i", "w", 4).orderBy("i").collect()] == [False] * 4 + [True] * 4 + [False, False]


def test_arith(spark):
    r = spark.range(1).select(arith.fast_div(F.lit(333), 37).alias("a"), arith.fast_mod(F.lit(96), 37).alias("b"), arith.is_divisible(F.lit(333), 37).alias("c"), arith.log2_ceil(F.lit(1025)).alias("d"), arith.human_bytes(F.lit(2048)).alias("e"), arith.human_time(F.lit(1500)).alias("f")).first()
    assert tuple(r) == (9, 22, True, 11, "2.00 Kb", "1.50 us")


def test_formats(spark):
    """Whole numbers in the first unit, a sign, and the largest units."""
    sizes = [0, 512, 1023, 1024, 1536, 1 << 20, 1 << 50, 5 << 60]
    times = [0, 999, 1000, -1500, 59_999_000_000, 192_000_000_000, 7_200_000_000_000, -7]
    df = spark.createDataFrame(list(enumerate(zip(sizes, times, strict=True))), "i int, x struct<a:long,b:long>")
    rows = df.select("i", arith.human_bytes(F.col("x.a")).alias("a"), arith.human_time(F.col("x.b")).alias("b")).orderBy("i").collect()
    assert [r.a for r in rows] == ["0 b", "512 b", "1023 b", "1.00 Kb", "1.50 Kb", "1.00 Mb", "1.00 Pb", "5120.00 Pb"]
    assert [r.b for r in rows] == ["0 ns", "999 ns", "1.00 us", "-1.50 us", "60.00 sec", "3.20 min", "2.00 hr", "-7 ns"]


def test_bloom_of_variants(spark):
    """A word's filter lets through what meets a bit first, as one that goes from variant to variant does; but there is no such fold."""
    words = ["banana", "aaaaaaaaaaaa", "mississippi", "abcdefghijkl", "ab", "a"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for p in (0.01, 0.3):
        out = df.select("w", X.layered_edits("w", 2, "bloom", p=p).alias("got"), X.layered_edits("w", 2, "none").alias("all"))
        assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
        rows = out.collect()
        hashes = min(6, max(1, math.floor(-math.log(p) / math.log(2))))
        texts = spark.createDataFrame([(e,) for e in {e.edit for r in rows for e in r.all}], "e string")
        known = {r.e: r.h for r in texts.select("e", F.array(*[F.xxhash64(F.lit(h), "e") for h in range(hashes)]).alias("h")).collect()}
        for r in rows:
            want = []
            for d in range(3):
                items, bits = [e.edit for e in r.all if e.d == d], set()
                width = max(math.floor(-max(len(items), 1) * math.log(p) / math.log(2) ** 2), 256)
                for e in items:
                    new = {h % width for h in known[e]} - bits
                    bits |= new
                    want += [(d, e)] if new else []
            assert [tuple(e) for e in r.got] == want


def test_code_points(spark):
    """Every code point, as a built-in gives it: nothing is encoded and printed for each character."""
    points = [c for c in range(1, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    rows = [("".join(map(chr, p)), p) for p in (points[i : i + 5000] for i in range(0, len(points), 5000))] + [("", []), (None, None), ("\0a\0", [0, 97, 0]), ("e\u0301\n", [101, 0x301, 10])]
    df = spark.createDataFrame(rows, "t string, p array<int>").select("p", X.code_points("t").alias("c"))
    assert df.where(~F.col("c").eqNullSafe(F.col("p"))).count() == 0
    assert "encode" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert spark.sql("select unhex('ff61') x").select(X.code_points(F.col("x").cast("string")).alias("c")).first().c is None


def test_times_as_printf(spark):
    """Quotients whose shortest decimal ends in 5 are rounded by their exact value, exact halves to the even digit; also by the SQL name."""
    from textloom.functions.register import register

    register(spark)
    rng = random.Random(9)
    units = [(3_600_000_000_000, "hr"), (60_000_000_000, "min"), (1_000_000_000, "sec"), (1_000_000, "ms"), (1000, "us")]
    times = [1125, -1375, 1005, 2_675_000, -999_995, 999_999, 3_599_999_999_999, (1 << 63) - 1, 7_289_961_000_270_000_000 - 1]
    times += [m * f // 200 + d for f, _ in units for m in (rng.randrange(200, 12_000) for _ in range(40)) for d in (-1, 0, 1)] + [rng.choice((1, -1)) * (rng.randrange(2_000_000) * 200 + 1) * 18_000_000_000 // 200 + 1 for _ in range(100)]

    def want(t):
        factor, unit = next(((f, u) for f, u in units if abs(t) >= f), (1, ""))
        return f"{float(t) / factor:.2f} {unit}" if unit else f"{t} ns"

    rows = spark.createDataFrame([(t,) for t in times], "t long").select("t", arith.human_time(F.col("t")).alias("a"), F.expr("tl_human_time(t)").alias("b")).collect()
    assert all(r.a == r.b == want(r.t) for r in rows)


def test_wide_numbers(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(1 << 63), rng.randrange(2, 1 << 62)) for _ in range(50)] + [((1 << 63) - 1, 2), (0, 3), (1, 1 << 62)]
    df = spark.createDataFrame(rows, "n long, d long")
    for r in df.select("n", "d", arith.magic_number_wide(F.col("d")).alias("m"), arith.mul_high(F.col("n"), F.col("d")).alias("h")).collect():
        assert (int(r.m.hi) << 64) + int(r.m.lo) == ((1 << 128) - 1) // r.d + 1 and int(r.h) == (r.n * r.d) >> 64


def plain_lru(rows, capacity):
    out, recent = [], {}
    for g, o, k in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        held = recent.setdefault(g, [])
        out.append((g, o, k, k in held))
        recent[g] = ([x for x in held if x != k] + [k])[-capacity:]
    return out


@pytest.mark.parametrize("capacity", [1, 3, 50])
def test_lru_over_ranges(spark, capacity):
    """A group that holds most rows and so lies in many ranges, one that is null, and ties."""
    rng = random.Random(capacity)
    rows = [(rng.choice([None, 1, 7, 7, 7, 7, 7, 7]), rng.randrange(400), f"k{rng.randrange(12)}") for _ in range(1500)]
    df = spark.createDataFrame(rows, "g int, o int, k string")
    want = plain_lru(rows, capacity)
    got = [tuple(r) for r in filters.lru_hits(df, "g", "o", "k", capacity).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_lru_stream(spark, tmp_path):
    """Two batches; a group's state goes from one to the next, and rows of a batch come in any order."""
    rng = random.Random(1)
    rows = [(rng.randrange(3), i, f"k{rng.randrange(6)}") for i in range(300)]
    for n, part in enumerate((rows[:150], rows[150:])):
        spark.createDataFrame(rng.sample(part, len(part)), "g int, o int, k string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not n:
            import time

            time.sleep(1.1)  # the source takes the older file first
    stream = spark.readStream.schema("g int, o int, k string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = lookup.lru_stream(stream, "g", "k", "o", 3).writeStream.format("memory").queryName("recent").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.sql("select g, o, k, hit from recent").collect()) == sorted(plain_lru(rows, 3))


def test_lookup_batch(spark, tmp_path):
    index = matching.build_index(spark.createDataFrame([("never", 1)], "word string, count long"), 1)
    spark.createDataFrame([("neer",), ("neer",), ("zzz",)], "query string").write.parquet(str(tmp_path / "in"))
    got = []
    q = spark.readStream.schema("query string").parquet(str(tmp_path / "in")).writeStream.foreachBatch(lookup.lookup_batch(index, lambda hits, i: got.extend((r.query, r.word, i) for r in hits.collect()), 1)).start()
    q.processAllAvailable()
    q.stop()
    assert got == [("neer", "never", 0)]


def test_next_geq_dense(spark):
    """Repeated and dense values, in few and in many ranges."""
    rng = random.Random(2)
    values, probes = [rng.choice([5, 6, 7, 10**12, rng.randrange(3000)]) for _ in range(800)], [rng.randrange(-5, 3100) for _ in range(300)] + [10**12, 10**12 + 1]
    s = sequences.build(spark.createDataFrame([(v,) for v in values], "v long"), "v", "v")
    x = spark.createDataFrame([(v,) for v in probes], "x long")
    for parts in (1, 9, None):
        assert {r.x: r.value for r in sequences.next_geq(s, x, parts).collect()} == {p: min((v for v in values if v >= p), default=None) for p in probes}


@pytest.mark.parametrize("n", [62, 63, 500])
def test_long_words(spark, n):
    """Words beyond any mask of bits are found by themselves and with an edit, and joined."""
    rng = random.Random(n)
    word = "".join(rng.choice("abcdefgh") for _ in range(n))
    near, swapped = word[: n // 2] + "x" + word[n // 2 + 1 :], "yz" + word
    d = spark.createDataFrame([(word, 3), ("other", 9)], "word string, count long")
    q = spark.createDataFrame([(word,), (near,), (word[:-1],)], "query string")
    got = {(r.query, r.word, r.edit_distance, r.delete_distance) for r in matching.lookup_top(q, matching.build_index(d, 1), 1).collect()}
    assert got == {(word, word, 0, 0), (near, word, 1, 1), (word[:-1], word, 1, 0)}
    pairs = matching.fuzzy_join(d, spark.createDataFrame([(near,), (swapped,)], "w string"), "word", "w", 1).collect()
    assert [tuple(r) for r in pairs] == [(word, near, 1)]
    if n < 100:
        df = spark.createDataFrame([(word,)], "word string")
        v = df.select(F.explode(X.delete_variants("word", 2)).alias("v")).select("v.*").collect()
        by_code = [r.edit for r in sorted(v, key=lambda r: (r.d, r.code))]
        by_mask = [c for *_, c in sorted((len(p), sum(1 << (n - 1 - i) for i in p), "".join(c for i, c in enumerate(word) if i not in p)) for k in range(3) for p in itertools.combinations(range(n), k) if p != (0, 1))]
        assert by_code == by_mask


def test_too_long_for_code(spark):
    with pytest.raises(Exception, match="too long for its code"):
        spark.createDataFrame([("a" * 1100,)], "w string").select(F.size(X.delete_variants("w", 6))).collect()


def test_join_names(spark):
    """Columns with any name, nulls, empty texts, repeated rows, and a metric of the caller's."""
    left = spark.createDataFrame([("abc",), ("abc",), (None,), ("",)], "l string")
    right = spark.createDataFrame([("abd",), ("a",), (None,)], "`r` string")
    assert sorted(tuple(r) for r in matching.fuzzy_join(left, right, "l", "r", 1).collect()) == [("", "a", 1), ("abc", "abd", 1)]
    assert matching.fuzzy_join(left, left, "l", "l", 1).columns == ["l", "l_r", "distance"]
    own = matching.fuzzy_join(left, right, "l", "r", 2, lambda a, b: F.levenshtein(a, b) * 2)
    assert sorted(tuple(r) for r in own.collect()) == [("", "a", 2), ("abc", "abd", 2)]


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_join_without_broadcast(spark):
    """Postings aren't sent to all by way of the driver, however small the words that they come from."""
    w = tables.materialised(spark.createDataFrame([("abc", 1), ("abd", 1)], "word string, count long"))
    plan = planned(matching.fuzzy_join(w, w, "word", "word", 2))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("find", [matching.lookup_top, matching.lookup_topk, matching.lookup_all, matching.lookup_miss, matching.probe])
def test_lookup_without_broadcast(spark, find):
    w = tables.materialised(spark.createDataFrame([("abc", 1), ("abd", 1)], "word string, count long"))
    q = tables.materialised(w.select(F.col("word").alias("query")))
    plan = planned(find(q, matching.build_index(w, 2), 2))
    at = plan.index("Generate")
    assert "SortMergeJoin" in plan and "Broadcast" not in plan[plan.index("SortMergeJoin") : at]


def test_osa_expression(spark):
    rng = random.Random(7)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randrange(7))), "".join(rng.choice("abc") for _ in range(rng.randrange(7)))) for _ in range(400)] + [("bobby", "obbby"), ("ca", "abc"), ("unexpectable", "lovely"), ("", ""), (None, "a")]
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", X.osa("a", "b").alias("d"), X.osa_within("a", "b", 2).alias("w")).collect():
        d = None if r.a is None else X.osa_distance(r.a, r.b)
        assert r.d == d and r.w == (d if d is None or d <= 2 else -1)


def test_swap_within_one(spark):
    """Within one edit a swap is told without a table of distances."""
    rows = [("abcd", "abdc"), ("ab", "ba"), ("abcd", "badc"), ("abc", "cba"), ("abc", "bca"), ("abc", "abcde"), ("aab", "aba"), ("マダオ", "ダマオ"), ("ab", "ab"), ("ab", "a"), ("", "ab"), (None, "a")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", X.osa_within("a", "b", 1).alias("w"))
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
    for r in df.collect():
        d = None if r.a is None else X.osa_distance(r.a, r.b)
        assert r.w == (d if d is None or d <= 1 else -1)


def test_sql_names(spark):
    from textloom.functions.register import register

    assert len(register(spark)) == 10
    words = ["a", "ab", "hello", "マダオ", "éa"]
    spark.createDataFrame([(w, len(w)) for w in words], "w string, n long").createOrReplaceTempView("sql_words")
    for r in spark.sql("select w, tl_delete_edits_1(w) e, tl_code_points(w) c, tl_choose(n, 2) b, tl_is_subsequence('hallo a', w) s, tl_starts_with_punctuation(concat('[', w)) p, tl_human_time(n * 70000000000) t, tl_nth_set_bit(n, 1) x from sql_words").collect():
        n = len(r.w)
        assert set(r.e) == variants(r.w, 1) and r.c == [ord(c) for c in r.w] and r.b == n * (n - 1) // 2 and r.p and r.t == f"{n * 70 / 60:.2f} min" and r.x == 64 - n.bit_length()
        assert r.s == (r.w in ("a",))


def test_pointers(spark):
    """A shared object is one; a cycle ends; a null points to nothing."""
    df = spark.createDataFrame([(1, ("x", 1)), (2, ("x", 1)), (3, None), (4, ("y", 2))], "i int, o struct<a:string,b:int>")
    rows, objects = tables.share(df, "o")
    assert objects.count() == 2 and rows.columns == ["i", "ref"]
    assert sorted((r.i, r.o and tuple(r.o)) for r in tables.unshare(rows, objects).collect()) == [(1, ("x", 1)), (2, ("x", 1)), (3, None), (4, ("y", 2))]
    nodes = spark.createDataFrame([(k, k * k) for k in range(6)], "id long, data long")
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 2), (3, 4)], "id long, to long")
    root = spark.createDataFrame([(1,)], "id long")
    assert sorted(r.id for r in tables.reachable(nodes, links, root).collect()) == [0, 1, 2]
    with pytest.raises(tables.InvalidFormat):
        tables.reachable(nodes, links, root, 1)


def test_long_walk(spark):
    """As many steps as the pointers need; null ones lead nowhere."""
    nodes = tables.materialised(spark.range(80))
    links = nodes.where("id < 70").select("id", (F.col("id") + 1).alias("to")).union(nodes.selectExpr("id", "cast(null as long)"))
    assert sorted(r.id for r in tables.reachable(nodes, links, nodes.where("id = 1")).collect()) == list(range(1, 71))


def test_stats_of_empty(spark):
    from textloom.operators import dictionary

    none = spark.createDataFrame([], "word string, count long")
    assert tuple(dictionary.stats(none).first()) == (0, 0, 2, 0, 0, 0, True)
    d = spark.createDataFrame([("abcd", 2), ("ab", 2)], "word string, count long")
    assert tuple(dictionary.stats(d, 2, F.when(F.col("word") == "ab", 2).otherwise(1)).first()) == (4, 4, 2, 4, 4, 5, True)


def test_stored_index(spark, tmp_path):
    d = spark.createDataFrame([("never", 2), ("let", 1)], "word string, count long")
    matching.store_index(matching.build_index(d, 1), "stored_words", 4, str(tmp_path / "i"))
    index = matching.load_index(spark, "stored_words")
    q = spark.createDataFrame([("neer",)], "query string")
    assert [r.word for r in matching.lookup_top(q, index, 1).collect()] == ["never"]
    d.write.mode("overwrite").option("path", str(tmp_path / "n")).saveAsTable("no_index")
    with pytest.raises(tables.InvalidTypeInfo):
        matching.load_index(spark, "no_index")
    spark.sql("drop table stored_words")
    spark.sql("drop table no_index")


def test_work_tables(spark, tmp_path):
    import os

    with tables.scratch(spark):
        path = tables.work_path(spark, "x")
        spark.range(3).write.parquet(path)
        assert os.path.isdir(path.removeprefix("file:").replace("//", "/"))
    assert not os.path.isdir(path.removeprefix("file:").replace("//", "/"))


def test_typed_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], "x")], "a long, b array<int>, c string")
    path = str(tmp_path / "t")
    tables.write_table(df, path)
    assert tables.read_table(spark, path, df.schema).count() == 1
    with pytest.raises(tables.InvalidTypeInfo):
        tables.read_table(spark, path, spark.range(1).schema)
    with pytest.raises(tables.InvalidFormat):
        tables.read_table(spark, str(tmp_path / "none"), df.schema)


def test_text_source(spark, tmp_path):
    (tmp_path / "f.txt").write_text("@D\n# no\nbig apple 12\nx 3\n\n@D_END\n@S\nwrd -> word\nzz ->\n@S_END\n")
    d = sources.dictionary_lines(sources.section(spark, str(tmp_path / "f.txt"), "D"))
    assert [tuple(r) for r in d.collect()] == [("big apple", 12), ("x", 3)]
    assert [tuple(r) for r in sources.pair_lines(sources.section(spark, str(tmp_path / "f.txt"), "S")).collect()] == [("wrd", "word"), ("zz", None)]


def test_stream(spark, tmp_path):
    index = matching.build_index(spark.createDataFrame([("never", 1)], "word string, count long"), 1)
    spark.createDataFrame([("neer",)], "query string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query string").parquet(str(tmp_path / "in"))
    q = lookup.candidates_stream(stream, index, 1).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.word for r in spark.sql("select * from hits").collect()} == {"never"}
