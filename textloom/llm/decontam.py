"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

Index. One pass over the training documents stores a posting (document, position) for every occurrence of a term of the test items. Every task writes a segment sorted by term, document
and position, so that a term's list is a run of rows which the files' statistics find. The list of the term END holds the lengths of the documents.

Phrases. A window is `n` consecutive words of an item (an item of fewer words is one window). The windows' terms are ranked by the lengths of their lists. The list of a window's rarest
term, moved by its offset, gives the places where the window may lie; these are intersected with the list of the second rarest term, and what is left with the lists of all others, of
which only the postings of documents in question are moved: a sieve of a fixed number of bits tells them. Every
intersection is an equi-join on (document, term, position), by which no pair within a list is formed, and Spark shuffles or broadcasts by the sizes it knows: no row carries words.
Places of one item that follow each other on one diagonal (position less place) are a run; runs as long as a window are hits.

Proximity. `proximity` finds items whose `k` rarest terms all occur, in any order, within `slop` positions, from the same lists.

Cases. Null and empty documents have no words, and a row. Items without words or with a null text have no window. A null item_id takes part in hits but has no name in
n_items and items_sha256. Repeated items count once by id. Repeated rows get a row each. Rows of one doc_id with different texts are judged apart. A very long document is many postings,
which are dealt out by position as well. Without documents there is no row, without items no hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import fresh, load, written

#: A-Z are letters of the words and become a-z.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands before and behind a text's words; no word is empty. Its number among the terms is 0.
END = ""
KEY = ["doc_id", "h"]
#: 2 to this power are the bits of the sieve of documents: 8 MB in 2^18 rows at most.
FILTER_BITS = 24


def lowered(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() is quick, and the same where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def framed(text: Column) -> Column:
    """The words of a text between an END before and an END behind: its k-th word (from 0) is element k + 1."""
    return F.split(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), BREAK)


def words_of(text: Column) -> Column:
    return F.filter(framed(text), lambda w: w != END)


def item_table(items: DataFrame) -> DataFrame:
    """items: item_id, text -> k (a number of its own), item_id, words; one row for equal ids and words, none without words."""
    found = items.select("item_id", F.transform(words_of(F.col("text")), lowered).alias("words")).where(F.size("words") > 0).distinct()
    return written(found.withColumn("k", F.monotonically_increasing_id()), "bench-items")


def term_table(items: DataFrame) -> DataFrame:
    """(term, id) of the items' words, and END with 0, which no row of Python's gives: that would start Python processes beside the executors, and they stay."""
    terms = items.select(F.explode("words").alias("term")).distinct().withColumn("id", F.monotonically_increasing_id() + 1)
    end = items.sparkSession.range(1).select(F.lit(END).alias("term"), "id")
    return written(terms.union(end), "bench-terms")


def store_postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """docs: doc_id, text; terms: term, id -> the stored index (doc_id, h, id, pos); h is a hash of the text. A document's posting of END stands at the number of its words."""
    words = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(framed(F.col("text"))).alias("place", "w")).where("place > 0")
    found = words.select(*KEY, (F.col("place") - 1).alias("pos"), lowered(F.col("w")).alias("term")).join(terms, "term").select(*KEY, "id", "pos")
    return written(found.sortWithinPartitions("id", *KEY, "pos"), "postings")


def places_of(items: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """(k, i, id, uses): the i-th word (from 0) of each item and the length of its list."""
    uses = index.where("id > 0").groupBy("id").agg(F.count("*").alias("uses"))
    at = items.select("k", F.posexplode("words").alias("i", "term")).join(terms, "term").join(uses, "id", "left")
    return written(at.select("k", "i", "id", F.coalesce("uses", F.lit(0)).alias("uses")), "bench-places")


def windows_of(places: DataFrame, n: int) -> DataFrame:
    """(k, s, need, i1, id1, i2, id2): a window of `need` words from place s of item k, and the places and terms of its two shortest lists; only one if need is 1."""
    item = W.Window.partitionBy("k").orderBy("i")
    ranked = F.array_sort(F.collect_list(F.struct("uses", "i", "id")).over(item.rowsBetween(0, n - 1)))
    at = places.withColumn("length", F.count("*").over(W.Window.partitionBy("k"))).withColumn("l", ranked).where((F.col("i") == 0) | (F.col("i") <= F.col("length") - n))
    first, second = F.get("l", F.lit(0)), F.get("l", F.lit(1))
    return at.select("k", F.col("i").alias("s"), F.least(F.lit(n), F.col("length")).cast("int").alias("need"), first["i"].alias("i1"), first["id"].alias("id1"), second["i"].alias("i2"), second["id"].alias("id2"))


def intersect(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of wanted (doc_id, h, id, pos and others) that have a posting."""
    w, p = wanted.alias("w"), index.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("id").alias("t"), F.col("pos").alias("q")).alias("p")
    return w.join(p, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.col("id") == F.col("t")) & (F.col("pos") == F.col("q")), "left_semi")


def of_documents(index: DataFrame, docs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The postings of docs (doc_id, h) and, as a sieve of 2^bits bits lets some through, a few others. The sieve has 2^(bits - 6) rows of 64 bits at most, however many documents there
    are, so it is broadcast; if nearly all documents are wanted it merely keeps all."""
    place = F.xxhash64(*KEY).bitwiseAND((1 << bits) - 1)
    row, bit = F.shiftright(place, 6), place.bitwiseAND(63).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    sieve = docs.select(row.alias("row"), one.alias("one")).groupBy("row").agg(F.bit_or("one").alias("mask"))
    return index.withColumn("row", row).withColumn("one", one).join(F.broadcast(sieve), "row").where(F.col("mask").bitwiseAND(F.col("one")) != 0).select(*KEY, "id", "pos")


def phrases(index: DataFrame, items: DataFrame, terms: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, h, item_id, from, to): every longest run of words, of a window's length at least, that an item and a document share."""
    places = places_of(items, terms, index)
    windows = written(windows_of(places, n), "bench-windows")
    rare = windows.select("k", "i1", "id1", "i2", "id2").distinct()
    began = index.join(rare, F.col("id") == F.col("id1")).select(*KEY, "k", (F.col("pos") - F.col("i1")).alias("diagonal"), "i1", "i2", "id2")
    alone = began.where("id2 is null").select(*KEY, "k", "diagonal", "i1", "i2")
    two = began.where("id2 is not null").select(*KEY, "k", "diagonal", "i1", "i2", F.col("id2").alias("id"), (F.col("diagonal") + F.col("i2")).alias("pos")).where("pos >= 0").distinct()
    second = index.join(windows.select(F.col("id2").alias("id")).distinct(), "id", "left_semi")
    kept = written(intersect(two, second).select(*KEY, "k", "diagonal", "i1", "i2").unionByName(alone), "bench-met")
    spread = kept.join(windows, (kept["k"] == windows["k"]) & (kept["i1"] == windows["i1"]) & kept["i2"].eqNullSafe(windows["i2"])).select(*KEY, kept["k"], "diagonal", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("need") - 1)).alias("i")).distinct()
    wanted = spread.join(places.select("k", "i", "id"), ["k", "i"]).withColumn("pos", F.col("diagonal") + F.col("i"))
    order = W.Window.partitionBy(*KEY, "k", "diagonal").orderBy("i")
    runs = intersect(wanted, of_documents(index.where("id > 0"), kept)).select(*KEY, "k", "diagonal", "i").withColumn("run", F.col("i") - F.row_number().over(order))
    runs = runs.groupBy(*KEY, "k", "diagonal", "run").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    named = runs.join(items.select("k", "item_id", F.least(F.lit(n), F.size("words")).alias("need")), "k").where(F.col("b") - F.col("a") + 1 >= F.col("need"))
    return named.select(*KEY, "item_id", (F.col("diagonal") + F.col("a")).alias("from"), (F.col("diagonal") + F.col("b")).alias("to"))


def near(index: DataFrame, items: DataFrame, terms: DataFrame, slop: int = 20, k: int = 3) -> DataFrame:
    """(doc_id, h, item_id, pos): places of one of the k rarest terms of an item (all, if it has fewer) from which the others occur within slop positions, in any order."""
    places = places_of(items, terms, index).select("k", "id", "uses").distinct().join(terms, "id")
    order = W.Window.partitionBy("k").orderBy("uses", "term")
    rare = places.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    rare = written(rare.select("k", "id", F.count("*").over(W.Window.partitionBy("k")).alias("wanted")), "bench-rare")
    ahead = W.Window.partitionBy(*KEY, "k").orderBy("pos").rangeBetween(0, slop)
    seen = index.join(rare, "id").withColumn("seen", F.size(F.collect_set("id").over(ahead)))
    return seen.where("seen = wanted").join(items.select("k", "item_id"), "k").select(*KEY, "item_id", "pos").distinct()


def proximity(docs: DataFrame, items: DataFrame, slop: int = 20, k: int = 3) -> DataFrame:
    """(doc_id, item_id, pos) of `near`, for documents (doc_id, text) and items (item_id, text)."""
    known = item_table(items)
    terms = term_table(known)
    return near(store_postings(docs, terms), known, terms, slop, k).select("doc_id", "item_id", "pos").distinct()


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, slop: int | None = None, k: int = 3) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with slop also n_near, the number of items whose k rarest terms occur within slop positions."""
    known = item_table(items)
    terms = term_table(known)
    index = store_postings(docs, terms)
    spans = written(phrases(index, known, terms, n), "bench-spans")
    # distinct hit words: spans that touch or overlap are merged by a running maximum, so no word is listed
    order = W.Window.partitionBy(*KEY).orderBy("from", "to")
    top = F.coalesce(F.max("to").over(order.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(-1))
    new = F.greatest(F.col("to") - F.greatest(F.col("from") - 1, top), F.lit(0))
    none = F.lit(None).cast("string")
    rows = spans.select(*KEY, "from", "to").distinct().select(*KEY, new.alias("new"), none.alias("item"), none.alias("close"))
    rows = rows.unionByName(spans.select(*KEY, F.lit(0).alias("new"), F.col("item_id").cast("string").alias("item"), none.alias("close")).distinct())
    if slop is not None:
        rows = rows.unionByName(near(index, known, terms, slop, k).select(*KEY, F.lit(0).alias("new"), none.alias("item"), F.col("item_id").cast("string").alias("close")).distinct())
    per = rows.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"), F.count_distinct("close").alias("n_near"))
    out = index.where("id = 0").join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    names = F.coalesce("items", F.array().cast("array<string>"))
    more = [F.coalesce("n_near", F.lit(0)).alias("n_near")] * (slop is not None)
    return out.select(*KEY, F.col("pos").cast("long").alias("n_words"), hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), *more)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without a hit, with the columns of docs."""
    d, h = fresh(docs, "dirty_id", "dirty_text")
    dirty = contamination(docs.select("doc_id", "text"), load(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias(d), F.col("h").alias(h)).distinct()
    return docs.join(dirty, docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h)), "left_anti")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark").select("item_id", "text"), slop=20).drop("h")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s + 1 : s + least(10, len(w))], ' ') AS g FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
p AS (SELECT r, w, unnest(range(0, len(w))) AS s FROM d),
m AS (SELECT p.r, p.s, win.n, win.item_id FROM p, lens, win WHERE p.s + lens.n <= len(p.w) AND win.n = lens.n AND win.g = array_to_string(p.w[p.s + 1 : p.s + lens.n], ' ')),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS q FROM m) GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM m GROUP BY r),
-- proximity: the three rarest terms of an item within 20 positions
o AS (SELECT r, s, w[s + 1] AS t FROM p),
f AS (SELECT t, count(*) AS uses FROM o GROUP BY t),
bt AS (SELECT DISTINCT k, item_id, t FROM (SELECT row_number() OVER () AS k, item_id, unnest(w) AS t FROM (SELECT DISTINCT item_id, w FROM b))),
rare AS (SELECT k, item_id, t, count(*) OVER (PARTITION BY k) AS wanted FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY coalesce(uses, 0), t) AS rank FROM bt LEFT JOIN f USING (t)) WHERE rank <= 3),
z AS (SELECT r, s, t, k, item_id, wanted FROM o JOIN rare USING (t)),
near AS (SELECT DISTINCT r, item_id FROM (SELECT a.r, a.item_id, a.wanted, count(DISTINCT c.t) AS seen FROM z a JOIN z c ON a.r = c.r AND a.k = c.k AND c.s BETWEEN a.s AND a.s + 20 GROUP BY a.r, a.k, a.item_id, a.s, a.wanted) WHERE seen = wanted),
c AS (SELECT r, count(DISTINCT item_id) AS n_near FROM near GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r) LEFT JOIN c USING (r)
"""
