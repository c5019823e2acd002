"""MinHash near-duplicates by a multi-index Hamming join.

Signature. `SYMBOLS` = 50 MinHash values of a text's set of word 4-shingles, each cut to 16 bits. The Hamming distance counts differing symbols.

Join. The symbols are split into CHUNKS = 10 chunks of 5. With at most D = 2 * CHUNKS - 1 = 19 differing symbols some chunk has at most one (pigeonhole), so the
allowed errors of a chunk are enumerated by leaving out each of its symbols in turn: 50 keys a signature, and any two signatures within D share a key. Pairs of similarity
0.8 differ in 10 symbols on average; the chance that none of the 50 keys is shared is 0.263^10, under 2 in a million, and falls fast above.

Links. Equal sets are one class from the start. A bucket (the classes of a key) is never paired off as a whole: first each class meets the bucket's least
and most central ones, candidates within FAR symbols are confirmed on full sets, and components are formed. What is left are buckets, of whatever size, that hold several components.
Their classes are sifted by a bound that holds for every link: with 5 * intersection >= 4 * union two sets share one of their rarest fifth of shingles. So each open class lists that
fifth by how many open classes have them, and classes of different components that share one are confirmed on full sets. No link between components is lost by this, and
pairs inside one component cannot change it. A bucket of more than SALT classes is dealt out in pieces of about that many wherever its rows would come together.

Cases. Null, empty and wordless texts have no shingle, no link, and are components of their own. Repeated rows get a row each. A null doc_id cannot name a
component: such a row has component_id null and kept true and takes no part in links. Rows of one doc_id with different texts are judged each on its own text.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import LOWER, NOT_SPACE, chunks, load, mix, word_hashes, word_spans, written

SYMBOLS, CHUNK, SHINGLE = 50, 5, 4
CHUNKS = SYMBOLS // CHUNK
LONGS = -(-SYMBOLS // 4)
#: Symbols that may differ in a candidate: five deviations beyond similarity 0.8.
FAR = 24
#: Classes of a bucket that one piece of it holds.
SALT = 256
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
SIG = [f"s{i}" for i in range(LONGS)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each text."""
    data = LOWER[data]
    starts, ends, at = word_spans(data, offsets, NOT_SPACE)
    words = word_hashes(data, starts, ends)
    full = np.zeros(0, np.uint64)
    if len(words) >= n:
        full = mix(functools.reduce(operator.add, (words[k : len(words) - n + 1 + k] * _MUL[k] for k in range(n))))
    out = []
    for i in range(len(at) - 1):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= n:
            h = np.sort(full[a : b - n + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif b > a:  # the whole sequence is the one shingle; its length keeps it apart from shingles of n words
            out.append(mix(functools.reduce(operator.add, (words[a + k : a + k + 1] * _MUL[k] for k in range(b - a))) + np.uint64(b - a)))
        else:
            out.append(full[:0])
    return out


def signature(h: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit symbols, packed in LONGS longs."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max)
    for at in range(0, len(h), 2048):
        np.minimum(least, ((h[at : at + 2048] * _A[:, None]) ^ _B[:, None]).min(axis=1), out=least)
    symbols = np.zeros(LONGS * 4, np.uint16)
    symbols[:SYMBOLS] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return symbols.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text -> doc_id, n_shingles, hi, lo (128 bits of the set; 0 without shingles), the signature's longs."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in chunks(batch, "text"):
                sets = shingle_sets(data, offsets)
                sig = np.stack([signature(h) for h in sets])
                hi = [np.bitwise_xor.reduce(mix(h)) ^ np.uint64(len(h)) if len(h) else 0 for h in sets]
                lo = [np.add.reduce(mix(h * _MUL[1])) + np.uint64(len(h)) if len(h) else 0 for h in sets]
                number = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows].cast(pa.int64()), pa.array([len(h) for h in sets], pa.int64()), number(hi), number(lo), *(pa.array(sig[:, k]) for k in range(sig.shape[1]))], ["doc_id", "n_shingles", "hi", "lo", *SIG])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long, " + ", ".join(f"{s} long" for s in SIG))


def keys_of() -> F.Column:
    """The 50 keys of a signature: a chunk without one of its symbols."""
    symbol = lambda k: F.shiftright(F.col(SIG[k // 4]), 16 * (k % 4)).bitwiseAND(0xFFFF)
    return F.array(*[F.xxhash64(F.lit(c * CHUNK + skip), *[symbol(c * CHUNK + k) for k in range(CHUNK) if k != skip]) for c in range(CHUNKS) for skip in range(CHUNK)])


def distance(a: str, b: str) -> F.Column:
    """Differing symbols of two signatures: 16-bit lanes of the xor that aren't 0. Adding 7FFF to a lane's low bits carries into its high bit unless they are 0; the
    upper two lanes are shifted down first, so that no sum overflows."""
    total = F.lit(0)
    for s in SIG:
        for part in (F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}")).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}")), 32)):
            total = total + F.bit_count((part.bitwiseAND(0x7FFF7FFF) + 0x7FFF7FFF).bitwiseOR(part).bitwiseAND(0x80008000))
    return total


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, set) of the wanted (id), the set as little-endian 64-bit hashes. The ids grow with the data, so they are met by a shuffle at every size; repeated rows come once."""

    def sets(batches):
        for batch in batches:
            for rows, data, offsets in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("id")[rows], pa.array([h.tobytes() for h in shingle_sets(data, offsets)], pa.binary())], ["id", "set"])

    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted.hint("merge"), "id", "left_semi")
    return texts.dropDuplicates(["id", "text"]).mapInArrow(sets, "id long, set binary")


def sharing_rare(sets: DataFrame, open_: DataFrame) -> DataFrame:
    """Pairs (a, b) of open_ (id, component) of different components that share one of their rarest fifth of shingles; sets: (id, set)."""

    def listed(batches):
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("set")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "set"])

    rows = written(sets.join(open_.select("id").hint("merge"), "id", "left_semi").mapInArrow(listed, "id long, set array<long>").select("id", F.size("set").alias("n"), F.explode("set").alias("g")), "dup-shingles")
    common = rows.groupBy("g").agg(F.count("*").alias("f")).where("f > 1")
    ranked = rows.join(common, "g", "left").withColumn("r", F.row_number().over(W.Window.partitionBy("id").orderBy(F.coalesce("f", F.lit(1)), "g")))
    rare = written(ranked.where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1) & F.col("f").isNotNull()).select("id", "n", "g", "r").join(open_, "id"), "dup-rare")
    side = lambda x: rare.select("g", F.col("id").alias(x), F.col("n").alias(x + "n"), F.col("r").alias(x + "r"), F.col("component").alias(x + "c"))
    # at the first shingle that a pair shares, in this order, no more than what stands behind it on either side can be shared besides; a link needs 9 * intersection >= 4 * (sum of sizes)
    enough = 9 * (F.least(F.col("an") - F.col("ar"), F.col("bn") - F.col("br")) + 1) >= 4 * (F.col("an") + F.col("bn"))
    both = side("a").join(side("b"), "g").where((F.col("a") > F.col("b")) & (F.col("ac") != F.col("bc")) & (5 * F.least("an", "bn") >= 4 * F.greatest("an", "bn")) & enough)
    return both.select("a", "b").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, least: int = 80) -> DataFrame:
    """Of pairs (a, b) those whose full sets satisfy 100 * intersection >= least * union; sets: (id, set) of all ids in pairs."""
    pairs = written(pairs, "dup-candidates")

    def judge(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if least * max(len(x), len(y)) <= 100 * min(len(x), len(y)):
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    keep[i] = 100 * common >= least * (len(both) - common)
            found = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([found.column("a"), found.column("b")], ["a", "b"])

    x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    full = pairs.hint("merge").join(x, "a").hint("merge").join(y, "b").select("a", "b", "x", "y")
    return written(full.mapInArrow(judge, "a long, b long").distinct(), "dup-links")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every id in links (a, b). Minima of neighbours and of labels' labels, until nothing changes; each round is
    a written table."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "dup-edges")
    label = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "dup-labels")
    while True:
        near = both.join(label.withColumnsRenamed({"id": "b", "component": "c"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        step = written(label.join(near, "id").select("id", F.least("component", "c").alias("component"), (F.col("c") < F.col("component")).alias("moved")), "dup-labels")
        if not step.where("moved").limit(1).count():
            return label
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("c"))
        label = written(step.drop("moved").join(jump, "component").select("id", F.col("c").alias("component")), "dup-labels")


def salted(members: DataFrame) -> DataFrame:
    """members (id, n: classes of its bucket) with the piece of its bucket that a row belongs to."""
    return members.withColumn("piece", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / SALT)).cast("int"))


def for_pieces(buckets: DataFrame) -> DataFrame:
    """A row for each piece of buckets (n)."""
    return buckets.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / SALT).cast("int") - 1))).drop("n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs: doc_id (bigint), text -> doc_id, n_shingles, component_id, kept; a row per row of docs."""
    rows = written(signed(docs), "dup-signatures")
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), *[F.first(s).alias(s) for s in SIG])
    classes = written(classes, "dup-classes")
    keyed = classes.select("id", F.explode(keys_of()).alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    members = written(salted(keyed.join(written(buckets, "dup-buckets"), "key")), "dup-members")  # the classes of buckets with more than one
    sets = written(sets_of(docs, members.select("id").distinct()), "dup-sets")  # every later step needs sets of members alone: texts are shuffled once
    # a bucket has two stars: its least class, and of the others the most central one, whose own buckets hold the most classes (of copies of one text the text itself)
    central = members.groupBy("id").agg(F.sum("n").alias("weight"))
    heads = members.where("id > first").join(central, "id").groupBy("key").agg(F.max("n").alias("n"), F.max(F.struct("weight", (-F.col("id")).alias("m"))).alias("h")).select("key", "n", (-F.col("h.m")).alias("head"))
    stars = members.join(for_pieces(written(heads, "dup-heads")), ["key", "piece"]).select("id", F.explode(F.array("first", "head")).alias("b")).where("id <> b").select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()
    sig = lambda side: classes.select(F.col("id").alias(side), F.col("n").alias(side + "n"), *[F.col(s).alias(side + s) for s in SIG])
    stars = stars.join(sig("b"), "b").join(sig("a"), "a").where((5 * F.least("an", "bn") >= 4 * F.greatest("an", "bn")) & (distance("a", "b") <= FAR)).select("a", "b")
    links = confirmed(stars, sets)
    label = components(links)
    # what the stars leave: buckets of several components
    placed = members.select("key", "piece", "n", "id").join(label, "id", "left").select("key", "piece", "n", "id", F.coalesce("component", "id").alias("component"))
    placed = written(placed, "dup-placed")
    mixed = placed.groupBy("key").agg(F.max("n").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key", "n")
    open_ = written(placed.join(for_pieces(written(mixed, "dup-mixed")), ["key", "piece"]).select("id", "component").distinct(), "dup-open")
    more = confirmed(sharing_rare(sets, open_), sets)
    if more.limit(1).count():
        label = components(links.union(more))
    named = classes.join(label, "id", "left").select("hi", "lo", F.coalesce("component", "id").alias("component"))
    out = rows.select("doc_id", "n_shingles", "hi", "lo").join(named, ["hi", "lo"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document with the least id of each group, with the columns of docs; repeated rows of an id are left to that id."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, g FROM (SELECT r, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
link AS (SELECT a, b FROM pairs JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT r AS a, r AS b FROM n UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
c AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)
"""
