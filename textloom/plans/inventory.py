"""Queries of the library's smaller operators, one each, with their SQL; importing this module adds them to the registry."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as X
from textloom.functions.register import register
from textloom.operators import arith, bits, dictionary, filters, hashing, matching, segment, sequences, tables
from textloom.sources import text as sources

from .registry import BITS, CORPUS, DICT, FULL_DICT, MISSPELL, SEQ, all_words, corpus, index_sql, join_sql, load, queries_of, query, seq, variants_sql, vector, words

# sources, sinks, dictionary
@query("SELECT word, count, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT p_type AS word, sum(p_size)::BIGINT AS count FROM part GROUP BY p_type)")
def dict_load(spark, sf_dir):
    return tables.numbered(dictionary.from_table(load(spark, sf_dir, "part"), "p_type", "p_size"), "word", name="word_id")


@query("SELECT p_name AS word, p_size::BIGINT AS count FROM part")
def dict_from_text(spark, sf_dir):
    """Words may hold blanks: the count stands behind the last one."""
    return sources.dictionary_lines(load(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("line")))


@query("SELECT n_name AS line FROM nation")
def text_section(spark, sf_dir):
    path = tables.work_path(spark, "section")
    lines = load(spark, sf_dir, "nation").agg(F.concat(F.lit("# names\n@NAMES\n# inside\n\n"), F.array_join(F.transform(F.collect_list("n_name"), lambda x: F.concat(F.lit(" \t"), x)), "\n"), F.lit("\n@NAMES_END\n@OTHER\nx\n@OTHER_END")).alias("value"))
    lines.write.text(path)
    return sources.section(spark, path, "NAMES")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def serde_write(spark, sf_dir):
    """Written as ORC, and read without naming a schema: the files hold it."""
    path = tables.work_path(spark, "orc")
    tables.write_table(load(spark, sf_dir, "orders"), path, "orc")
    return spark.read.orc(path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def serde_read(spark, sf_dir):
    expected = T.StructType.fromDDL("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    return tables.read_table(spark, f"{sf_dir}/customer.parquet", expected)


@query("SELECT * FROM (VALUES (0, 'vec_id', 'bigint'), (1, 'embedding', 'array<float>'), (2, 'label', 'int')) t(place, name, kind)")
def serde_types(spark, sf_dir):
    schema = tables.schema_of_json(tables.schema_json(load(spark, sf_dir, "embeddings").schema))
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema)], "place int, name string, kind string")


@query("SELECT a, b, a = b AS equal FROM (VALUES ('region'), ('nation'), ('labels'), ('benchmark')) x(a), (VALUES ('region'), ('nation'), ('labels'), ('benchmark')) y(b)")
def schema_equal(spark, sf_dir):
    names = ("region", "nation", "labels", "benchmark")
    schemas = {n: load(spark, sf_dir, n).schema for n in names}
    return spark.createDataFrame([(a, b, tables.schema_equal(schemas[a], schemas[b])) for a in names for b in names], "a string, b string, equal boolean")


@query("SELECT 'root' || chr(10) || ' |-- r_regionkey: integer (nullable = true)' || chr(10) || ' |-- r_name: string (nullable = true)' AS tree")
def schema_print(spark, sf_dir):
    return spark.createDataFrame([(tables.schema_print(load(spark, sf_dir, "region").schema).strip(),)], "tree string")


@query("SELECT o_orderkey, c_name, c_nationkey, c_mktsegment, (SELECT count(DISTINCT o_custkey) FROM orders) AS objects FROM orders JOIN customer ON o_custkey = c_custkey")
def pointer_graph(spark, sf_dir):
    """Orders that point to customers: each customer is written once and pointed to, and comes back with every order."""
    c = load(spark, sf_dir, "customer")
    held = load(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.struct(*c.columns).alias("customer"))
    rows, objects = tables.share(held, "customer")
    at = [tables.work_path(spark, n) for n in ("rows", "objects")]
    tables.write_table(rows, at[0])
    tables.write_table(objects, at[1])
    rows, objects = spark.read.parquet(at[0]), spark.read.parquet(at[1])
    return tables.unshare(rows, objects).select("o_orderkey", "customer.c_name", "customer.c_nationkey", "customer.c_mktsegment", F.lit(objects.count()).alias("objects"))


REACHED = "WITH RECURSIVE p AS (SELECT p_partkey AS id, (p_partkey * 7 + 3) % n AS next, (p_partkey // 2) AS half, p_size FROM part, (SELECT count(*) AS n FROM part)), m AS (SELECT id FROM p WHERE id = 5 UNION SELECT to_ FROM m JOIN (SELECT id, next AS to_ FROM p WHERE p_size < 20 UNION ALL SELECT id, half FROM p) l USING (id))"


@query(REACHED + " SELECT id, p_size FROM p WHERE id IN (SELECT id FROM m)")
def pointer_walk(spark, sf_dir):
    """Records with two pointers each, which form cycles: what a walk from one of them meets."""
    part = load(spark, sf_dir, "part")
    nodes = part.select(F.col("p_partkey").alias("id"), "p_size", ((F.col("p_partkey") * 7 + 3) % part.count()).alias("next"), F.floor(F.col("p_partkey") / 2).alias("half"))
    links = nodes.where("p_size < 20").select("id", F.col("next").alias("to")).union(nodes.select("id", "half"))
    return tables.reachable(nodes.select("id", "p_size"), links, spark.createDataFrame([(5,)], "id long"))


# edits
@query(f"WITH {FULL_DICT} SELECT DISTINCT w AS word, edit FROM {variants_sql('dict', 'word', 2, True)}")
def edits_explode(spark, sf_dir):
    """All deletions, the first positions' too."""
    return all_words(spark, sf_dir).select("word", F.explode(X.delete_edits("word", 2, True)).alias("edit"))


PERMUTED = "[a || b || c, a || c || b, b || a || c, b || c || a, c || a || b, c || b || a]"


@query(f"SELECT key, list_min(list_filter({PERMUTED}, lambda x: x > key)) AS next FROM (SELECT lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS key, key[1] AS a, key[2] AS b, key[3] AS c FROM part)")
def next_permutation(spark, sf_dir):
    key = F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")
    return load(spark, sf_dir, "part").select(key.alias("key")).select("key", F.array_join(X.next_permutation(F.filter(F.split("key", ""), lambda c: c != "")), "").alias("next"))


def layered(spark, sf_dir, dedup):
    return words(spark, sf_dir).select("word", F.explode(X.layered_edits("word", 2, dedup)).alias("v")).groupBy("word", F.col("v.d").alias("d")).agg(F.count("*").alias("edits"))


LAYERED = f"WITH {DICT} SELECT w AS word, d::INT AS d, count({{}})::BIGINT AS edits FROM {variants_sql('dict', 'word', 2)} GROUP BY w, d"


@query(LAYERED.format("*"))
def dedup_none(spark, sf_dir):
    return layered(spark, sf_dir, "none")


@query(LAYERED.format("DISTINCT edit"))
def dedup_hash(spark, sf_dir):
    return layered(spark, sf_dir, "hash")


FEW_LOST = "true AS within, true AS few_lost"


@query(f"WITH {DICT}, v AS (SELECT DISTINCT w, d, edit FROM {variants_sql('dict', 'word', 2)}) SELECT count(*)::BIGINT AS variants, true AS distinct_all, {FEW_LOST} FROM v")
def dedup_bloom(spark, sf_dir):
    """What the filter lets through comes once and is among the variants; of these it loses at most 2 in 100."""
    d = words(spark, sf_dir)
    all_, let = (d.select("word", F.explode(X.layered_edits("word", 2, how)).alias("v")).select("word", "v.*") for how in ("hash", "bloom"))
    seen = let.groupBy("word", "d", "edit").agg(F.count("*").alias("times"))
    both = all_.withColumn("known", F.lit(True)).join(seen, ["word", "d", "edit"], "full")
    return both.agg(F.count_if("known").alias("variants"), F.every(F.coalesce("times", F.lit(1)) == 1).alias("distinct_all"), F.every(F.col("known").isNotNull()).alias("within"), (F.count_if(F.col("times").isNull()) <= 0.02 * F.count("*")).alias("few_lost"))


@query(
    f"WITH {DICT}, v AS (SELECT *, row_number() OVER (PARTITION BY w, d ORDER BY mask) AS place FROM {variants_sql('dict', 'word', 2)}), p AS (SELECT *, max(place) OVER (PARTITION BY w, d, edit ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM v), "
    "again AS (SELECT p.w, p.d, p.place FROM p JOIN v x ON x.w = p.w AND x.d = p.d AND x.place > p.last AND x.place < p.place GROUP BY p.w, p.d, p.place HAVING count(DISTINCT x.edit) >= 4) "
    "SELECT p.w AS word, p.d::INT AS d, count(*)::BIGINT AS edits FROM p LEFT JOIN again USING (w, d, place) WHERE p.last IS NULL OR again.w IS NOT NULL GROUP BY p.w, p.d"
)
def dedup_lru(spark, sf_dir):
    """The filter remembers 4 variants; those that come again behind 4 others come twice."""
    return words(spark, sf_dir).select("word", F.explode(X.layered_edits("word", 2, "lru", 4)).alias("v")).groupBy("word", F.col("v.d").alias("d")).agg(F.count("*").alias("edits"))


INDEX = f"WITH {DICT}, {index_sql(1)} SELECT edit, word, count FROM idx"


@query(INDEX)
def index_build(spark, sf_dir):
    return matching.build_index(words(spark, sf_dir), 1).select("edit", "word", "count")


@query(f"WITH {DICT}, {index_sql(2)} SELECT count(*)::BIGINT AS postings, {FEW_LOST} FROM idx")
def index_build_bloom(spark, sf_dir):
    """No posting that the whole index hasn't; of its postings at most 2 in 100 are lost."""
    d = words(spark, sf_dir)
    whole, let = matching.build_index(d, 2), matching.build_index(d, 2, dedup="bloom")
    both = whole.withColumn("known", F.lit(True)).join(let.withColumn("kept", F.lit(True)), ["edit", "word"], "full")
    return both.agg(F.count_if("known").alias("postings"), F.every(F.col("known").isNotNull()).alias("within"), (F.count_if(F.col("kept").isNull()) <= 0.02 * F.count("*")).alias("few_lost"))


@query(INDEX)
def index_build_lru(spark, sf_dir):
    """Variants that the filter lets through twice are one posting."""
    return matching.build_index(words(spark, sf_dir), 1, dedup="lru").select("edit", "word", "count")


# matching
@query(f"WITH {DICT}, {MISSPELL}, {index_sql(1)} SELECT DISTINCT v.w AS query, edit, word FROM {variants_sql('q', 'query', 1)} v JOIN idx USING (edit)")
def index_probe(spark, sf_dir):
    d = words(spark, sf_dir)
    return matching.probe(queries_of(d), matching.build_index(d, 1), 1)


@query(f"WITH {CORPUS} SELECT word AS query FROM corpus WHERE length(word) > 12 + 2")
def lookup_toolong(spark, sf_dir):
    return matching.too_long(corpus(spark, sf_dir).select(F.col("word").alias("query")), 12, 2)


@query(f"WITH {DICT}, {MISSPELL} SELECT query, truth FROM miss WHERE abs(length(query) - length(truth)) < 1")
def filter_len(spark, sf_dir):
    return dictionary.misspelled(words(spark, sf_dir)).where(F.abs(F.char_length("query") - F.char_length("truth")) < 1)


@query(join_sql(1, "damerau_levenshtein"))
def symspell_dl(spark, sf_dir):
    """The whole dictionary with itself; within one edit the restricted and the unrestricted distance agree."""
    d = all_words(spark, sf_dir)
    return matching.fuzzy_join(d, d, "word", "word", 1, "osa")


@query(
    f"WITH {DICT}, short AS (SELECT * FROM dict WHERE length(word) < 8), long AS (SELECT * FROM dict WHERE length(word) >= 8), "
    f"v AS (SELECT DISTINCT w, edit FROM {variants_sql('short', 'word', 1)} UNION ALL SELECT DISTINCT w, edit FROM {variants_sql('long', 'word', 2)}) SELECT edit, count(*)::BIGINT AS words FROM v GROUP BY edit"
)
def symspell_generic(spark, sf_dir):
    """A distance of each word's own: 1 for short words, 2 for long ones."""
    own = F.when(F.char_length("word") < 8, 1).otherwise(2)
    return matching.build_index(words(spark, sf_dir), 2, max_distance=own).groupBy("edit").agg(F.count("*").alias("words"))


@query("SELECT doc_id, len(p)::BIGINT AS n, coalesce(list_sum(p), 0)::BIGINT AS total, list_max(p)::INT AS largest FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c)) AS p FROM documents)")
def utf8_to_codepoints(spark, sf_dir):
    p = load(spark, sf_dir, "documents").select("doc_id", X.code_points("text").alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("p").alias("largest"))


# segmentation
@query("SELECT doc_id, CASE WHEN text LIKE ' %' OR text LIKE chr(10) || '%' THEN 1 ELSE 0 END::INT AS bytes FROM documents")
def is_sep(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", X.starts_with_any("text", [" ", "\n"]).alias("bytes"))


@query("SELECT doc_id, CASE WHEN text[1] IN (',', ']', '[', ')', '(', '}', '{', '.') THEN 1 ELSE 0 END::INT AS bytes FROM documents")
def is_punct(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", X.starts_with_any("text", list(segment.Options().punctuation)).alias("bytes"))


@query(r"SELECT p_partkey, regexp_replace(raw, '[ ,\]\[)(}{.]', '', 'g') AS part, (length(raw) - length(regexp_replace(raw, '[ ,\]\[)(}{.]', '', 'g')) - led::INT)::INT AS removed, led FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ' ' ELSE '' END || p_name || '.,' AS raw, p_size % 2 = 0 AS led FROM part)")
def part_clean(spark, sf_dir):
    raw = F.concat(F.when(F.col("p_size") % 2 == 0, " ").otherwise(""), F.col("p_name"), F.lit(".,"))
    part, removed, led = segment.clean_part(F.col("raw"))
    return load(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", part.alias("part"), removed.alias("removed"), led.alias("led"))


@query(f"WITH {DICT} SELECT word, round(log10(count / (SELECT sum(count) FROM dict)::DOUBLE), 6) AS score FROM dict")
def part_score_hit(spark, sf_dir):
    d = words(spark, sf_dir)
    return d.select("word", F.round(segment.hit_score(F.col("count"), d.agg(F.sum("count")).first()[0]), 6).alias("score"))


@query(f"WITH {DICT}, {MISSPELL} SELECT query, round(log10(10 / ((SELECT sum(count) FROM dict)::DOUBLE * pow(length(query)::DOUBLE, 10))), 6) AS score FROM q")
def part_score_miss(spark, sf_dir):
    d = words(spark, sf_dir)
    return queries_of(d).select("query", F.round(segment.miss_score(F.char_length("query"), d.agg(F.sum("count")).first()[0]), 6).alias("score"))


# hashing
@query("SELECT n, floor(n / 6.0::DOUBLE)::BIGINT AS buckets, ceil(n / 0.97::DOUBLE + 1)::BIGINT + (bit_count(ceil(n / 0.97::DOUBLE + 1)::BIGINT) = 1)::BIGINT AS table_size, n AS minimal_size, round(greatest(0, least(1, 1024 / (5 * sqrt(n::DOUBLE)))), 9) AS eps FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)")
def phf_config(spark, sf_dir):
    sizes = load(spark, sf_dir, "orders").groupBy("o_orderpriority").count().collect()  # five priorities
    configs = [(r["count"], hashing.Config(r["count"]), hashing.Config(r["count"], minimal=True)) for r in sizes]
    return spark.createDataFrame([(n, c.buckets, c.table_size, m.size, round(c.eps, 9)) for n, c, m in configs], "n long, buckets long, table_size long, minimal_size long, eps double")


@query("SELECT count(*) AS keys, true AS in_range, count(*) // 6 AS buckets, true AS none_overfull FROM orders")
def phf_buckets(spark, sf_dir):
    """Every key has a bucket of the table's, and none holds more keys than allowed."""
    keys = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    config = hashing.Config(keys.count())
    held = hashing.bucketed(keys, config).groupBy("bucket").agg(F.count("*").alias("n"))
    return held.agg(F.sum("n").alias("keys"), F.every(F.col("bucket").between(0, config.buckets - 1)).alias("in_range"), F.lit(config.buckets).cast("long").alias("buckets"), (F.max("n") < config.max_bucket).alias("none_overfull"))


@query("SELECT l_orderkey AS key, count(*)::BIGINT AS times FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def phf_collision(spark, sf_dir):
    return hashing.collisions(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")))


def spread(keys):
    """Properties of a hash: as many values as keys, all in [0, 1), their mean near a half."""
    u = keys.distinct().select(hashing.unit_hash(F.col("key"), 7).alias("u"))
    return u.agg(F.count_distinct("u").alias("n"), ((F.min("u") >= 0) & (F.max("u") < 1)).alias("inside"), (F.abs(F.avg("u") - 0.5) < 0.05).alias("even"))


@query(f"WITH {CORPUS} SELECT count(*) AS n, true AS inside, true AS even FROM corpus")
def hash_str(spark, sf_dir):
    return spread(corpus(spark, sf_dir).select(F.col("word").alias("key")))


@query("SELECT count(DISTINCT o_orderkey) AS n, true AS inside, true AS even FROM orders")
def hash_num(spark, sf_dir):
    return spread(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")))


# sequences and bits
@query(f"WITH {SEQ} SELECT ord, value FROM s")
def ef_build(spark, sf_dir):
    s = seq(spark, sf_dir)
    if sequences.decreasing(s).limit(1).count():
        raise ValueError("the sequence decreases")
    return s


@query("SELECT n, universe, (n * low + (universe >> low) + n)::BIGINT AS bits FROM (SELECT n, universe, greatest(0, length(bin(universe - 1)) - length(bin(n - 1)))::BIGINT AS low FROM (SELECT count(*) AS n, max(o_orderkey) + 1 AS universe FROM orders))")
def ef_size(spark, sf_dir):
    n, top = load(spark, sf_dir, "orders").agg(F.count("*"), F.max("o_orderkey") + 1).first()
    return spark.createDataFrame([(n, top, sequences.encoded_bits(n, top))], "n long, universe long, bits long")


@query(f"WITH {BITS} SELECT pos, bit FROM b")
def bit_build(spark, sf_dir):
    return vector(spark, sf_dir)


@query("SELECT event_id, (event_id >> 3) & 1 = 1 AS bit60, false AS bit0 FROM events")
def bit_test(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", bits.is_set("event_id", 60).alias("bit60"), bits.is_set("event_id", 0).alias("bit0"))


@query("SELECT event_id, event_id | 8 AS word FROM events")
def bit_set(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", bits.with_bit("event_id", 60, True).alias("word"))


@query("SELECT event_id, event_id - (event_id & 8) AS word FROM events")
def bit_clear(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", bits.with_bit("event_id", 60, False).alias("word"))


@query("SELECT event_id, (SELECT p FROM (SELECT p, row_number() OVER (ORDER BY p) AS rn FROM (SELECT unnest(range(0, 64)) AS p) WHERE ((event_id >> p) & 1) = 1) WHERE rn = 2) AS second FROM events")
def nth_set_bit_lsb(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", bits.nth_set_bit("event_id", 2, lsb=True).cast("long").alias("second"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_orderkey * 8 WHEN 1 THEN l_orderkey * 1024 ELSE 0 END::BIGINT AS shifted FROM lineitem")
def shl_safe(spark, sf_dir):
    n = F.when(F.col("l_linenumber") % 3 == 0, 3).when(F.col("l_linenumber") % 3 == 1, 10).otherwise(64)
    return load(spark, sf_dir, "lineitem").withColumn("n", n).select("l_orderkey", "l_linenumber", bits.shift_left("l_orderkey", "n").alias("shifted"))


@query("SELECT * FROM (VALUES (12, '12,6,3'), (13, '12,6,3'), (64, '64,4,4')) t(first, chain)")
def mult_chain(spark, sf_dir):
    """Each number divides the one before."""
    hints = {12: [6, 4], 13: [6, 4], 64: [6, 4]}
    return spark.createDataFrame([(a, ",".join(map(str, bits.multiplicative_chain(a, h)))) for a, h in hints.items()], "first int, chain string")


# filters, arithmetic, formats
@query("SELECT count(DISTINCT o_custkey) AS members, true AS all_found, true AS few_false FROM orders")
def bloom6(spark, sf_dir):
    """A filter with six hashes: all members are found, and of others at most 3 in 100."""
    keys = load(spark, sf_dir, "orders").select(F.concat(F.lit("k"), F.col("o_custkey")).alias("key")).distinct()
    n = keys.count()
    p = 0.01  # gives six hashes
    built = tables.materialised(filters.bloom_build(keys, "key", n, p), "bloom")
    inside = filters.bloom_contains(built, keys, "key", n, p).agg(F.count("*").alias("members"), F.every(F.col("maybe")).alias("all_found"))
    outside = filters.bloom_contains(built, keys.select(F.concat("key", F.lit("x")).alias("key")), "key", n, p).agg((F.avg(F.col("maybe").cast("int")) <= 0.03).alias("few_false"))
    return inside.join(outside)


@query("SELECT p_partkey, ((18446744073709551615::HUGEINT // p_size) + 1)::VARCHAR AS magic, ((340282366920938463463374607431768211455::UHUGEINT // (p_partkey + 2)::UHUGEINT) + 1)::VARCHAR AS wide FROM part")
def magic(spark, sf_dir):
    """The wide one, of 128 bits, is put together from its halves in base 10^19, as no decimal holds it."""
    m = arith.magic_number_wide(F.col("p_partkey") + 2)
    ten = F.lit(str(10**19)).cast(arith.WIDE)
    hi, lo = m["hi"].cast(arith.WIDE), m["lo"].cast(arith.WIDE)
    # 2^64 = 1 * 10^19 + 8446744073709551616
    rest = F.lit("8446744073709551616").cast(arith.WIDE)
    low = ((hi * rest).cast(arith.WIDE) % ten + lo).cast(arith.WIDE)
    high = (hi + arith.whole((hi * rest).cast(arith.WIDE), ten) + arith.whole(low, ten)).cast(arith.WIDE)
    text = F.concat(high.cast("string"), F.lpad((low % ten).cast("decimal(19,0)").cast("string"), 19, "0"))
    return load(spark, sf_dir, "part").select("p_partkey", arith.magic_number(F.col("p_size")).cast("string").alias("magic"), text.alias("wide"))


@query("SELECT o_orderkey, ((o_orderkey::UHUGEINT * 18446744073709551557::UHUGEINT) // 18446744073709551616::UHUGEINT)::VARCHAR AS high FROM orders")
def mul128(spark, sf_dir):
    """Upper halves of products with the largest prime below 2^64."""
    return load(spark, sf_dir, "orders").select("o_orderkey", arith.mul_high(F.col("o_orderkey"), F.lit("18446744073709551557").cast("decimal(20,0)")).cast("string").alias("high"))


@query("SELECT c_custkey, (8 + coalesce(strlen(c_name), 0) + CASE WHEN c_nationkey IS NULL THEN 0 ELSE 4 END + CASE WHEN c_acctbal IS NULL THEN 0 ELSE 8 END + coalesce(strlen(c_mktsegment), 0))::BIGINT AS bytes FROM customer")
def runtime_size(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return c.select("c_custkey", X.deep_bytes(c.schema).alias("bytes"))


@query("SELECT o_orderkey, CASE WHEN abs(ns) < 1000 THEN ns::VARCHAR || ' ns' WHEN abs(ns) < 1000000 THEN printf('%.2f us', ns / 1000.0::DOUBLE) WHEN abs(ns) < 1000000000 THEN printf('%.2f ms', ns / 1000000.0::DOUBLE) WHEN abs(ns) < 60000000000 THEN printf('%.2f sec', ns / 1000000000.0::DOUBLE) WHEN abs(ns) < 3600000000000 THEN printf('%.2f min', ns / 60000000000.0::DOUBLE) ELSE printf('%.2f hr', ns / 3600000000000.0::DOUBLE) END AS took FROM (SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END) * (o_orderkey * o_orderkey * o_orderkey * 10 + 1) AS ns FROM orders)")
def human_time(spark, sf_dir):
    """Every second one negative. The numbers end in 1, so that no quotient lies halfway between two printed ones."""
    n = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select("o_orderkey", arith.human_time(F.when(n % 2 == 0, -1).otherwise(1) * (n * n * n * 10 + 1)).alias("took"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey <= 1 THEN 0 ELSE length(bin(o_orderkey - 1)) END::INT AS log2 FROM orders")
def log2ceil(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", arith.log2_ceil(F.col("o_orderkey")).cast("int").alias("log2"))


@query("SELECT p_partkey, printf('%s', CASE WHEN p_size < 1024 THEN p_size::VARCHAR || ' b' END) AS size, CASE WHEN p_size <= 1 THEN 0 ELSE length(bin(p_size - 1)) END::INT AS log2, p_partkey % 37 AS rest, p_name LIKE 'a%' OR p_name LIKE '%a%' AS has_a FROM part")
def sql_functions(spark, sf_dir):
    """The functions by their SQL names."""
    register(spark)
    load(spark, sf_dir, "part").createOrReplaceTempView("textloom_part")
    return spark.sql("SELECT p_partkey, tl_human_bytes(p_size) AS size, tl_log2_ceil(p_size) AS log2, tl_fast_mod(p_partkey, 37) AS rest, tl_is_subsequence(p_name, 'a') AS has_a FROM textloom_part")


@query("SELECT count(*) AS n, true AS alphabet, 30 AS length, true AS varied FROM part")
def random_strings(spark, sf_dir):
    t = load(spark, sf_dir, "part").select(X.random_text("p_partkey", 30).alias("t"))
    return t.agg(F.count("*").alias("n"), F.every(F.col("t").rlike("^[0-9A-Za-z]*$")).alias("alphabet"), F.max(F.char_length("t")).alias("length"), (F.count_distinct("t") == F.count("*")).alias("varied"))
