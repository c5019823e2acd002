"""Queries over the shared tables, each with the SQL that gives the same rows.

Words come from the English documents; queries are their deterministic misspellings. Whole tables are used throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import arith, bits, dictionary, filters, hashing, matching, segment, sequences, tables

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.from_corpus(load(spark, sf_dir, "documents").where("lang = 'en'"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default dictionary: words of 3 to 12 letters that come 5 times at least."""
    return tables.materialised(dictionary.usable(corpus(spark, sf_dir)), "words")


def all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word, as rare, short or long as it is."""
    return tables.materialised(corpus(spark, sf_dir), "all-words")


def queries_of(d: DataFrame) -> DataFrame:
    return dictionary.misspelled(d).select("query").distinct()


# SQL pieces
CORPUS = "corpus AS (SELECT word, count(*)::BIGINT AS count FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE lang = 'en') GROUP BY word)"
DICT = CORPUS + ", dict AS (SELECT * FROM corpus WHERE count >= 5 AND length(word) BETWEEN 3 AND 12)"
FULL_DICT = CORPUS + ", dict AS (SELECT * FROM corpus)"
MISSPELL = "miss AS (SELECT word AS truth, CASE length(word) % 4 WHEN 0 THEN l || a || r WHEN 1 THEN l || h || h || a || r WHEN 2 THEN l || a || h || r ELSE l || 'x' || a || r END AS query FROM (SELECT word, substr(word, 1, p - 1) AS l, substr(word, p, 1) AS h, substr(word, p + 1, 1) AS a, substr(word, p + 2) AS r FROM (SELECT word, greatest(length(word) // 2, 1) AS p FROM dict))), q AS (SELECT DISTINCT query FROM miss)"


def variants_sql(source: str, column: str, k: int, complete: bool = False) -> str:
    """(w, edit, d, mask) of the deletions of at most k positions, as plain SQL; the first k positions' deletion only if complete."""
    base = f"SELECT {column} AS w, length({column}) AS n FROM {source}"
    one = "SELECT w, substr(w, 1, p - 1) || substr(w, p + 1) AS edit, 1 AS d, (1::BIGINT << (n - p)) AS mask, p = 1 AS a, n FROM (SELECT w, n, unnest(range(1, n + 1)) AS p FROM b)"
    two = "SELECT w, substr(w, 1, p - 1) || substr(w, p + 1, r - p - 1) || substr(w, r + 1) AS edit, 2 AS d, (1::BIGINT << (n - p)) + (1::BIGINT << (n - r)) AS mask, p = 1 AND r = 2 AS a, n FROM (SELECT w, n, p, unnest(range(p + 1, n + 1)) AS r FROM (SELECT w, n, unnest(range(1, n + 1)) AS p FROM b))"
    parts = ["SELECT w, w AS edit, 0 AS d, 0::BIGINT AS mask, false AS a, n FROM b", one, two][: k + 1]
    return f"(WITH b AS ({base}) SELECT w, edit, d, mask FROM ({' UNION ALL '.join(parts)}) WHERE edit <> ''{'' if complete else f' AND NOT (a AND d = {k})'})"


def index_sql(k: int) -> str:
    return f"idx AS (SELECT DISTINCT v.edit, w AS word, dict.count FROM {variants_sql('dict', 'word', k)} v JOIN dict ON dict.word = v.w)"


def candidates_sql(k: int) -> str:
    return f"{index_sql(k)}, met AS (SELECT v.w AS query, word, count, (length(word) - length(v.edit))::INT AS ed, d, mask FROM {variants_sql('q', 'query', k)} v JOIN idx USING (edit) WHERE abs(length(word) - length(v.w)) <= {k} AND length(word) - length(v.edit) <= {k}), cand AS (SELECT query, word, count, ed, d, mask FROM (SELECT *, row_number() OVER (PARTITION BY query, word ORDER BY d, mask, ed) AS rn FROM met) WHERE rn = 1)"


ORDERS = {"first": "d, mask, ed, count DESC, word", "layer": "d, ed, count DESC, mask, word", "full": "ed, CASE WHEN ed = 0 THEN 0 ELSE -count END, d, mask, word"}


def top_sql(k: int, mode: str = "first", top: int = 1, rank: str = "", words: str = DICT) -> str:
    return f"WITH {words}, {MISSPELL}, {candidates_sql(k)} SELECT query, {rank}word, ed AS edit_distance, d AS delete_distance, count FROM (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY {ORDERS[mode]}))::INT AS rank FROM cand) WHERE rank <= {top}"


# dictionary and edits
@query(f"WITH {CORPUS} SELECT word, count FROM corpus")
def dict_build(spark, sf_dir):
    return corpus(spark, sf_dir)


@query(f"WITH {DICT}, n AS (SELECT count, length(word) AS n FROM dict) SELECT max(n)::BIGINT AS word_max_bytes, max(n)::BIGINT AS word_max_len, 2::BIGINT AS max_distance, sum(count)::BIGINT AS count_sum, max(n * (n - 1) // 2)::BIGINT AS edits_layer_num_max, max(1 + n + n * (n - 1) // 2)::BIGINT AS edits_num_max, min(count) = max(count) AS count_uniform FROM n")
def dict_stats(spark, sf_dir):
    return dictionary.stats(words(spark, sf_dir), 2)


@query(f"WITH {FULL_DICT} SELECT DISTINCT w AS word, edit FROM {variants_sql('dict', 'word', 1)}")
def edits_explode_k1(spark, sf_dir):
    return all_words(spark, sf_dir).select("word", F.explode(X.delete_edits("word", 1)).alias("edit"))


@query(f"WITH {FULL_DICT} SELECT DISTINCT w AS word, edit FROM {variants_sql('dict', 'word', 2)}")
def edits_explode_k2(spark, sf_dir):
    return all_words(spark, sf_dir).select("word", F.explode(X.delete_edits("word", 2)).alias("edit"))


@query(f"WITH {DICT} SELECT word, (length(word) * (length(word) - 1) // 2)::BIGINT AS two FROM dict")
def edit_counts_binomial(spark, sf_dir):
    return words(spark, sf_dir).select("word", X.binomial(F.char_length("word"), 2).alias("two"))


@query(f"WITH {DICT} SELECT word, (1 + length(word) + length(word) * (length(word) - 1) // 2)::BIGINT AS deletes FROM dict")
def max_deletes(spark, sf_dir):
    return words(spark, sf_dir).select("word", X.max_deletes(F.char_length("word"), 2).alias("deletes"))


@query(f"WITH {DICT}, {index_sql(2)} SELECT edit, count(*)::BIGINT AS words FROM idx GROUP BY edit")
def index_postings(spark, sf_dir):
    return matching.build_index(words(spark, sf_dir), 2).groupBy("edit").agg(F.count("*").alias("words"))


@query(f"WITH {DICT}, {index_sql(2)} SELECT edit, count(*)::BIGINT AS words FROM idx GROUP BY edit ORDER BY words DESC, edit LIMIT 20")
def index_top_postings(spark, sf_dir):
    return index_postings(spark, sf_dir).orderBy(F.col("words").desc(), "edit").limit(20)


# lookups
def looked_up(spark, sf_dir, k, f, source=words, **options):
    d = source(spark, sf_dir)
    return f(queries_of(d), matching.build_index(d, k), k, **options)


@query(top_sql(1, words=FULL_DICT))
def lookup_top_k1(spark, sf_dir):
    return looked_up(spark, sf_dir, 1, matching.lookup_top, all_words)


@query(top_sql(2))
def lookup_top_k2(spark, sf_dir):
    return looked_up(spark, sf_dir, 2, matching.lookup_top)


@query(top_sql(2, "layer"))
def lookup_top_layer(spark, sf_dir):
    return looked_up(spark, sf_dir, 2, matching.lookup_top, mode=matching.LAYER)


@query(top_sql(2, "full"))
def lookup_top_full(spark, sf_dir):
    return looked_up(spark, sf_dir, 2, matching.lookup_top, mode=matching.FULL)


@query(top_sql(2, top=3, rank="rank, "))
def lookup_topk(spark, sf_dir):
    return looked_up(spark, sf_dir, 2, matching.lookup_topk, top=3)


@query(f"WITH {FULL_DICT}, {MISSPELL}, {candidates_sql(1)} SELECT query, word, ed AS edit_distance, d AS delete_distance, count FROM cand")
def lookup_all(spark, sf_dir):
    return looked_up(spark, sf_dir, 1, matching.lookup_all, all_words)


@query(f"WITH {FULL_DICT}, {MISSPELL}, {candidates_sql(1)} SELECT query, word, ed AS edit_distance, d AS delete_distance, count FROM cand")
def lookup_stored(spark, sf_dir):
    """As lookup_all, from an index that was built and stored once, bucketed by edit."""
    d, path = all_words(spark, sf_dir), tables.work_path(spark, "index")
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    matching.store_index(matching.build_index(d, 1), table, 8, path)
    return matching.lookup_all(queries_of(d), matching.load_index(spark, table), 1)


@query(f"WITH {DICT}, {MISSPELL}, {candidates_sql(1)} SELECT query FROM q WHERE query NOT IN (SELECT query FROM cand)")
def lookup_miss(spark, sf_dir):
    return looked_up(spark, sf_dir, 1, matching.lookup_miss)


def join_sql(k: int, distance: str) -> str:
    """Pairs of the dictionary that share what is left after k deletions at most, none of which is needed for the first k positions alone, and are within distance k: all that are."""
    both = "SELECT DISTINCT a.w AS a, b.w AS b FROM v a JOIN v b USING (edit) WHERE abs(length(a.w) - length(b.w)) <= " + str(k)
    empty = f"SELECT word AS w, '' AS edit FROM dict WHERE length(word) <= {k}"
    return f"WITH {FULL_DICT}, v AS (SELECT DISTINCT w, edit FROM {variants_sql('dict', 'word', k, True)} UNION {empty}) SELECT a AS word, b AS word_r, {distance}(a, b)::INT AS distance FROM ({both}) WHERE {distance}(a, b) <= {k}"


@query(join_sql(2, "levenshtein"))
def fuzzy_join_lev(spark, sf_dir):
    """The whole dictionary with itself."""
    d = all_words(spark, sf_dir)
    return matching.fuzzy_join(d, d, "word", "word", 2)


@query(f"WITH {DICT}, {MISSPELL} SELECT query, truth, regexp_matches(query, array_to_string(string_split(truth, ''), '.*')) AS longer, regexp_matches(truth, array_to_string(string_split(query, ''), '.*')) AS shorter FROM miss")
def subsequence_check(spark, sf_dir):
    return dictionary.misspelled(words(spark, sf_dir)).select("query", "truth", X.is_subsequence("query", "truth").alias("longer"), X.is_subsequence("truth", "query").alias("shorter"))


@query(f"WITH {DICT}, {MISSPELL} SELECT query, truth, levenshtein(query, truth)::INT AS distance FROM miss")
def levenshtein_distance(spark, sf_dir):
    return dictionary.misspelled(words(spark, sf_dir)).select("query", "truth", X.levenshtein("query", "truth").cast("int").alias("distance"))


@query(f"WITH {DICT}, {MISSPELL} SELECT query, truth, damerau_levenshtein(query, truth)::INT AS distance FROM miss")
def osa_distance(spark, sf_dir):
    """One edit or swap in the middle of a word, where restricted and unrestricted distances agree."""
    return dictionary.misspelled(words(spark, sf_dir)).select("query", "truth", X.osa("query", "truth").alias("distance"))


# the fold goes from place to place; `ring` has the best split up to each of the next places, nearest first
SEGMENT = """WITH RECURSIVE w AS (SELECT word, count(*)::BIGINT AS count FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS word FROM part) GROUP BY word),
dict AS (SELECT * FROM w), m AS (SELECT max(length(word)) + 1 AS reach, sum(count)::DOUBLE AS total FROM w),
ph AS (SELECT DISTINCT replace(p_name, ' ', '') AS phrase FROM part),
span AS (SELECT phrase, j, i, substr(phrase, j + 1, i) AS query FROM (SELECT phrase, j, unnest(range(1, least(reach, length(phrase) - j) + 1)) AS i FROM (SELECT phrase, unnest(range(0, length(phrase))) AS j FROM ph), m)),
q AS (SELECT DISTINCT query FROM span), %s,
top AS (SELECT query, word, ed, count FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, mask, ed, count DESC, word) AS rn FROM cand) WHERE rn = 1),
part_of AS (SELECT phrase, j, i, query, coalesce(word, query) AS word, coalesce(ed, length(query))::BIGINT AS cost, coalesce(log10(count / total), log10(10 / (total * pow(length(query)::DOUBLE, 10)))) AS log FROM span LEFT JOIN top USING (query), m),
begun AS (SELECT phrase, j, list({'cost': cost, 'log': log, 'part': query, 'word': word} ORDER BY i) AS l FROM part_of GROUP BY phrase, j),
fold AS (SELECT phrase, 0 AS j, list_transform(l, lambda p: {'distance': p.cost, 'log': p.log, 'segmented': p.part, 'corrected': p.word}) AS ring FROM begun WHERE j = 0
UNION ALL SELECT f.phrase, f.j + 1, list_transform(l, lambda p, n: CASE WHEN ring[n + 1] IS NULL OR (ring[n + 1].distance IN (ring[1].distance + p.cost, ring[1].distance + p.cost + 1) AND ring[n + 1].log < ring[1].log + p.log) OR ring[1].distance + p.cost + 1 < ring[n + 1].distance
THEN {'distance': ring[1].distance + p.cost + 1, 'log': ring[1].log + p.log, 'segmented': ring[1].segmented || ' ' || p.part, 'corrected': ring[1].corrected || ' ' || p.word} ELSE ring[n + 1] END) || ring[len(l) + 2 :]
FROM fold f JOIN begun ON begun.phrase = f.phrase AND begun.j = f.j + 1)
SELECT phrase, ring[1].segmented AS segmented, ring[1].corrected AS corrected, ring[1].distance AS distance_sum, round(ring[1].log, 6) AS probability_log_sum FROM fold WHERE j = length(phrase) - 1"""


@query(SEGMENT % candidates_sql(1))
def segment_phrases(spark, sf_dir):
    """Part names without their blanks, split again by the dictionary of their own words."""
    parts = load(spark, sf_dir, "part")
    d = tables.materialised(dictionary.from_corpus(parts, "p_name"), "part-words")
    s = dictionary.stats(d).first()
    phrases = parts.select(F.replace("p_name", F.lit(" "), F.lit("")).alias("phrase")).distinct()
    split = segment.segment(phrases, matching.build_index(d, 1), 1, s["word_max_len"], s["count_sum"])
    return split.withColumn("probability_log_sum", F.round("probability_log_sum", 6))


# sequences
SEQ = "s AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, o_orderkey AS value FROM orders)"


def seq(spark, sf_dir):
    return tables.materialised(sequences.build(load(spark, sf_dir, "orders"), "o_orderkey", "o_orderkey"), "sequence")


@query(f"WITH {SEQ} SELECT p.ord, s.value FROM (SELECT DISTINCT l_orderkey * 3 AS ord FROM lineitem) p LEFT JOIN s USING (ord)")
def ef_get(spark, sf_dir):
    return sequences.get(seq(spark, sf_dir), load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 3).alias("ord")).distinct())


@query(f"WITH {SEQ} SELECT ord, d AS diff FROM (SELECT ord, lead(value) OVER (ORDER BY ord) - value AS d FROM s) WHERE d IS NOT NULL")
def ef_diff(spark, sf_dir):
    return sequences.diff(seq(spark, sf_dir))


@query(f"WITH {SEQ} SELECT ord, (sum(value) OVER (ORDER BY ord))::BIGINT AS total FROM s")
def ef_prefix_sum(spark, sf_dir):
    return sequences.prefix_sum(seq(spark, sf_dir))


@query(f"WITH {SEQ}, x AS (SELECT DISTINCT l_partkey * 7 AS x FROM lineitem) SELECT x, (SELECT min(value) FROM s WHERE value >= x) AS value FROM x")
def ef_next_geq(spark, sf_dir):
    return sequences.next_geq(seq(spark, sf_dir), load(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 7).alias("x")))


# bits
BITS = "b AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, (event_type = 'click')::INT AS bit FROM events)"


def vector(spark, sf_dir):
    return tables.materialised(bits.vector(load(spark, sf_dir, "events"), F.col("event_type") == "click", "event_id"), "bits")


@query(f"WITH {BITS} SELECT pos + 1 AS i, (sum(bit) OVER (ORDER BY pos))::BIGINT AS rank FROM b")
def rank1(spark, sf_dir):
    return bits.rank(vector(spark, sf_dir), 1)


@query(f"WITH {BITS} SELECT pos + 1 AS i, (sum(1 - bit) OVER (ORDER BY pos))::BIGINT AS rank FROM b")
def rank0(spark, sf_dir):
    return bits.rank(vector(spark, sf_dir), 0)


@query(f"WITH {BITS} SELECT row_number() OVER (ORDER BY pos) AS i, pos FROM b WHERE bit = 1")
def select1(spark, sf_dir):
    return bits.select(vector(spark, sf_dir), 1)


@query(f"WITH {BITS} SELECT row_number() OVER (ORDER BY pos) AS i, pos FROM b WHERE bit = 0")
def select0(spark, sf_dir):
    return bits.select(vector(spark, sf_dir), 0)


@query(f"WITH {BITS} SELECT b.pos AS start, min(CASE WHEN bit = 1 THEN pos END) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pos FROM b")
def next_set_bit(spark, sf_dir):
    v = vector(spark, sf_dir)
    return bits.next_bit(v, v.select(F.col("pos").alias("start")), 1)


@query("SELECT event_id, (SELECT p FROM (SELECT p, row_number() OVER (ORDER BY p) AS rn FROM (SELECT unnest(range(0, 64)) AS p) WHERE ((event_id >> (63 - p)) & 1) = 1) WHERE rn = 2) AS second FROM events")
def nth_set_bit(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", bits.nth_set_bit("event_id", 2).cast("long").alias("second"))


@query("SELECT o_custkey, string_agg(right(lpad(bin(o_orderkey), 64, '0'), 9), '' ORDER BY o_orderkey) AS bits FROM orders GROUP BY o_custkey")
def bit_pack(spark, sf_dir):
    """The 9 low bits of each number; most numbers have more."""
    return bits.pack(load(spark, sf_dir, "orders"), "o_orderkey", "o_orderkey", 9, ["o_custkey"])


@query("SELECT o_orderkey, (o_orderkey >> 4) & 255 AS middle FROM orders")
def bit_unpack(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", bits.unpack(bits.bit_text("o_orderkey", 40), 28, 8).alias("middle"))


# hashing
@query(f"WITH {DICT} SELECT word AS key, row_number() OVER (ORDER BY word) - 1 AS slot FROM dict")
def phf_assign(spark, sf_dir):
    return hashing.assign(words(spark, sf_dir).select(F.col("word").alias("key")))


@query(f"WITH {DICT}, {MISSPELL}, t AS (SELECT word AS key, row_number() OVER (ORDER BY word) - 1 AS slot FROM dict) SELECT query AS key, slot FROM q LEFT JOIN t ON query = key")
def phf_lookup_miss(spark, sf_dir):
    d = words(spark, sf_dir)
    return hashing.get(hashing.assign(d.select(F.col("word").alias("key"))), queries_of(d).select(F.col("query").alias("key")))


UNIT = "(l_linenumber - 1) / 8.0::DOUBLE"
BETA = f"({UNIT} + (1 - {UNIT}) * ln(1 - {UNIT}))"


@query(f"WITH e AS (SELECT greatest(0, least(1, 1024 / (5 * sqrt(count(*)::DOUBLE)))) AS eps FROM orders) SELECT l_orderkey, l_linenumber, floor({BETA} * 1000)::BIGINT AS optimal, floor((eps * {UNIT} + (1 - eps) * {BETA}) * 1000)::BIGINT AS mixed, CASE WHEN {UNIT} < 0.6::DOUBLE THEN floor({UNIT} / 0.6::DOUBLE * 300) ELSE 300 + floor(({UNIT} - 0.6::DOUBLE) / (1 - 0.6::DOUBLE) * 700) END::BIGINT AS skewed FROM lineitem, e")
def bucket_mappers(spark, sf_dir):
    """mixed: with the even share that a table of as many keys as orders has."""
    u, eps = (F.col("l_linenumber") - 1) / 8.0, hashing.Config(load(spark, sf_dir, "orders").count()).eps
    at = load(spark, sf_dir, "lineitem")
    return at.select("l_orderkey", "l_linenumber", hashing.optimal_bucket(u, 1000).alias("optimal"), hashing.optimal_bucket(u, 1000, eps).alias("mixed"), hashing.skewed_bucket(u, 1000).alias("skewed"))


# filters
@query("SELECT n, greatest(1, floor(-n * ln(0.01::DOUBLE) / (ln(2) * ln(2))))::BIGINT AS bits, ceil(greatest(1, floor(-n * ln(0.01::DOUBLE) / (ln(2) * ln(2)))) / 8)::BIGINT AS bytes, greatest(1, floor(greatest(1, floor(-n * ln(0.01::DOUBLE) / (ln(2) * ln(2)))) / n * ln(2)))::BIGINT AS hashes FROM (VALUES (7), (100), (10000)) t(n)")
def bloom_formulas(spark, sf_dir):
    rows = [(n, filters.bloom_bits(n, 0.01), filters.bloom_bytes(n, 0.01), filters.bloom_hashes(n, 0.01)) for n in (7, 100, 10000)]
    return spark.createDataFrame(rows, "n int, bits long, bytes long, hashes long")


@query(f"WITH {DICT} SELECT word AS key, true AS maybe FROM dict")
def bloom_probe(spark, sf_dir):
    """Every member is found."""
    d = words(spark, sf_dir).select(F.col("word").alias("key"))
    n = d.count()
    return filters.bloom_contains(filters.bloom_build(d, "key", n), d, "key", n)


@query("WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), p AS (SELECT *, max(rn) OVER (PARTITION BY user_id, event_type ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e) SELECT user_id, event_id, event_type, last IS NOT NULL AND (SELECT count(DISTINCT x.event_type) FROM e x WHERE x.user_id = p.user_id AND x.rn > p.last AND x.rn < p.rn) < 2 AS hit FROM p")
def lru_hits(spark, sf_dir):
    return filters.lru_hits(load(spark, sf_dir, "events"), "user_id", "event_id", "event_type", 2)


# arithmetic and formats
@query("SELECT o_orderkey, o_orderkey // 37 AS q37, o_orderkey // 1 AS q1 FROM orders")
def fast_div(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", arith.fast_div(F.col("o_orderkey"), 37).alias("q37"), arith.fast_div(F.col("o_orderkey"), 1).alias("q1"))


@query("SELECT o_orderkey, o_orderkey % 37 AS r37 FROM orders")
def fast_mod(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", arith.fast_mod(F.col("o_orderkey"), 37).alias("r37"))


@query("SELECT o_orderkey, o_orderkey % 7 = 0 AS by7 FROM orders")
def is_divisible(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", arith.is_divisible(F.col("o_orderkey"), 7).alias("by7"))


@query("SELECT doc_id, n_chars, CASE WHEN n_chars < 1024 THEN n_chars::VARCHAR || ' b' ELSE printf('%.2f Kb', round(n_chars / 1024.0::DOUBLE, 2)) END AS size, CASE WHEN n_chars <= 1 THEN 0 ELSE length(bin(n_chars - 1)) END::INT AS log2 FROM documents")
def human_bytes(spark, sf_dir):
    n = F.col("n_chars")
    return load(spark, sf_dir, "documents").select("doc_id", "n_chars", arith.human_bytes(n).alias("size"), arith.log2_ceil(n).cast("int").alias("log2"))


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def schema_roundtrip(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    path = tables.work_path(spark, "roundtrip")
    tables.write_table(events, path)
    return tables.read_table(spark, path, tables.schema_of_json(tables.schema_json(events.schema)))
