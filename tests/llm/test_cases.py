"""Odd rows and clashing columns for every stage and operator, and results against plain versions on the smallest tables."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import decontam, html_text, linkgraph, mixing, neardup, quality, tiff, token_files, toxicity, warc

DIR = "/root/testdata/sf0.001"
has_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHES = ("_d", "_h", "_id", "_source", "_size", "_n", "_copy", "mix_position", "quality_score", "toxicity", "passages", "id", "h", "y", "hi", "lo", "key", "set", "component_id", "kept", "size", "copies", "target", "words", "place", "term", "pos", "cells", "media", "page", "error", "start", "path", "shard", "_rule", "rule", "digest", "original")


def clashing(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit("mine"))
    return df.withColumn("DocId", F.lit(1)).withColumn("a.b", F.lit(None).cast("string"))


def odd(spark):
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c d e", "en", "s", 9), (3, "a b c d e", "en", "s", 9), (4, "A b c d e", None, None, 9), (5, " \t\n", "en", "t", 3), (6, long, "en", "t", 9), (7, long, "en", "s", 9), (8, "é 日本   \x00 <|x|>", "fr", "é", 4), (None, "no id", "en", "s", 5), (9, "x", "en", "", 1)]
    return spark.createDataFrame(rows, DOCS)


def table(name):
    return pq.read_table(f"{DIR}/{name}.parquet").to_pylist()


@has_tables
def test_token_stage_cases(spark):
    stage = dict(corpus_pipeline.STAGES)["token files"]
    rows = sorted(map(tuple, stage(spark, odd(spark), DIR).select("start", "n_tokens", "ids_crc32").collect()))
    assert rows == sorted(map(tuple, stage(spark, clashing(odd(spark)), DIR).select("start", "n_tokens", "ids_crc32").collect())) and len(rows) == odd(spark).count()
    assert not stage(spark, odd(spark).where("false"), DIR).count()


@has_tables
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_cases(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = stage(spark, odd(spark), DIR)
    assert plain.columns == odd(spark).columns
    want = sorted(map(repr, plain.collect()))
    got = stage(spark, clashing(odd(spark)), DIR)
    assert got.columns == clashing(odd(spark)).columns
    rows = got.collect()
    assert sorted(map(repr, (r for r in got.select(*plain.columns).collect()))) == want
    assert all(r[c] == "mine" for r in rows for c in CLASHES)
    assert stage(spark, odd(spark).where("false"), DIR).count() == 0


@has_tables
def test_operator_cases(spark):
    docs, labels = clashing(odd(spark)), clashing(spark.createDataFrame([(3, 1, 1), (4, 0, 0), (6, 1, 0), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    n = docs.count()
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == n
    assert quality.score(docs, quality.fit(docs, labels)).count() == n
    assert neardup.near_duplicates(docs).count() == n and mixing.mix(docs).count() == n
    items = clashing(spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "x"), (2, None)], "item_id long, text string"))
    assert decontam.contamination(docs, items).count() == n
    assert token_files.write_and_read(docs).count() == n
    media = tiff.media_of_texts(docs)
    assert media.count() == n and tiff.tiff_pages(clashing(docs.select("doc_id")).withColumn("media", F.lit(None).cast("binary"))).count() == 0
    pages = clashing(spark.createDataFrame([(1, "http://a.net/x", "<p>hi"), (1, "http://a.net/x", "<p>hi"), (None, None, None), (2, "", "<a href='http://b.org'>" * 20_000)], "page_id long, url string, html string"))
    assert linkgraph.judged(pages).count() == html_text.extract(pages).count() == warc.read_archives(warc.write_archives(pages)).count() == 4
    none = pages.where("false")
    assert linkgraph.judged(none).count() == html_text.extract(none).count() == tiff.media_of_texts(docs.where("false")).count() == 0
    assert decontam.contamination(docs.where("false"), items).count() == 0 and decontam.contamination(docs, items.where("false")).where("contaminated").count() == 0


def classes(texts):
    """component of each id, by comparing all pairs of full sets."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = len(sets[i]), len(sets[j])
            if a and b and 5 * min(a, b) >= 4 * max(a, b):
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (a + b - both):
                    x, y = sorted((top(i), top(j)))
                    up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_neardup_brute_force(spark):
    """Chains, groups of copies, and texts about the threshold."""
    rng = np.random.default_rng(11)
    texts, i = {}, 0
    for _ in range(12):
        base = [f"v{x}" for x in rng.integers(0, 4000, 120)]
        for _ in range(12):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, 6))):
                w[at] = f"n{rng.integers(0, 10**6)}"
            texts[i] = " ".join(w[: len(w) - int(rng.integers(0, 12))])
            i += 1
            if rng.random() < 0.2:
                base = w
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == classes(texts)


@has_tables
def test_neardup_query(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.op5_neardup(spark, DIR).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in classes({d["doc_id"]: d["text"] for d in table("documents")}).items()}


@has_tables
def test_tokens_and_media(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.tokenizer_path())
    want, start = [], 0
    docs = sorted(table("documents"), key=lambda d: d["doc_id"])
    for d in docs:
        ids = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        want.append((d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.op2_token_files(spark, DIR).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want
    media = {r.doc_id: r for r in tiff.op3_tiff(spark, DIR).collect()}
    for d in docs:
        raw = (d["text"] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = media[d["doc_id"]]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


@has_tables
@pytest.mark.parametrize("query,label,fold", [(toxicity.op1_toxicity, "toxic", lambda i: zlib.crc32(str(i).encode()) % 5 == 0), (quality.op8_quality, "quality", lambda i: zlib.crc32(str(i).encode()) % 3 == 1)])
def test_held_out(spark, query, label, fold):
    """Accuracy on rows that were not learned from, at sf0.01."""
    folder = DIR.replace("0.001", "0.01")
    rows = query(spark, folder).collect()
    assert all(r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = {r["doc_id"]: r[label] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    seen = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in seen) >= 0.9 * len(seen)


def test_rank_brute_force(spark):
    """Ranks against plain power iteration, with hosts without links."""
    rng = np.random.default_rng(3)
    edges = {(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, 30, 90), rng.integers(0, 40, 90), rng.integers(1, 5, 90), strict=True) if a != b}
    seeds = [1, 2, 3]
    m = np.zeros((40, 40))
    for (a, b), w in edges.items():
        m[a, b] = w
    out = m.sum(1, keepdims=True)
    m = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
    s = np.zeros(40)
    s[seeds] = 1 / 3
    p = s.copy()
    for _ in range(200):
        p = 0.85 * p @ m + 0.15 * s
        p += (1 - p.sum()) * s
    e = spark.createDataFrame([(f"h{a}", f"h{b}", w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    got = {r.host: r["rank"] for r in linkgraph.personalised_rank(e, spark.createDataFrame([(f"h{k}", 1 / 3) for k in seeds], "host string, seed double"), rounds=60, every=1).collect()}
    assert set(got) == {f"h{k}" for k in range(40) if p[k] > 0}
    assert max(abs(got[f"h{k}"] - p[k]) for k in range(40) if p[k] > 0) < 1e-6


@has_tables
def test_trust_rank(spark):
    """Eight rounds over a graph with links, against its SQL."""
    from tests.test_queries import same

    rows = linkgraph.trust_rank(spark, DIR)
    same(rows, linkgraph.TRUST_SQL, DIR)
    assert rows.where("trust > 0").count() > 10 and rows.where("distrust > 0").count() > 2


@has_tables
def test_neardup_sql(spark):
    from tests.test_queries import same

    same(neardup.op5_neardup(spark, DIR), neardup.OP5_SQL, DIR)


@pytest.mark.parametrize("seeds", [1, 300])
def test_verdict_of_many_seeds(spark, seeds):
    """A host that links to a blocked one alone is blocked, however many seeds and linkers share the distrust."""
    rows = [(f"http://s{k}.net/", "") for k in range(seeds)] + [(f"http://l{k}.org/p", '<a href="http://s0.net/">') for k in range(3000)]
    got = linkgraph.judged(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string"))
    assert got.where("verdict = 'block' and host like 'l%'").count() == 3000


def test_rank_defaults(spark):
    """A chain, a loop and a host without links behind one seed, with the rounds that op6 uses."""
    links = [(k, k + 1) for k in range(13)] + [(0, 20), (20, 21), (21, 20), (21, 22)]
    q = np.zeros(23)
    m = np.zeros((23, 23))
    for a, b in links:
        m[a, b] = 1 / sum(x == a for x, _ in links)
    q = np.linalg.solve(np.eye(23) - 0.85 * m.T, np.eye(23)[0])
    e = spark.createDataFrame([(f"h{a}", f"h{b}", 1.0) for a, b in links], "src string, dst string, weight double")
    got = {r.host: r["rank"] for r in linkgraph.personalised_rank(e, spark.createDataFrame([("h0", 1.0)], "host string, seed double")).collect()}
    assert set(got) == {f"h{k}" for k in range(23) if q[k] > 0} and "h13" in got
    assert all(abs(x - q[int(h[1:])] / q.sum()) < 1e-5 * x for h, x in got.items())


@has_tables
def test_pipeline_plain(spark):
    """The stages' plain versions on what each stage was given: kept rows are the plain version's, and the last one's files hold the mix."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, DIR).cache()
    voted = {r.doc_id for r in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))).collect() if r.quality_score >= 0.5}
    assert {r.doc_id for r in good.collect()} == voted
    single = stages["near duplicates"](spark, good, DIR).cache()
    assert {r.doc_id for r in single.collect()} == {c for _, c in classes({r.doc_id: r.text for r in good.collect()}).values()}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for b in table("benchmark"):
        w = words(b["text"])
        n = min(10, len(w))
        windows[n] |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    clean = {r.doc_id for r in single.collect() if not any(tuple(w[k : k + n]) in g for w in [words(r.text)] for n, g in windows.items() for k in range(len(w) - n + 1))}
    kept = stages["decontamination"](spark, single, DIR).cache()
    assert {r.doc_id for r in kept.collect()} == clean
    mixed = stages["mixing"](spark, kept, DIR).cache()
    taken = {r.doc_id: r.copies for r in mixing.mix(kept).collect() if r.copies}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == taken
    files = corpus_pipeline.run(spark, DIR).collect()
    assert collections.Counter(r.doc_id for r in files) == taken
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.tokenizer_path())
    texts, start = {r.doc_id: r.text for r in mixed.collect()}, 0
    for r in sorted(files, key=lambda r: (r.doc_id, r.start)):
        ids = [*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for df in (good, single, kept, mixed):
        df.unpersist()
