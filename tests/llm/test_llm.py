import json
import zlib

import numpy as np
import pytest

from textloom.llm import decontam, html_text, linkgraph, mixing, neardup, quality, tiff, token_files, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=()):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts] + list(extra), DOCS)


EDGE = [(1, None), (2, ""), (3, "a b c d e f g h i j k"), (4, "a b c d e f g h i j k"), (5, " \n\t"), (None, "x y"), (7, "word " * 5000)]


def test_token_files(spark):
    got = {(r.doc_id): r for r in token_files.write_and_read(docs(spark, EDGE)).collect()}
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.tokenizer_path())
    start = 0
    for i, t in sorted(EDGE, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not token_files.write_and_read(docs(spark, [])).count()


def test_checksum(tmp_path):
    parts = list(token_files.shard_bytes([(1, b"\1\0\2\0"), (2, b"\3\0")], 2))
    (tmp_path / "s").write_bytes(b"".join(parts))
    s = token_files.Shard(str(tmp_path / "s"))
    assert [s.ids(i).tolist() for i in (1, 0)] == [[3], [1, 2]]
    s.table = s.table.copy()
    s.table[0, 2] ^= 1
    s.kept = (-1, b"")
    with pytest.raises(ValueError):
        s.ids(0)


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff(compression, predictor, order):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 9, (37, 53), dtype=np.uint8), rng.integers(0, 60000, (20, 33, 3), dtype=np.uint16)]
    for tile in (None, (16, 16)):
        found = list(tiff.pages(tiff.build(images, compression, predictor, 8, order, tile)))
        assert len(found) == 2
        for page, image in zip(found, images, strict=True):
            assert (page.samples.reshape(image.shape) == image).all()


def test_tiff_pages(spark):
    df = spark.createDataFrame([(1, bytearray(tiff.encode(tiff.payload_of(b"x" * 2000)))), (2, None), (3, bytearray(b"no"))], "id long, media binary")
    rows = tiff.tiff_pages(df).collect()
    assert [(r.id, r.page, r.height) for r in rows if r.error is None] == [(1, 0, 4)]
    assert [r.id for r in rows if r.error] == [3]


def test_tiff_pages_behind_an_error(spark):
    image = np.arange(64, dtype=np.uint8).reshape(8, 8)
    medium = bytearray(tiff.build([image, image, image]))
    at = tiff.fields_of(medium, int.from_bytes(medium[4:8], "little"), "<")[1]
    for k in range(int.from_bytes(medium[at : at + 2], "little")):
        if int.from_bytes(medium[at + 2 + 12 * k : at + 4 + 12 * k], "little") == tiff.PREDICTOR:
            medium[at + 10 + 12 * k] = 3
    rows = tiff.tiff_pages(spark.createDataFrame([(1, medium)], "id long, media binary")).orderBy("page").collect()
    assert [(r.page, r.data and bytes(r.data) == image.tobytes(), bool(r.error)) for r in rows] == [(0, True, False), (1, None, True), (2, True, False)]


def test_neardup(spark):
    base = [f"w{k}" for k in range(60)]
    texts = [*EDGE, (20, " ".join(base)), (21, " ".join(base[:-1]) + " other"), (22, "P " + " ".join(base[10:50])), (23, " ".join(base).upper())]
    got = {r.doc_id: r for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 4, 5, 20, 21, 22, 23)] == [1, 2, 3, 3, 5, 20, 20, 22, 20]
    assert got[None].component_id is None and got[None].kept and got[1].n_shingles == 0 and got[7].n_shingles == 1
    assert not neardup.near_duplicates(docs(spark, [])).count()


def test_decontam(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "x Y"), (3, None), (4, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs(spark, [*EDGE, (9, "zz A b c d e f g h i j zz x-y")]), items).collect()}
    assert [(got[i].n_words, got[i].n_hit, got[i].n_items) for i in (1, 2, 3, None, 9)] == [(0, 0, 0), (0, 0, 0), (11, 11, 1), (2, 2, 1), (14, 12, 2)]
    assert decontam.proximity(docs(spark, [(1, "y q x")]), items.where("item_id = 2"), 5).count() == 1


def test_terms_start_no_python(spark, monkeypatch):
    """The table of terms is made by the executors' JVMs alone: rows of Python's would start processes there that stay and take memory."""
    monkeypatch.setattr(decontam, "written", lambda df, *_: df)
    items = spark.range(2).selectExpr("id as item_id", "array('a', 'b') as words")
    terms = decontam.term_table(items)
    assert "RDD" not in terms._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.term for r in terms.collect()) == ["", "a", "b"] and {r.id for r in terms.where("term = ''").collect()} == {0} and terms.dtypes == [("term", "string"), ("id", "bigint")]


def test_mixing(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", s, 0) for i in range(200) for s in ("a", None)] + [(900, None, "en", "b", 0)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    total = sum(r.size for r in got)
    assert abs(sum(r.taken for r in got) - total) < 20
    assert not mixing.mix(spark.createDataFrame([], DOCS)).count()


@pytest.mark.parametrize("weights", [mixing.WEIGHTS, (1.0, 5.0)])
def test_mix_is_what_mix_says(spark, weights):
    """The mix takes each row as often as `mix` says, with repeated rows, rows of one id and different texts, and null ids and sources."""
    import collections

    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(0, 40)), "w " * int(rng.integers(1, 6)), "en", (None, "a", "b")[int(rng.integers(0, 3))], 0) for _ in range(400)]
    rows += [(1, "a b c", "en", "a", 0)] * 4 + [(1, "d e f", "en", "a", 0)] * 2 + [(None, "x y", "en", None, 0)] * 3 + [(2, "", "en", "a", 0)]
    d = spark.createDataFrame(rows, DOCS)
    said = collections.Counter()
    for r in mixing.mix(d, weights=weights).collect():
        said[r.doc_id, r.size] += r.copies
    got = mixing.mixed_documents(d, weights=weights).collect()
    assert collections.Counter((r.doc_id, len(r.text.split())) for r in got) == +said
    texts = collections.Counter((r[0], r[1], r[3]) for r in rows)
    assert all(n <= 3 * texts[k] for k, n in collections.Counter((r.doc_id, r.text, r.source) for r in got).items())
    assert [r.mix_position for r in got] == sorted(r.mix_position for r in got) and all(0 <= r.mix_position <= 1 for r in got)


def test_water_level(spark):
    """Targets against plain filling: in turn the fullest source is closed."""
    rng = np.random.default_rng(3)
    for _ in range(4):
        sizes = {f"s{k:02d}": int(rng.integers(1, 10_000) ** rng.uniform(0.3, 1)) for k in range(15)}
        got = {r.source: r.target for r in mixing.shares(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        w = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))}
        left, open_, want = float(sum(sizes.values())), set(sizes), {}
        while open_:
            level = left / sum(w[s] for s in open_)
            full = [s for s in open_ if 3 * sizes[s] < level * w[s]]
            if not full:
                want |= {s: level * w[s] for s in open_}
                break
            for s in full:
                want[s] = 3.0 * sizes[s]
                left -= want[s]
                open_.remove(s)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * want[s] for s in want)


def test_votes(spark):
    """The nearest, of equal ones the first; a score by plain steps; repeated labelled rows with different texts fit alike in any order."""
    rng = np.random.default_rng(1)
    cos = rng.integers(0, 5, (200, 30)).astype(np.float32)
    for k in (1, 7, 30):
        assert quality.nearest(cos, k).tolist() == [sorted(sorted(range(30), key=lambda j: (-row[j], j))[:k]) for row in cos]
    texts = [(i % 90, "good words here. " * (i % 5 + 1) if i % 2 else "zz,, !!" * (i % 4 + 1)) for i in range(120)]
    d, labels = docs(spark, texts), spark.createDataFrame([(i, i % 2, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    m, again = quality.fit(d, labels), quality.fit(d.repartition(5), labels.repartition(4))
    assert (m.vectors == again.vectors).all() and (m.labels == again.labels).all()
    x = quality.terms(np.frombuffer(texts[3][1].encode(), np.uint8), np.array([0, len(texts[3][1])]))
    z = (x * m.idf) @ m.axes
    c = m.vectors @ (z[0] / np.linalg.norm(z[0]))
    near = sorted(range(len(c)), key=lambda j: (-c[j], j))[: m.k]
    w = np.maximum(c[near], 0) ** m.sharp
    score = quality.score(docs(spark, [texts[3]]), m).first().quality_score
    assert abs(score - (w * m.labels[near]).sum() / w.sum()) < 1e-3


def test_equal_trust(spark):
    """As much distrust as trust allows."""
    rows = [(1, "http://good.org/fr/", '<a href="http://x.com/">'), (2, "http://x.com/", '<a href="http://bad.net/">'), (3, "http://bad.net/", "")]
    got = {r.page_id: r for r in linkgraph.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert abs(got[2].trust - got[2].distrust) < 1e-9 and got[2].verdict == "allow"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in linkgraph.judged(pages, threshold=0.9).collect()}[2] == "block"


def test_very_long(spark):
    """Texts far longer than a batch or a chunk, and empty tables, in every operator on documents."""
    long = " ".join(f"w{k % 5003}" for k in range(400_000))
    d = docs(spark, [(1, long), (2, long + " end"), (3, "short text"), (4, None)])
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(d, toxicity.fit(d, labels)).count() == quality.score(d, quality.fit(d, labels)).count() == 4
    got = {r.doc_id: r for r in neardup.near_duplicates(d).collect()}
    assert (got[1].component_id, got[2].component_id, got[3].component_id) == (1, 1, 3)
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20, 40)))], "item_id long, text string")
    hit = {r.doc_id: (r.n_words, r.n_hit) for r in decontam.contamination(d, items).collect()}
    assert hit == {1: (400_000, 20 * 80), 2: (400_001, 20 * 80), 3: (2, 0), 4: (0, 0)}
    assert {r.doc_id: r.size for r in mixing.mix(d).collect()} == {1: 400_000, 2: 400_001, 3: 2, 4: 0}
    page = spark.createDataFrame([(1, "http://a/", f"<p>{long}")], "page_id long, url string, html string")
    assert html_text.extract(page).first().n_chars == len(long) and warc.read_archives(warc.write_archives(page)).first().payload_bytes == len(long) + 3
    none = d.where("false")
    assert not toxicity.score(none, toxicity.fit(none, labels)).count() and not quality.score(none, quality.fit(none, labels)).count()


def test_models(spark):
    rng = np.random.default_rng(5)  # texts of their own: copies of one text count once in training
    texts = [(i, ("vile slur " * 2 if i % 4 == 0 else "") + " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(20))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, [*texts, (1000, None), (1001, ""), (None, "vile slur")])
    m = toxicity.fit(d, labels)
    got = {r.doc_id: r.toxicity for r in toxicity.score(d, m).collect()}
    assert got[8] > 0.5 > got[1] and got[1000] == got[1001] < 0.5
    spans = toxicity.score(docs(spark, texts[:1]), m, spans=True).first().passages
    assert spans and texts[0][1].encode()[spans[0].start : spans[0].end].startswith(b"vile")
    q = quality.fit(d, labels, 300)
    assert all(0 <= r.quality_score <= 1 for r in quality.score(d, q).collect())
    assert {r.quality_score for r in quality.score(d, quality.fit(d, labels.where("false"))).collect()} == {0.5}


def test_texts_that_share_words(spark):
    """Texts that share the words with the least hashes aren't copies: each of them counts in training."""
    rng = np.random.default_rng(6)
    texts = [("vile slur " if i % 4 == 0 else "") + " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(20)) for i in range(400)]
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    starts, ends, _ = toxicity.tokens_of(data, np.array([0, len(data)]))
    hashes = toxicity.word_hashes(data, starts, ends)
    least = [int((hashes * np.uint64(k)).argmin()) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    shared = " ".join(data[starts[k] : ends[k]].tobytes().decode() for k in least)
    d = docs(spark, [(i, f"{t} {shared}") for i, t in enumerate(texts)])
    m = toxicity.fit(d, spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.toxicity for r in toxicity.score(d.where("doc_id < 12"), m).collect()}
    assert got[8] > 0.5 > got[1]


def test_segments():
    rng = np.random.default_rng(2)
    for _ in range(200):
        s = rng.integers(-5, 4, 12).astype(float)
        run, index = np.cumsum(s), np.flatnonzero(s > 0)
        found = toxicity.segments(index, run[index] - s[index], run[index])
        best = max((s[a : b + 1].sum() for a in range(12) for b in range(a, 12)), default=0)
        assert (max((x for *_, x in found), default=0)) == max(best, 0)
        assert all(s[a : b + 1].sum() == x for a, b, x in found)


def plain_segments(s, first=0):
    """All maximal scoring segments by their definition: the best one (the shortest, then leftmost, of equals), then those left and right of it."""
    spans = [(s[a : b + 1].sum(), -(b - a), -a) for a in range(len(s)) for b in range(a, len(s))]
    if not spans or max(spans)[0] <= 0:
        return []
    total, length, a = max(spans)
    a, b = -a, -a - length
    return plain_segments(s[:a], first) + [(first + a, first + b, total)] + plain_segments(s[b + 1 :], first + b + 1)


def test_all_segments():
    rng = np.random.default_rng(8)
    for _ in range(150):
        s = rng.normal(-0.3, 2, int(rng.integers(0, 25)))
        got = toxicity.found_in(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain_segments(s)]
        assert np.allclose([x for *_, x in got], [x for *_, x in plain_segments(s)])


def test_extreme_values():
    """The fit finds the law that values were drawn from, and evidence is the least of the sums' p values."""
    rng = np.random.default_rng(9)
    n = rng.integers(50, 3000, 4000).astype(float)
    best = np.maximum(0, -np.log(-np.log(rng.random(4000)) / (0.02 * n)) / 0.7)
    lam, k = toxicity.extreme_value(best, n)
    assert abs(lam - 0.7) < 0.05 and abs(k - 0.02) < 0.005
    x = [0.7 * s - np.log(0.02 * 500) for s in (20.0, 9.0, 5.0)]
    p = [np.exp(-sum(x[:r])) * sum(x[:r]) ** (r - 1) / (np.prod(np.arange(1, r + 1)) * np.prod(np.arange(1, r))) * 2**r for r in (1, 2, 3)]
    assert abs(toxicity.evidence([5.0, 20.0, 9.0, 1.0], 500, 0.7, 0.02) + np.log(min(p))) < 1e-9
    assert toxicity.evidence([], 500, 0.7, 0.02) == toxicity.evidence([1.0], 500, 0.7, 0.02) == 0


def test_whole_score(spark):
    """A document's score by plain steps, and two fits that agree."""
    import math

    rng = np.random.default_rng(5)
    texts = [(i, ("vile slur " * 2 if i % 4 == 0 else "") + " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(20))) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    d = docs(spark, texts)
    m, again = toxicity.fit(d, labels), toxicity.fit(d.repartition(7), labels.repartition(3))
    assert (m.lam, m.k, m.coef) == (again.lam, again.k, again.coef) and (m.weights == again.weights).all()
    got = {r.doc_id: r.toxicity for r in toxicity.score(d, m).collect()}
    for i in (0, 1, 8):
        data = np.frombuffer(texts[i][1].encode(), np.uint8)
        scores = []
        for w in texts[i][1].split():
            parts = [np.frombuffer(w.encode(), np.uint8)] + [np.frombuffer(w[:h].encode(), np.uint8) for h in toxicity.HEADS if len(w) > h]
            cells = [int(toxicity.word_hashes(x, np.array([0]), np.array([len(x)]))[0] * np.uint64(2 * len(x) + 1 if j else 1) >> np.uint64(64 - toxicity.BITS)) for j, x in enumerate(parts)]
            odds = [float(m.weights[c]) for c in cells]
            scores.append(max(odds, key=abs) - m.drift)
        stat = math.log1p(toxicity.evidence([x for *_, x in plain_segments(np.array(scores))], len(scores), m.lam, m.k))
        assert abs(got[i] - 1 / (1 + math.exp(-m.coef[0] - m.coef[1] * stat))) < 1e-9 and len(data)


def test_warc(spark):
    big = "é" * 600
    rows = [(1, "http://a/\nb", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = warc.read_archives(warc.write_archives(pages))
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in records.collect()}
    assert got == {1: ("revisit", 2, 1200), 2: ("response", None, 1200), 3: ("response", None, 5), 4: ("response", None, 5), 5: ("response", None, 0), None: ("response", None, 1200)}
    assert [r.page_id for r in warc.resolve(records).collect()] == [1]
    assert not warc.read_archives(warc.write_archives(pages.where("false"))).count()


def test_html(spark):
    page = '<html><body><nav><li><a href=x>menu</a></nav><div class="ad">buy</div><article><h1>T &amp; u</h1><p>one\n two<br>three<p>four<script>"</p>"</script></article><div class="comments"><p>hi</div><footer>end</footer>'
    assert html_text.main_text(page) == "T & u\n\none two three\n\nfour"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    plain = "<div id=nav>a b</div>" + "".join(f"<p>{'long text ' * 20}{k}</p>" for k in range(4)) + "<aside>x</aside>"
    assert html_text.main_text(plain).count("\n\n") == 3


def test_html_outside_article():
    long = " ".join(["real words of the text"] * 15)
    card = "<article class=card><p>Read this too</article>"
    main = f"<div id=content><p>{long} one<p>{long} two</div>"
    for page in (main + card, card + main):
        assert f"{long} one\n\n{long} two" in html_text.main_text(page)
    assert html_text.main_text(f"<article><p>{long} a<p>Short.</article><div>&copy; us</div>") == f"{long} a\n\nShort."
    assert html_text.main_text(f"<div>{long} b</div><article><p>{long} a<p>{long} c</article>") == f"{long} b\n\n{long} a\n\n{long} c"


def test_html_short_end():
    """A short last paragraph behind an advert, in a block of its own or in the body, whole or with a div for each paragraph."""
    long = " ".join(["real words of the text"] * 15)
    for tag in ("p", "div", "blockquote"):
        text = f"<p>{long}</p><{tag}>{long}</{tag}><div class=ad><p>buy</p></div><{tag}>Short end.</{tag}>"
        for page in (text, f"<body>{text}", f"<div>{text}</div><nav>x</nav><div><p>Apart</p><p>from it</p></div>", f"<div>{text}</div><div><p>Apart</p><p>from it</p></div>", f"<section><div>{text}</div></section><footer>x</footer><div><p>Apart</p><p>from it</p></div>"):
            assert html_text.main_text(page) == f"{long}\n\n{long}\n\nShort end."


def test_html_distribution_decides():
    """Without names that tell, the sums over lines tell the text from short lines and links; with a surge that nothing reaches, all but the largest region goes."""
    long = " ".join(["real words of the text"] * 15)
    menu = "".join(f"<li><a href=/{k}>menu entry {k}</a>" for k in range(9))
    page = f"<ul>{menu}</ul><div><p>{long} a<p>short<p>{long} b</div><ul>{menu}</ul><div><p>{long} c<p>{long} d</div><ul>{menu}</ul><p>imprint"
    assert html_text.main_text(page) == f"{long} a\n\nshort\n\n{long} b\n\n{long} c\n\n{long} d"
    assert html_text.main_text(page, surge=10**6) == f"{long} a\n\nshort\n\n{long} b"
    assert html_text.main_text(page, share=1.0) == f"{long} a\n\nshort\n\n{long} b"
    assert "imprint" in html_text.main_text(page, surge=-1, share=0)


def test_html_regions():
    """Regions against plain sums of every window."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        sizes, w, surge = [int(x) * int(rng.integers(0, 2)) for x in rng.integers(0, 60, 25)], int(rng.integers(1, 5)), 70
        runs, at = [], 0
        while at < 25:  # lines between w empty ones
            if sizes[at]:
                to = at
                while to < 25 and any(sizes[to : to + w]):
                    to += 1
                runs.append((at, max(k for k in range(at, to) if sizes[k]) + 1))
                at = to
            at += 1
        surging = [any(sum(sizes[max(a, k - w + 1) : k + 1]) > surge for k in range(a, b)) for a, b in runs]
        found, low = html_text.regions(sizes, w, surge)
        assert [x[:2] for x in found] == [r for r, s in zip(runs, surging, strict=True) if s] and [x[:2] for x in low] == [r for r, s in zip(runs, surging, strict=True) if not s]
        assert all(x[2] == sum(sizes[x[0] : x[1]]) for x in found + low)


@pytest.mark.parametrize("unit", ["<a ", '<a "', '<a "> "', "<div class=ad>", "<!--", "<script>", "<div><p>x", "&amp", "<a href='x\" >"])
def test_html_hostile(unit):
    """A megabyte of broken markup takes time in proportion to its length."""
    import time

    began = time.process_time()
    html_text.main_text(unit * (1_000_000 // len(unit)))
    html_text.main_text("".join(f"<x{i} class=ad>" for i in range(20_000)))
    assert time.process_time() - began < 6


def test_links(spark):
    rows = [(1, "http://A.net/x?y", '<a href="https://b.org/z">'), (2, "https://www.example.net/en/1", None), (3, None, ""), (4, "x", ""), (5, "http://c.org/p", '<a href="//a.net/">'), (6, "http://b.org", "")]
    got = {r.page_id: r for r in linkgraph.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (1, 2, 3, 5, 6)] == [("a.net", "/x", "net/", "block"), ("www.example.net", "/en/1", "example.net/en/", "allow"), ("", "", None, "allow"), ("c.org", "/p", None, "block"), ("b.org", "", None, "allow")]


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d).collect()
    assert out and json.dumps(sorted(out[0].asDict())) == '["doc_id", "ids_crc32", "n_tokens", "start"]'


def test_ranks_without_broadcast(spark, monkeypatch):
    """Edges go to no one by way of the driver, however small they are as a file."""
    plans, written = [], linkgraph.written
    edges = written(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0)], "src string, dst string, weight double"), "edges")
    seeds = written(spark.createDataFrame([("a", 1.0)], "host string, seed double"), "seeds")
    monkeypatch.setattr(linkgraph, "written", lambda df, name: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or written(df, name))
    assert linkgraph.personalised_rank(edges, seeds, rounds=2).count() == 3
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
