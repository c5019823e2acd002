"""Files and media: other tokenizers, single frames, images put together by hand, archives member by member."""

import gzip
import io
import struct
import zlib

import numpy as np
import pytest

from textloom.llm import tiff, token_files, warc

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer(spark, name):
    """Ids as the library's, by the table of pieces where the file says that it holds, else by whole texts."""
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path(name)
    tok = Tokenizer.from_file(path)
    texts = ["Hello, world's  end 42", "naïve Ünïcode — 日本", "a" * 300, "<|endoftext|> x", "", "tabs\tand\nlines  ", "I'll we've they'd 3.14", "ẞ İ K"]
    got = {r.doc_id: r for r in token_files.write_and_read(spark.createDataFrame(list(enumerate(texts)), DOCS), path).collect()}
    for i, text in enumerate(texts):
        assert got[i].ids_crc32 == zlib.crc32(np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()), text
    assert token_files.Encoder(path).pieces == name.startswith("word")


PIECES = ["'", "''s", "\"'s", "'re", "'r", "'ve", "'v", "I'LL", "l'l", "x'", "1's", "'sam", "'s's", "'d'", "(it's)", "don't...", "a\x1cb", "\x7f", "a\0b", "\0", "ÀÉŽ", "àéž", "a×b", "÷", "ŉ", "e\u0301", "x\u00a0y", "<|", "|>", "</w>", "3.14", "é" * 12, "é" * 13, "k" * 24, "k" * 25, "-" * 60]


def test_pieces_by_table(monkeypatch):
    """Ids are the library's whatever stands in the table: with next to no slots, a table that is emptied again and again, and texts cut in parts. New pieces of many texts are learned together."""
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path()
    tok = Tokenizer.from_file(path)
    rng = np.random.default_rng(3)
    texts = [*PIECES, *("".join(rng.choice([*PIECES, " ", "\n", "\t", "the", "House", "ing"], 40)) for _ in range(400)), "", " ", "no space " * 9, "unbroken" * 40]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert token_files.Encoder(path)(texts) == want
    small = token_files.Encoder(path, bits=3, most=20)
    assert [x for k in range(0, len(texts), 7) for x in small(texts[k : k + 7])] == want and small.table.nbytes == 8 * 32
    monkeypatch.setattr(token_files, "AT_ONCE", 50)
    assert token_files.Encoder(path)(texts) == want
    monkeypatch.undo()
    calls, learn = [], token_files.Encoder.learn
    monkeypatch.setattr(token_files.Encoder, "learn", lambda self, new: calls.append(len(new)) or learn(self, new))
    token_files.Encoder(path)([f"a {'x' * k}y" for k in range(20)] * 10)
    assert calls == [21]


def test_single_frames(tmp_path):
    """Reading one document touches its frame alone: the others are broken here."""
    docs = [(k, np.arange(k, k + 50, dtype="<u2").tobytes()) for k in range(40)]
    path = tmp_path / "s.tlz"
    path.write_bytes(b"".join(token_files.shard_bytes(docs, 2, frame_bytes=400)))
    s = token_files.Shard(str(path))
    assert len(s.table) == 10
    raw = bytearray(path.read_bytes())
    a, b = int(s.at[5]), int(s.at[6])
    path.write_bytes(b"\0" * a + bytes(raw[a:b]) + b"\0" * (int(s.at[-1]) - b) + bytes(raw[int(s.at[-1]) :]))
    s = token_files.Shard(str(path))
    assert s.ids(21).tolist() == list(range(21, 71)) and s.frame[21] == 5
    with pytest.raises(Exception):
        s.ids(0)


def test_shard_frames_stand_alone(tmp_path):
    """Each frame is one of zstandard, the tables are skippable frames: any decoder reads the ids."""
    import zstandard

    parts = list(token_files.shard_bytes([(1, b"\1\0" * 300), (None, b"\2\0")], 2, frame_bytes=100))
    raw = b"".join(zstandard.ZstdDecompressor().decompress(p) for p in parts[:-2])
    assert raw == b"\1\0" * 300 + b"\2\0" and all(struct.unpack("<I", p[:4])[0] in (token_files.INDEX_MAGIC, token_files.SEEK_MAGIC) for p in parts[-2:])
    assert list(token_files.shard_bytes([], 2))[-1][-4:] == struct.pack("<I", token_files.SEEKABLE)


def test_read_documents(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.tokenizer_path())
    docs = spark.createDataFrame([(k, f"text number {k} " * (k % 9)) for k in range(300)], DOCS)
    index = token_files.write_shards(docs, token_files.tokenizer_path(), shard_bytes_of_text=4000)
    catalog = token_files.written(token_files.read_shards(index), "catalog")
    assert catalog.select("path").distinct().count() > 3 and sum(r.n_tokens for r in catalog.collect()) == sum(r.tokens for r in index.collect())
    got = {r.doc_id: r.ids for r in token_files.read_documents(catalog, spark.createDataFrame([(7,), (7,), (299,), (1000,)], "doc_id long")).collect()}
    assert got == {k: [*tok.encode(f"text number {k} " * (k % 9), add_special_tokens=False).ids, 1] for k in (7, 299)}


def image(tags, data, order="<"):
    """A TIFF of one page: entries (tag, type, values) as the public format lays them out, then the data; the word `at` stands for the data's place."""
    n, head = len(tags), 8 + 2 + 12 * len(tags) + 4
    extra, entries = b"", b""
    sizes = {3: ("H", 2), 4: ("I", 4)}
    for tag, kind, values in tags:
        letter, width = sizes[kind]
        long = width * len(values) > 4
        place = head + len(extra)
        if long:
            extra += b"\0" * (width * len(values))
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + (struct.pack(order + "I", place) if long else b"\0\0\0\0")
    at = head + len(extra)
    extra, out = b"", entries
    for k, (_, kind, values) in enumerate(tags):
        letter, width = sizes[kind]
        raw = struct.pack(f"{order}{len(values)}{letter}", *[at + v[1] if isinstance(v, tuple) else v for v in values])
        if len(raw) > 4:
            extra += raw
        else:
            out = out[: 12 * k + 8] + raw.ljust(4, b"\0") + out[12 * k + 12 :]
    start = b"II*\0" if order == "<" else b"MM\0*"
    return start + struct.pack(order + "I", 8) + struct.pack(order + "H", n) + out + b"\0\0\0\0" + extra + data


def base(width, height, bits, compression, size, rows=None, **more):
    tags = {256: (3, [width]), 257: (3, [height]), 258: (3, [bits]), 259: (3, [compression]), 262: (3, [1]), 273: (4, [("at", 0)]), 277: (3, [1]), 278: (3, [rows or height]), 279: (4, [size])}
    tags |= {int(k[1:]): v for k, v in more.items()}
    return [(t, *v) for t, v in sorted(tags.items())]


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_by_hand(order):
    """Images whose bytes come from the format's own description, not from this module's writer."""
    # the sample of PackBits in the public description of the scheme
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.unpack_bits(packed, 24) == plain and tiff.unpack_bits(tiff.pack_bits(plain), 24) == plain
    (page,) = tiff.pages(image(base(24, 1, 8, 32773, len(packed)), packed, order))
    assert page.samples.tobytes() == plain
    # LZW codes of 9 bits, high bit first: clear, 7, then the strings 258 (7 7) and 259 (7 7 7), 8, end
    codes = [256, 7, 258, 259, 8, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    lzw = bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))
    (page,) = tiff.pages(image(base(7, 1, 8, 5, len(lzw)), lzw, order))
    assert page.samples.ravel().tolist() == [7] * 6 + [8]
    # one bit, 10 to a row: rows end on whole bytes
    (page,) = tiff.pages(image(base(10, 2, 1, 1, 4), bytes([0b10100000, 0b11000000, 0b00000001, 0b01000000]), order))
    assert page.samples[:, :, 0].tolist() == [[1, 0, 1, 0, 0, 0, 0, 0, 1, 1], [0, 0, 0, 0, 0, 0, 0, 1, 0, 1]] and page.bits == 1
    (page,) = tiff.pages(image(base(3, 1, 4, 1, 2), bytes([0x1F, 0x70]), order))
    assert page.samples.ravel().tolist() == [1, 15, 7]
    # deflate with differences, 16 bits
    raw = zlib.compress(np.array([5, 3, 65535], f"{order}u2").tobytes())
    (page,) = tiff.pages(image(base(3, 1, 16, 8, len(raw), t317=(3, [2])), raw, order))
    assert page.samples.ravel().tolist() == [5, 8, 7]
    # two planes, each a strip
    raw = bytes([1, 2, 3, 4, 9, 8, 7, 6])
    tags = base(2, 2, 8, 1, 4, t258=(3, [8, 8]), t277=(3, [2]), t284=(3, [2]), t273=(4, [("at", 0), ("at", 4)]), t279=(4, [4, 4]))
    (page,) = tiff.pages(image(tags, raw, order))
    assert page.samples.tolist() == [[[1, 9], [2, 8]], [[3, 7], [4, 6]]]
    # floating point with predictor 3: bytes of equal rank together, high ones first, then differences along the row
    values = np.array([1.5, -2.25, 1e9], "f4")
    lanes = np.frombuffer(values.astype(">f4").tobytes(), np.uint8).reshape(3, 4).T.ravel()
    raw = np.diff(lanes, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    (page,) = tiff.pages(image(base(3, 1, 32, 1, 12, t317=(3, [3]), t339=(3, [3])), raw, order))
    assert page.samples.ravel().tolist() == values.tolist()


def test_tiff_hostile(spark):
    """Sizes that no data stand behind, missing strips, and 0 rows are errors of their page and take no memory."""
    good = tiff.build([np.arange(64, dtype=np.uint8).reshape(8, 8)])
    bad = [
        image([(256, 4, [2_000_000]), (257, 4, [2_000_000]), (258, 3, [8]), (259, 3, [1]), (273, 4, [("at", 0)]), (278, 4, [2_000_000]), (279, 4, [1])], b"x"),
        image(base(8, 8, 8, 1, 64, rows=2), bytes(64)),
        image([(256, 3, [8]), (257, 3, [8]), (258, 3, [8]), (259, 3, [1]), (273, 4, [("at", 0)]), (278, 4, [0]), (279, 4, [64])], bytes(64)),
        image(base(8, 8, 8, 1, 6400), bytes(64)),
        image(base(8, 8, 12, 1, 64), bytes(64)),
        good[:9],
        b"II*\0",
    ]
    rows = tiff.tiff_pages(spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate([*bad, good])], "id long, media binary")).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(8)) and all(r.error and r.data is None for r in rows[:-1]) and rows[-1].error is None


def test_layouts_all_come(spark):
    """The query's pages use every layout, and each reads back."""
    rng = np.random.default_rng(3)
    seen = set()
    for k in range(300):
        payload = rng.integers(97, 105, 576 * int(rng.integers(1, 5)), dtype=np.uint8).tobytes()
        (page,) = tiff.pages(tiff.encode(payload))
        assert page.samples.tobytes() == payload
        seen.add((page.compression, page.predictor))
    assert seen == {(5, 1), (5, 2), (32773, 1), (32773, 2), (8, 1), (8, 2)}
    three = rng.integers(97, 105, 576 * 2500, dtype=np.uint8).tobytes()
    assert b"".join(p.samples.tobytes() for p in tiff.pages(tiff.encode(three))) == three


def test_media_columns(spark):
    """What the query says of the stored form is so."""
    import hashlib

    got = tiff.media_of_texts(spark.createDataFrame([(1, "some text"), (2, None)], DOCS)).collect()
    for r in got:
        stored = bytes(r.media)
        text = tiff.payload_of(b"some text" if r.doc_id == 1 else b"")
        assert stored == tiff.encode(text) and hashlib.sha256(b"".join(p.samples.tobytes() for p in tiff.pages(stored))).digest() == hashlib.sha256(text).digest()
    v = np.frombuffer(tiff.payload_of(b""), np.uint8)
    assert tiff.features(list(tiff.pages(tiff.encode(v.tobytes())))) == "pages=1;width=576;height=1;mean=255000;square=65025000;distinct=1"


def test_archive_members():
    """Members of any size, in blocks that cut through them; the file is gzip that any reader reads."""
    rng = np.random.default_rng(2)
    bodies = [rng.integers(0, 256, int(n), dtype=np.uint8).tobytes() for n in (0, 1, 5, 100_000, 3, 70_000)]
    data = b"".join(gzip.compress(b) for b in bodies)
    for block in (1, 7, 1 << 16) if len(data) < 1000 else (977, 1 << 16, 1 << 20):
        found = list(warc.members(io.BytesIO(data), block))
        assert [c for _, c in found] == bodies and [data[a : a + 2] for a, _ in found] == [b"\x1f\x8b"] * len(bodies)
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-5])))


def test_archive_headers(spark):
    """A warcinfo first; revisits name the original's id, date and url."""
    big = "x" * 1500
    pages = spark.createDataFrame([(1, "http://a/", big), (2, "http://b/", big), (None, None, "s")], "page_id long, url string, html string").coalesce(1)
    (path,) = [r.path for r in warc.write_archives(pages).collect()]
    with open(path.removeprefix("file:").replace("//", "/"), "rb") as f:
        heads = [c.split(b"\r\n\r\n")[0].decode() for _, c in warc.members(f)]
    assert "WARC-Type: warcinfo" in heads[0] and len(heads) == 4 and len({h.split("WARC-Record-ID: ")[1].split("\r\n")[0] for h in heads}) == 4
    (again,) = [h for h in heads if "revisit" in h.split("\r\n")[1]]
    original = next(h for h in heads if "WARC-Target-URI: http://b/" in h)
    assert f"WARC-Refers-To: {original.split('WARC-Record-ID: ')[1].splitlines()[0]}" in again and "WARC-Refers-To-Target-URI: http://b/" in again and "WARC-Refers-To-Date: " in again
