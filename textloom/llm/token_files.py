"""Token ids in seekable zstandard files.

A shard (`.tlz`) holds the documents of one range of ids. Layout, integers little-endian:

1. data frames: independent zstandard frames, each the ids of whole documents (16-bit, or 32-bit for vocabularies over 65536), up to about `frame_bytes`;
2. a skippable frame 0x184D2A50: the document index, itself zstandard: count, then arrays doc_id int64, is_null uint8, frame uint32, first id
   within the frame uint64, n_tokens uint64; ahead of it the width of an id and the number of documents;
3. a skippable frame 0x184D2A5E: the seek table of zstandard's seekable format: for each data frame compressed size, size and checksum (the low 32
   bits of XXH64 of the content), then number of frames, flags (0x80: checksums) and magic 0x8F92EAB1.

A reader takes the tables from the tail and decompresses only the frames of the documents asked for; a wrong checksum raises. `read_documents` does so for a DataFrame of ids.
Frames are written as they fill up, so a writer holds one frame, and of each document its index entry. The number of shards follows the bytes of text.

Cases. A null text is an empty one, which has only the end id. Null ids come first, repeated ids and rows stay, each as a document.
An empty table gives no shard and no row. Special tokens' strings in a text are encoded as the tokenizers library does by default.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, load, mix, open_fs, work_path, write_once, written

INDEX_MAGIC, SEEK_MAGIC, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
TAIL = 1 << 16


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Texts of these characters alone are split here as the tokenizer would: neither NFC nor lower-casing joins or splits any of them. Those beyond ASCII are letters.
PLAIN = re.compile("[\\x01-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]*")
WHITE, LETTER, DIGIT, MARK = range(4)
KIND = np.full(256, MARK, np.uint8)
KIND[[0, *range(9, 14), 32]], KIND[48:58], KIND[97:123], KIND[128:] = WHITE, DIGIT, LETTER, LETTER
#: Bytes of the longest piece that the table holds, and bytes of text that are split at once (white space permitting).
LONGEST, AT_ONCE = 24, 1 << 19
#: A word's bytes of a piece, by how many of them are the piece's.
MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


#: What a tokenizer file says if it splits lower-case PLAIN texts as `spans` does, encodes each piece by itself, and drops the white space between them.
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def splits_as_known(described: dict) -> bool:
    """Whether a tokenizer (its JSON) is one for which the table of pieces holds."""
    split = (described.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
    bytes_only = all(x["type"] == "ByteLevel" and not x["use_regex"] and not x["add_prefix_space"] for x in split[1:])
    marked = all(x["content"].startswith("<|") and not x["normalized"] for x in described.get("added_tokens", []))
    return described.get("normalizer") == KNOWN_NORMALIZER and split[0] == KNOWN_SPLIT and bytes_only and marked


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pieces of lower-case PLAIN text, as bytes with white space at the end: runs of letters, single digits, runs of other characters; an apostrophe that is such a run by
    itself takes the s, t, m, d, re, ve or ll behind it."""
    kind = KIND[data]
    change = kind[1:] != kind[:-1]
    first, last = np.empty(len(kind), bool), np.zeros(len(kind), bool)
    first[0], first[1:] = kind[0] != WHITE, (change | (kind[1:] == DIGIT)) & (kind[1:] != WHITE)
    last[:-1] = (change | (kind[:-1] == DIGIT)) & (kind[:-1] != WHITE)
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    alone = np.flatnonzero((data[starts] == ord("'")) & (ends - starts == 1))
    alone = alone[kind[ends[alone]] == LETTER]
    if len(alone):
        x, y = data[ends[alone]], data[ends[alone] + 1]
        two = (y == ord("e")) & ((x == ord("r")) | (x == ord("v"))) | (x == ord("l")) & (y == ord("l"))
        more = np.where(two, 2, np.isin(x, list(b"stmd")))
        ends[alone] += more
        starts[alone + 1] += more
        some = starts < ends
        starts, ends = starts[some], ends[some]
    return starts, ends


class Encoder:
    """Ids of texts. If the tokenizer's file says that it splits as known, by way of a table of pieces: it then encodes each piece of its split pattern by itself and drops white space, so that
    a text's ids are those of its pieces, one after another. A slot of the table holds a piece, all its bytes (up to LONGEST), and the place of its ids; a new one takes the place of what was
    in its slot. New pieces go together to the tokenizer's model, past its normalizer and split pattern, which would leave them as they are. Texts with other characters than PLAIN, or that
    may hold the string of a special token, are encoded whole, and so is every text by any other tokenizer."""

    def __init__(self, path: str, bits: int = 19, most: int = 1 << 22):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.bits, self.most = Tokenizer.from_file(path), bits, most
        self.dtype = np.dtype("<u4" if self.tok.get_vocab_size() > 1 << 16 else "<u2")
        described = json.loads(self.tok.to_str())
        self.pieces = splits_as_known(described)
        if self.pieces:
            letters = [pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False) for _ in described["pre_tokenizer"]["pretokenizers"][1:]]
            self.bare, self.lettered = Tokenizer(self.tok.model), Tokenizer(self.tok.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.lettered.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), *letters])
            self.empty()

    def empty(self) -> None:
        """A table without pieces. A slot: three words of the piece's bytes, then the place of its ids among `ids` times 256, and their number."""
        self.table = np.zeros((1 << self.bits, 4), np.uint64)
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0

    def learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the ids of pieces, which are added to `ids`. The bytes of visible ASCII are their own letters."""
        texts = [p.decode().lower() for p in new]
        visible = np.array([p.isascii() and p.isprintable() for p in texts], bool)
        at, n = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        for tok, which in ((self.bare, np.flatnonzero(visible)), (self.lettered, np.flatnonzero(~visible))):
            for k in range(0, len(which), 256):
                part = which[k : k + 256]
                e = tok.encode(" ".join([texts[i] for i in part.tolist()]), add_special_tokens=False)
                found = np.array(e.ids, self.dtype)
                count = np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))
                if len(count) != len(part) or not count.all():
                    raise ValueError("the pieces aren't those of the tokenizer")
                if self.used + len(found) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(found)), self.dtype)])
                self.ids[self.used : self.used + len(found)] = found
                at[part], n[part] = self.used + np.cumsum(count) - count, count
                self.used += len(found)
        return at, n

    def encoded(self, texts: list[bytes]) -> list[bytes]:
        """Ids of PLAIN texts."""
        if self.used > self.most:
            self.empty()
        data = LOWER[np.frombuffer(b"\n".join([*texts, bytes(LONGEST)]), np.uint8)]
        starts, ends = spans(data)
        size = ends - starts
        word = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        key = np.zeros((3, len(starts)), np.uint64)
        key[0] = word[starts] & MASK[np.minimum(size, 8)]
        for j in (1, 2):
            more = np.flatnonzero(size > 8 * j)
            key[j, more] = word[starts[more] + 8 * j] & MASK[np.minimum(size[more] - 8 * j, 8)]
        slot = (mix(key[0] ^ mix(key[1] ^ mix(key[2]))) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.table.take(slot, axis=0)
        at, n = (held[:, 3] >> np.uint64(8)).astype(np.int64), (held[:, 3] & np.uint64(255)).astype(np.int64)
        missing = np.flatnonzero((held[:, 0] != key[0]) | (held[:, 1] != key[1]) | (held[:, 2] != key[2]) | (size > LONGEST))
        if len(missing):
            raw = data.tobytes()
            pieces = [raw[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)]
            number = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
            which = np.array([number[p] for p in pieces], np.int64)
            places, counts = self.learn(list(number))
            at[missing], n[missing] = places[which], counts[which]
            short = missing[size[missing] <= LONGEST]
            self.table[slot[short]] = np.stack([*key[:, short], (at[short] << 8 | n[short]).astype(np.uint64)], axis=1)
        upto = np.cumsum(n)
        ids = self.ids[np.repeat(at - (upto - n), n) + np.arange(int(upto[-1]) if len(upto) else 0)].tobytes()
        cuts = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        cuts = (self.dtype.itemsize * np.concatenate([[0], upto])[cuts]).tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        parts: list[tuple[int, bytes]] = []
        held = 0

        def flush():
            for (k, _), ids in zip(parts, self.encoded([part for _, part in parts]), strict=True):
                out[k].append(ids)
            parts.clear()

        for k, text in enumerate(texts):
            if not self.pieces or "<|" in text or not PLAIN.fullmatch(text):
                out[k].append(np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes())
                continue
            for part in blocks(text.encode()):
                if held + len(part) > AT_ONCE and parts:
                    flush()
                    held = 0
                parts.append((k, part))
                held += len(part)
        if parts:
            flush()
        return [b"".join(x) for x in out]


def blocks(text: bytes) -> Iterator[bytes]:
    """A text in parts of up to AT_ONCE bytes, cut at spaces alone."""
    at = 0
    while len(text) - at > AT_ONCE:
        cut = text.rfind(b" ", at + 1, at + AT_ONCE)
        if cut < 0:
            cut = text.find(b" ", at + AT_ONCE)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def shard_bytes(docs: Iterable[tuple[int | None, bytes]], width: int, frame_bytes: int = 1 << 18, level: int = 1) -> Iterator[bytes]:
    """The parts of a shard, frame by frame; docs: (doc_id, ids as bytes of `width` each) in order."""
    pack = zstandard.ZstdCompressor(level=level, write_checksum=False)
    table, frame, held = [], [], 0
    index = [array(kind) for kind in "qBIQQ"]

    def closed() -> bytes:
        raw = b"".join(frame)
        frame.clear()
        packed = pack.compress(raw)
        table.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        return packed

    for doc_id, ids in docs:
        if held and held + len(ids) > frame_bytes:
            yield closed()
            held = 0
        for column, value in zip(index, (doc_id or 0, doc_id is None, len(table), held // width, len(ids) // width), strict=True):
            column.append(value)
        frame.append(ids)
        held += len(ids)
    if frame:
        yield closed()
    columns = b"".join(np.array(c, t).tobytes() for c, t in zip(index, ("<i8", "u1", "<u4", "<u8", "<u8"), strict=True))
    body = struct.pack("<II", width, len(index[0])) + zstandard.ZstdCompressor(level=3).compress(columns)
    yield struct.pack("<II", INDEX_MAGIC, len(body)) + body
    seek = b"".join(table) + struct.pack("<IBI", len(table), 0x80, SEEKABLE)
    yield struct.pack("<II", SEEK_MAGIC, len(seek)) + seek


class Shard:
    """Random access to a shard; only the tail and the frames asked for are read."""

    def __init__(self, uri: str):
        files, path = open_fs(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(min(size, TAIL), max(0, size - TAIL))
        n, flags, magic = struct.unpack("<IBI", tail[-9:])
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError(f"{uri}: no seek table")
        need = n * 12 + 9 + 8
        if need > len(tail):
            tail = self.file.read_at(need, size - need)
        self.table = np.frombuffer(tail[-need + 8 : -9] if n else b"", "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        body = self.file.read_at(size - need - int(self.at[-1]), int(self.at[-1]))
        magic, length = struct.unpack("<II", body[:8])
        if magic != INDEX_MAGIC:
            raise ValueError(f"{uri}: no document index")
        self.width, docs = struct.unpack("<II", body[8:16])
        raw = zstandard.ZstdDecompressor().decompress(body[16 : 8 + length]) if docs else b""
        cuts = np.cumsum([0, 8 * docs, docs, 4 * docs, 8 * docs, 8 * docs])
        self.doc_id, self.null, self.frame, self.first, self.tokens = (np.frombuffer(raw[a:b], t) for a, b, t in zip(cuts[:-1], cuts[1:], ("<i8", "u1", "<u4", "<u8", "<u8"), strict=True))
        self.kept: tuple[int, bytes] = (-1, b"")

    def frame_bytes(self, k: int) -> bytes:
        if self.kept[0] != k:
            packed, size, check = (int(x) for x in self.table[k])
            raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, int(self.at[k])), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k}: checksum differs")
            self.kept = (k, raw)
        return self.kept[1]

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        a, n = int(self.first[i]), int(self.tokens[i])
        return np.frombuffer(self.frame_bytes(int(self.frame[i])), f"<u{self.width}")[a : a + n]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, shards: int | None = None, shard_bytes_of_text: int = 1 << 24) -> DataFrame:
    """Encodes docs (doc_id, text), writes a shard for each range of ids, in ascending order, and returns (shard, path, docs, tokens, base), base being
    the number of ids in all shards before. There is one row a shard, so the running sum over them is small. Without `shards` there is one for each shard_bytes_of_text."""
    folder = work_path(docs.sparkSession, "token-shards")
    n = shards or 1 + int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes_of_text

    def write(batches: Iterator[pa.RecordBatch]):
        enc, tokens, count = encoder(tokenizer), 0, 0
        end = np.array([end_id], enc.dtype).tobytes()

        def encoded():
            nonlocal tokens, count
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc([t or "" for t in part.column("text").to_pylist()]), strict=True):
                        tokens += len(ids) // enc.dtype.itemsize + 1
                        count += 1
                        yield doc_id, ids + end

        rows = encoded()
        if (first := next(rows, None)) is None:
            return
        k = TaskContext.get().partitionId()
        path = f"{folder}/shard-{k:06d}-{TaskContext.get().taskAttemptId()}.tlz"
        write_once(path, shard_bytes(chain([first], rows), enc.dtype.itemsize))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "path": [path], "docs": [count], "tokens": [tokens]})

    done = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    done = written(done.mapInArrow(write, "shard int, path string, docs long, tokens long"), "token-index")
    return done.selectExpr("*", "coalesce(sum(tokens) over (order by shard rows between unbounded preceding and 1 preceding), 0) as base")


def spread_by_path(rows: DataFrame) -> DataFrame:
    return rows.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")


def read_shards(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, path, place) of every document, from the files; path and place are where read_documents finds it."""

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                s = Shard(path)
                n = len(s.doc_id)
                crc = [zlib.crc32(s.ids(i).astype("<u4").tobytes()) for i in range(n)]
                start = base + np.concatenate([[0], np.cumsum(s.tokens.astype(np.int64))[:-1]])
                ids = pa.array(s.doc_id.astype(np.int64), mask=s.null.astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(start, pa.int64()), pa.array(s.tokens.astype(np.int64)), pa.array(crc, pa.int64()), pa.array([path] * n), pa.array(range(n), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32", "path", "place"])

    return spread_by_path(index.select("path", "base")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string, place long")


def read_documents(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """catalog: doc_id, path, place (of read_shards, written once); wanted: doc_id -> doc_id, ids of the wanted documents. Only the frames that hold them are read."""

    def read(batches):
        open_ = ("", None)
        for batch in batches:
            out = []
            for path, place in zip(batch.column("path").to_pylist(), batch.column("place").to_pylist(), strict=True):
                if open_[0] != path:
                    open_ = (path, Shard(path))
                out.append(open_[1].ids(place).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = catalog.select("doc_id", "path", "place").join(wanted.select("doc_id").distinct(), "doc_id")
    return spread_by_path(rows).sortWithinPartitions("path", "place").mapInArrow(read, "doc_id long, ids array<int>")


def write_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer or tokenizer_path()))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(load(spark, sf_dir, "documents")).drop("path", "place")
