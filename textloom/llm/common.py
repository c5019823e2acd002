"""Shared pieces: the shared work folder, table hand-over between jobs, and vectorised word scanning over Arrow buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.tables import materialised as written
from textloom.operators.tables import scratch, work_path

__all__ = ["LETTERS", "LOWER", "NOT_SPACE", "buffers", "chunks", "crc_mod", "fresh", "load", "mix", "numbered_columns", "open_fs", "scratch", "word_hashes", "word_spans", "work_path", "write_once", "written"]

#: Bytes of text that one numpy pass works on (one longer document is a pass of its own).
CHUNK_BYTES = 1 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that df has no column of; Spark doesn't tell upper from lower case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with columns c0, c1 and so on, and their types: mapInArrow can't take names with dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields)]


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_once(uri: str, data: bytes | Iterable[bytes]) -> None:
    """Writes a file, part by part as they come, under a name of its own and then renames it, so that a repeated or speculative task leaves one whole file."""
    files, path = open_fs(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(own) as out:
        for part in [data] if isinstance(data, bytes) else data:
            out.write(part)
    files.move(own, path)


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % n


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without copying; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows with at most `limit` bytes of text, or one row."""
    data, offsets = buffers(batch.column(column))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def byte_set(*keep: int | range) -> np.ndarray:
    out = np.zeros(256, bool)
    for x in keep:
        out[list(x) if isinstance(x, range) else x] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]
NOT_SPACE = ~byte_set(0x20, range(0x09, 0x0E))
#: letters of ASCII (lower case) and every byte of a longer UTF-8 sequence
LETTERS = byte_set(range(97, 123), range(128, 256))

_rng = np.random.default_rng(20240229)
_BYTE_HASH = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 256), _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets of each text) of the runs of member bytes; no run spans two texts."""
    mask = members[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | first[1:-1]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    heads = np.concatenate([[0], np.cumsum(lens)[:-1]])
    inside = np.arange(int(lens.sum())) - np.repeat(heads, lens)
    at = inside + np.repeat(starts, lens)
    with np.errstate(over="ignore"):
        terms = _BYTE_HASH[data[at]] * powers(int(lens.max()) + 1)[inside]
        return mix(np.add.reduceat(terms, heads))
