"""TIFF: image directories, strips and tiles, PackBits, LZW and deflate, predictors; one row per page.

Baseline and common extensions of classic (32-bit) TIFF, both byte orders: compressions 1 (none), 5 (LZW), 8 and 32946 (deflate), 32773 (PackBits);
predictors 1, 2 (horizontal differences) and 3 (differences of the bytes of floating-point samples, most significant first); samples of 1, 2, 4, 8, 16 and 32 bits, 32 bits also as
floating point; chunky and planar configuration; strips and tiles. Samples of less than 8 bits are given a byte each. Anything else, missing strips, or a page of more than `MOST` bytes raises
ValueError for the page before memory is taken, which `tiff_pages` reports in the column `error` instead of failing the job. A directory that comes again ends the walk.

Query op3. A text's payload (UTF-8, null as empty, then bytes 255 up to a positive multiple of 576) becomes grey pages of 576 samples by up to
1024 rows. A page's layout follows from the sum of its bytes: one of PackBits strips, LZW tiles, deflate strips and deflate tiles, with predictor 1 or 2 and either byte order (LZW, whose coder is
no C library, for one page in 32). The stored bytes are walked again and features are taken from the decoded pages. Repeated rows
and null ids get a row each; the result depends on the text alone. A very long text has as many pages as it needs.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, load, numbered_columns

#: Fixed values of the format: tags, and bytes of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_W, TILE_H, TILES, TILE_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FORMAT = 339
SIDE = 576
#: Bytes that a decoded page may have.
MOST = 1 << 30
#: What broken data raise.
ERRORS = (ValueError, struct.error, zlib.error, IndexError, TypeError, ZeroDivisionError, OverflowError, MemoryError)


@dataclass
class Page:
    index: int
    samples: np.ndarray  # height x width x samples
    compression: int
    predictor: int
    bits: int = 8


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


#: A byte that comes three times or more.
RUN = re.compile(rb"(?s)(.)\1{2,127}")


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def plain(to: int) -> None:
        for k in range(at, to, 128):
            part = data[k : min(k + 128, to)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in RUN.finditer(data):
        plain(m.start())
        out.extend((257 - (m.end() - m.start()), data[m.start()]))
        at = m.end()
    plain(len(data))
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Variable-width codes of 9 to 12 bits, highest bit first; 256 clears, 257 ends; the width grows one code early."""
    out, single = bytearray(), [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, held, bits, last = list(single), 9, 0, 0, b""
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, last = list(single), 9, b""
            continue
        if code < len(table):
            now = table[code]
        elif code == len(table) and last:
            now = last + last[:1]
        else:
            raise ValueError("LZW code out of order")
        out += now
        if last:
            table.append(last + now[:1])
        last = now
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    held, bits, out = 0, 0, bytearray()
    table: dict[bytes, int] = {}
    width, following, prefix = 9, 258, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    code_of = lambda s: s[0] if len(s) == 1 else table[s]
    put(256)
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            prefix = longer
            continue
        put(code_of(prefix))
        table[longer] = following
        following += 1
        width = min(12, max(9, following.bit_length()))
        if following >= 4094:
            put(256)
            table, width, following = {}, 9, 258
        prefix = data[i : i + 1]
    if prefix:
        put(code_of(prefix))
        following += 1
        width = min(12, max(9, following.bit_length()))
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def expand(data: bytes, compression: int, size: int) -> bytes:
    if compression == 1:
        return data
    if compression in (8, 32946):
        return zlib.decompressobj().decompress(data, size)
    if compression == 32773:
        return unpack_bits(data, size)
    if compression == 5:
        return unpack_lzw(data, size)
    raise ValueError(f"compression {compression}")


def fields_of(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    found: dict[int, list[int]] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size = TYPE_BYTES.get(kind, 1) * count
        where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        if kind in (1, 3, 4):
            found[tag] = list(struct.unpack_from(f"{order}{count}{'BHI'[(1, 3, 4).index(kind)]}", data, where))
    return found, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def pages(data: bytes) -> Iterator[Page]:
    """Walks the directories of a TIFF and decodes each page."""
    for page in walked(data):
        if isinstance(page, Exception):
            raise page
        yield page


def walked(data: bytes) -> Iterator[Page | Exception]:
    """The pages of a TIFF, each decoded or the error that kept it from that; what breaks the walk itself is raised."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF")
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        try:
            page = page_at(data, at, order, len(seen) - 1)
        except ERRORS as e:
            page = e
        yield page
        at = following


def samples_of(raw: bytes, tall: int, wide: int, per: int, bits: int, kind: np.dtype, predictor: int) -> np.ndarray:
    """tall x wide x per samples of one strip or tile; a row of samples of less than 8 bits ends on a whole byte."""
    if bits < 8:
        row = -(-wide * per * bits // 8)
        each = np.unpackbits(np.frombuffer(raw, np.uint8, tall * row).reshape(tall, row), axis=1)[:, : wide * per * bits]
        return (each.reshape(tall, wide, per, bits) * (1 << np.arange(bits - 1, -1, -1))).sum(3).astype(np.uint8)
    if predictor == 3:
        lanes = np.frombuffer(raw, np.uint8, tall * wide * per * kind.itemsize).reshape(tall, -1, per)
        planes = np.cumsum(lanes, axis=1, dtype=np.uint8).reshape(tall, kind.itemsize, wide * per)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(tall, wide, per)
    block = np.frombuffer(raw, kind, tall * wide * per).reshape(tall, wide, per)
    return np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else block


def page_at(data: bytes, at: int, order: str, index: int) -> Page:
    tags, _ = fields_of(data, at, order)
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, bits, per, comp, pred = one(WIDTH, 0), one(HEIGHT, 0), one(BITS, 1), one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    planar, real = per > 1 and one(PLANAR, 1) == 2, one(FORMAT, 1) == 3
    if bits not in (1, 2, 4, 8, 16, 32) or len(set(tags.get(BITS, [1]))) > 1 or pred not in (1, 2, 3) or pred == 2 and (bits < 8 or real) or pred == 3 and not (real and bits == 32) or real and bits != 32:
        raise ValueError(f"{tags.get(BITS)} bits, format {one(FORMAT, 1)}, predictor {pred}")
    kind = np.dtype(f"{order}{'f4' if real else f'u{max(1, bits // 8)}'}")
    if not width or not height or not per or width * height * per * kind.itemsize > MOST:
        raise ValueError(f"a page of {width} x {height} x {per} samples")
    tiled, each = TILES in tags, 1 if planar else per
    w, h = (one(TILE_W, 0), one(TILE_H, 0)) if tiled else (width, min(one(ROWS, height), height))
    if not w or not h or w * h * per * kind.itemsize > MOST:
        raise ValueError(f"strips or tiles of {w} x {h}")
    across, down = -(-width // w), -(-height // h)
    starts, sizes = tags.get(TILES if tiled else STRIPS, []), tags.get(TILE_BYTES if tiled else STRIP_BYTES, [])
    if not len(starts) == len(sizes) == across * down * (per // each):
        raise ValueError(f"{len(starts)} strips or tiles of {across * down * (per // each)}")
    if any(start + size > len(data) for start, size in zip(starts, sizes, strict=True)):
        raise ValueError("a strip or tile beyond the end")
    out = np.zeros((height, width, per), kind.newbyteorder("="))
    for k, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        plane, place = divmod(k, across * down)
        y, x = place // across * h, place % across * w
        tall = h if tiled else min(h, height - y)
        raw = expand(data[start : start + size], comp, tall * -(-w * each * bits // 8))
        block = samples_of(raw, tall, w, each, bits, kind, pred)
        out[y : y + tall, x : x + w, plane : plane + each] = block[: height - y, : width - x]
    return Page(index, out, comp, pred, bits)


@dataclass
class Layout:
    """How a page is stored; rows: of a strip; tile: (width, height), each a multiple of 16."""

    compression: int = 8
    predictor: int = 2
    rows: int = 128
    tile: tuple[int, int] | None = None


def build(images: list[np.ndarray], compression: int = 8, predictor: int = 2, rows: int = 128, order: str = "<", tile: tuple[int, int] | None = None, layouts: list[Layout] | None = None) -> bytes:
    """A TIFF of grey or chunky images (height x width [x samples], 8 or 16 bits); with layouts, one for each image instead of the one given."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    link = 4
    packers = {1: bytes, 5: pack_lzw, 8: lambda b: zlib.compress(b, 1), 32773: pack_bits}
    for image, layout in zip(images, layouts or [Layout(compression, predictor, rows, tile)] * len(images), strict=True):
        image = image[:, :, None] if image.ndim == 2 else image
        height, width, per = image.shape
        w, h = layout.tile or (width, layout.rows)
        starts, sizes = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                block = image[y : y + h, x : x + w]
                if layout.tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)))
                if layout.predictor == 2:
                    block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
                starts.append(len(out))
                out += packers[layout.compression](np.ascontiguousarray(block, block.dtype.newbyteorder(order)).tobytes())
                sizes.append(len(out) - starts[-1])
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [8 * image.itemsize] * per, COMPRESSION: [layout.compression], PHOTOMETRIC: [1 if per == 1 else 2], SAMPLES: [per], PLANAR: [1], PREDICTOR: [layout.predictor]}
        tags |= {TILE_W: [w], TILE_H: [h], TILES: starts, TILE_BYTES: sizes} if layout.tile else {STRIPS: starts, ROWS: [h], STRIP_BYTES: sizes}
        entries = b""
        for tag, values in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}I", *values)
            if len(values) > 1:
                where = len(out)
                out += raw
                raw = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, 4, len(values)) + raw
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def tiff_pages(df: DataFrame, column: str = "media") -> DataFrame:
    """One row per page: df's other columns, page, width, height, samples, bits, compression, predictor, data (the decoded samples), error. A null or empty medium has no
    row; a page that can't be decoded has its row with the error, and so has what ends the walk, after the pages before it. Columns of df with these names are replaced."""
    more = ["page", "width", "height", "samples", "bits", "compression", "predictor", "data", "error"]
    df = df.drop(*[c for c in more if c != column])
    plain, types = numbered_columns(df)
    medium_at = df.columns.index(column)
    kept = [i for i in range(len(df.columns)) if i != medium_at]
    kinds = [*[pa.int32()] * 7, pa.binary(), pa.string()]

    def run(batches):
        for batch in batches:
            for i, medium in enumerate(batch.column(medium_at)):
                found = []
                try:
                    for p in walked(medium.as_py() or b"") if medium.as_py() else ():
                        if isinstance(p, Exception):
                            found.append((len(found), *[None] * 7, str(p) or type(p).__name__))
                            continue
                        found.append((p.index, p.samples.shape[1], p.samples.shape[0], p.samples.shape[2], p.bits, p.compression, p.predictor, p.samples.tobytes(), None))
                except ERRORS as e:
                    found.append((len(found), *[None] * 7, str(e) or type(e).__name__))
                if found:
                    rows = pa.array([i] * len(found))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in kept), *(pa.array([r[k] for r in found], t) for k, t in enumerate(kinds))], [*(f"c{c}" for c in kept), *more])

    ddl = ", ".join([*(types[c] for c in kept), "page int, width int, height int, samples int, bits int, compression int, predictor int, data binary, error string"])
    return plain.mapInArrow(run, ddl).toDF(*[df.columns[c] for c in kept], *more)


def payload_of(text: bytes, unit: int = SIDE) -> bytes:
    return text + b"\xff" * (-len(text) % unit if text else unit)


def layout_of(page: bytes) -> Layout:
    h = zlib.crc32(page)
    if h % 32 == 0:
        return Layout(5, 1 + (h >> 5) % 2, tile=(192, 64))
    return (Layout(32773, 1), Layout(32773, 2, 32), Layout(8, 1), Layout(8, 2), Layout(8, 2, tile=(144, 128)))[(h >> 5) % 5]


def encode(payload: bytes, rows: int = 1024) -> bytes:
    grid = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    images = [grid[y : y + rows] for y in range(0, len(grid), rows)]
    return build(images, order="<>"[zlib.crc32(payload) >> 31], layouts=[layout_of(x.tobytes()) for x in images])


def features(found: list[Page]) -> str:
    """Pages, size, mean and spread of the samples in thousandths, distinct samples."""
    n = np.zeros(256, np.int64)
    for p in found:
        n += np.bincount(p.samples.ravel(), minlength=256)
    v, total = np.arange(256), int(n.sum())
    mean = int((n * v).sum()) * 1000 // total
    square = int((n * v * v).sum()) * 1000 // total
    return f"pages={len(found)};width={SIDE};height={total // SIDE};mean={mean};square={square};distinct={int((n > 0).sum())}"


def media_of_texts(docs: DataFrame, keep: bool = False) -> DataFrame:
    """(doc_id, n_bytes, media) for docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in chunks(batch, "text"):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows].cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches):
        for batch in batches:
            out = []
            for medium in batch.column("media"):
                stored = medium.as_py()
                found = list(pages(stored))
                payload = b"".join(p.samples.tobytes() for p in found)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(found)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media_of_texts(load(spark, sf_dir, "documents")).mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
