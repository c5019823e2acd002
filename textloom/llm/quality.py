"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text: its words, hashed to WORDS cells; pairs of neighbouring character classes (each ASCII punctuation mark is a class of its own), word lengths, and how often
words come again (the word before, any word, any pair of words). From at most `max_train` labelled documents (those with the smallest
hash of their id) come the terms' weights and the leading singular directions of the weighted term-document matrix. The labelled documents' vectors
are broadcast: max_train * dims float32, so max_train bounds the broadcast (6000 * 32 * 4 bytes = 0.8 MB). Every document is
compared with all of them by exact cosine, in blocks; its `k` nearest vote with weight max(cos, 0) ** sharp.

Ties. The labelled documents stand in the order of their ids' hashes, then ids; of equal cosines at rank k the first ones vote.

Cases. Null and empty texts have the zero vector, whose cosines are 0, and get the share of label 1 among the training rows. Repeated
rows get a row each. A null doc_id is never trained on and counts as not held out. Repeated labels of an id count as their largest, null
labels don't count. A repeated id has one text in training, the least one. Without any label every score is 0.5.
Very long texts are measured whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, chunks, crc_mod, fresh, load, numbered_columns, word_hashes, word_spans
from .toxicity import training_labels

CLASSES = np.zeros(256, np.int64)
CLASSES[:32], CLASSES[127] = 5, 5
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[32], CLASSES[10], CLASSES[128:] = 0, 1, 2, 3, 4, 6
_marks = [b for b in range(33, 127) if not chr(b).isalnum()]
CLASSES[_marks] = 7 + np.arange(len(_marks))
N_CLASSES = 7 + len(_marks)
LENGTHS, LEVELS = 24, 20
#: Cells of hashed words, and their weight beside the other terms.
WORDS, WORD_WEIGHT = 1024, 0.5
#: class pairs, word lengths, three groups of repetition levels, levels of size, words
DIMS = N_CLASSES**2 + LENGTHS + 4 * LEVELS + WORDS


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # DIMS x dims
    vectors: np.ndarray  # rows x dims, of length 1
    labels: np.ndarray
    k: int
    sharp: float


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of DIMS term weights for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMS), np.float32)
    size = np.diff(offsets)
    if len(data) > 1:
        kind = CLASSES[data]
        of = np.repeat(np.arange(n), size)
        same = of[1:] == of[:-1]
        pairs = np.bincount((of[1:] * N_CLASSES**2 + kind[:-1] * N_CLASSES + kind[1:])[same], minlength=n * N_CLASSES**2).reshape(n, -1)
        out[:, : N_CLASSES**2] = np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 1))
    starts, ends, at = word_spans(data, offsets, NOT_SPACE)
    if len(starts):
        words = np.diff(at)
        of = np.repeat(np.arange(n), words)
        base = N_CLASSES**2
        lens = np.bincount(of * LENGTHS + np.minimum(ends - starts, LENGTHS) - 1, minlength=n * LENGTHS).reshape(n, -1)
        out[:, base : base + LENGTHS] = np.sqrt(lens / np.maximum(words, 1)[:, None])
        base += LENGTHS
        h = word_hashes(LOWER[data], starts, ends)
        twin = np.zeros(len(h), bool)
        twin[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        with np.errstate(over="ignore"):
            two = h.copy()
            two[1:] += h[:-1] * np.uint64(3)
        shares = [np.bincount(of, twin, n) / np.maximum(words, 1), distinct_share(of, h, n, words), distinct_share(of, two, n, words)]
        for share in shares:
            level = np.minimum((share * LEVELS).astype(int), LEVELS - 1)
            out[np.arange(n), base + level] = np.where(words > 0, 0.7, 0)
            base += LEVELS
        out[np.arange(n), base + np.minimum(np.log2(np.maximum(words, 1)).astype(int), LEVELS - 1)] = np.where(words > 0, 0.2, 0)
        cells = np.bincount(of * WORDS + (h >> np.uint64(54)).astype(np.int64), minlength=n * WORDS).reshape(n, -1)
        out[:, base + LEVELS :] = WORD_WEIGHT * np.sqrt(cells / np.maximum(words, 1)[:, None])
    return out


def distinct_share(of: np.ndarray, h: np.ndarray, n: int, words: np.ndarray) -> np.ndarray:
    """Share of each text's items that an equal item of the text comes before."""
    order = np.lexsort((h, of))
    a, b = of[order], h[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return 1 - np.bincount(a[new], minlength=n) / np.maximum(words, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 6000, dims: int = 32, k: int = 15, sharp: float = 4.0) -> Model:
    ids = training_labels(labels, "quality", crc_mod("doc_id", 3) == 1, max_train)
    train = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # max_train rows at most
    train = train.withColumn("place", F.xxhash64("doc_id"))

    def measure(batches):
        for batch in batches:
            for rows, data, offsets in chunks(batch, "text"):
                x = terms(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("place")[rows], batch.column("doc_id")[rows].cast(pa.int64()), batch.column("y")[rows].cast(pa.int32()), pa.array([zlib.compress(r.astype(np.float16).tobytes(), 1) for r in x], pa.binary())], ["place", "doc_id", "y", "x"])

    seen = train.mapInArrow(measure, "place long, doc_id long, y int, x binary").toPandas().sort_values(["place", "doc_id"])
    if not len(seen):
        return Model(np.ones(DIMS, np.float32), np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), k, sharp)
    x = np.empty((len(seen), DIMS), np.float16)
    for i, row in enumerate(seen.pop("x")):
        x[i] = np.frombuffer(zlib.decompress(row), np.float16)
    idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 0.3
    axes = leading(x, idf, min(dims, len(x)))
    vectors = np.concatenate([unit((part * idf) @ axes) for part in blocks(x)]).astype(np.float32)
    return Model(idf, axes, vectors, (seen["y"].to_numpy() > 0).astype(np.float64), k, sharp)


def blocks(x: np.ndarray, rows: int = 500) -> Iterator[np.ndarray]:
    for at in range(0, len(x), rows):
        yield x[at : at + rows].astype(np.float32)


def leading(x: np.ndarray, idf: np.ndarray, dims: int, more: int = 16, rounds: int = 12) -> np.ndarray:
    """The leading right singular vectors of x * idf, by subspace iteration from a fixed start: neither the weighted matrix nor its square is held."""
    width = min(dims + more, DIMS)
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((DIMS, width)))[0].astype(np.float32)
    for _ in range(rounds):
        y = np.zeros((DIMS, width), np.float64)
        for part in blocks(x):
            part *= idf
            y += part.T @ (part @ q)
        q = np.linalg.qr(y)[0].astype(np.float32)
    small = np.zeros((width, width))
    for part in blocks(x):
        z = ((part * idf) @ q).astype(np.float64)
        small += z.T @ z
    return (q @ np.linalg.eigh(small)[1][:, ::-1][:, :dims]).astype(np.float32)


def nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest of each row in ascending order; of equal ones at the edge the first."""
    edge = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
    above, equal = cos > edge, cos == edge
    taken = above | equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(1, keepdims=True))
    return np.nonzero(taken)[1].reshape(len(cos), k)


def vote(x: np.ndarray, m: Model) -> np.ndarray:
    """Scores of term rows x: exact cosines with every labelled vector, block by block."""
    if not len(m.labels):
        return np.full(len(x), 0.5)
    z = unit((x * m.idf) @ m.axes)
    out = np.full(len(x), m.labels.mean())
    for at in range(0, len(x), 256):
        cos = z[at : at + 256] @ m.vectors.T
        near = nearest(cos, min(m.k, cos.shape[1]))
        w = np.maximum(np.take_along_axis(cos, near, 1), 0) ** m.sharp
        total = w.sum(1)
        ok = total > 0
        out[at : at + 256][ok] = np.clip((w * m.labels[near]).sum(1)[ok] / total[ok], 0, 1)  # rounding can pass 1
    return out


def score(docs: DataFrame, model: Model, keep_text: bool = False, name: str = "quality_score") -> DataFrame:
    """docs with their score (0 to 1) in column `name`, in place of one of that name; the text goes unless keep_text."""
    cast = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)
    plain, types = numbered_columns(docs)
    text = docs.columns.index("text")
    kept = [i for i in range(len(docs.columns)) if i != text or keep_text]

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for rows, data, offsets in chunks(batch, f"c{text}", 1 << 19):
                out[rows] = vote(terms(data, offsets), cast.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(out)], [*(f"c{i}" for i in kept), "score"])

    return plain.mapInArrow(run, ", ".join([*(types[i] for i in kept), "score double"])).toDF(*[docs.columns[i] for i in kept], name)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the vote does not reject, with their own columns."""
    model = fit(docs, load(spark, sf_dir, "labels"))
    (name,) = fresh(docs, "quality_score")
    return score(docs, model, keep_text=True, name=name).where(F.col(name) >= 0.5).drop(name)
