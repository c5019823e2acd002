"""Toxic passages: maximum-scoring segments over token log-odds.

Fit. Tokens are runs of letters, A-Z lower-cased; a token has the features: itself, and its beginnings of 4 to 10 bytes, each hashed to one of
2^22 cells. From at most `max_train` labelled documents (those with the smallest hash of their id: a bounded sample that every rerun
repeats; of documents with one label and equal sets of words, that is of copies, one counts) three in four teach the odds: each cell gets the log-odds of its use in
toxic against clean documents (once a document) under a Dirichlet prior in the proportions of all documents, drawn `caution` standard deviations towards 0. A cell that is
rarer in toxic text has negative odds. A token scores the odds of its feature with the largest amount of them, less `drift`, so that text without evidence costs.

Scan. Ruzzo and Tompa's linear scan finds every maximal scoring passage of a whole text.

Calibration. On the other quarter, whose texts taught nothing, lambda and K are the maximum-likelihood fit of the extreme-value law P(best <= s) = exp(-K n exp(-lambda s)) to the best
passages of clean texts of n tokens (texts without any count as censored at 0). A passage of score s then has E = K n exp(-lambda s); it is significant if p = 1 - exp(-E) <= `p_max`. A text's
passages with E < 1 are put together by Karlin and Altschul's sum statistic: with S the sum of -ln E of the r best, p_r = exp(-S) S^(r-1) / (r! (r-1)!), times 2^r for the choice of r; the
least of these gives the text's evidence -ln p, which a logistic curve, fitted on the same quarter, turns to a score between 0 and 1.

Cases. Null and empty texts have no token and no passage and get the curve's value at nothing found. Repeated rows get a row each; in training an id has one text, the least one.
A null doc_id is never trained on and counts as not held out. Repeated labels of an id count as their largest; null labels don't
count. If the quarter lacks a class, all training documents calibrate. If either class lacks documents to learn from, every score is the share of toxic labels (0 without any). Long texts are scanned
whole, in time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS, LOWER, chunks, crc_mod, load, numbered_columns, word_hashes, word_spans, written

BITS = 22
#: Bytes of a token's beginnings.
HEADS = range(4, 11)
#: Weight of the prior, as a share of all uses of cells.
PRIOR = 1 / 80
#: One in so many training documents calibrates.
FOLDS = 4


@dataclass
class Model:
    weights: np.ndarray  # float32 of 2^BITS cells: its size bounds the broadcast
    drift: float
    lam: float
    k: float
    p_max: float
    coef: list[float]  # empty if nothing could be learned
    share: float


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return word_spans(LOWER[data], offsets, LETTERS)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray]]:
    """(tokens that have it, their cells) for each kind of feature."""
    data, lens, shift = LOWER[data], ends - starts, np.uint64(64 - BITS)
    yield slice(None), (word_hashes(data, starts, ends) >> shift).astype(np.int64)
    for n in HEADS:
        which = np.flatnonzero(lens > n)
        if len(which):
            yield which, (word_hashes(data, starts[which], starts[which] + n) * np.uint64(2 * n + 1) >> shift).astype(np.int64)


def token_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model) -> np.ndarray:
    out = np.zeros(len(starts))
    for which, cells in features(data, starts, ends):
        new = model.weights[cells].astype(float)
        out[which] = np.where(np.abs(new) > np.abs(out[which]), new, out[which])
    return out - model.drift


def segments(index: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (Ruzzo and Tompa, linear time) as (first token, last token, score). index: positions of the tokens with a
    positive score; before, after: the running sum of all scores up to each of them, without and with it."""
    stack: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    links: list[int] = []  # the nearest entry to the left with a smaller sum before
    for i, lo, hi in zip(index.tolist(), before.tolist(), after.tolist(), strict=True):
        item = (i, i, lo, hi)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= item[2]:
                j = links[j]
            if j < 0 or stack[j][3] >= item[3]:
                stack.append(item)
                links.append(j)
                break
            item = (stack[j][0], item[1], stack[j][2], item[3])
            del stack[j:], links[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in stack]


def found_in(score: np.ndarray) -> list[tuple[int, int, float]]:
    """The maximal scoring segments of one text, given its tokens' scores."""
    index = np.flatnonzero(score > 0)
    if not len(index):
        return []
    run = np.cumsum(score)
    return segments(index, run[index] - score[index], run[index])


def evidence(scores: list[float], n: int, lam: float, k: float) -> float:
    """-ln p of the best sum of the largest scores, for a text of n tokens; 0 if there is none."""
    base = math.log(k * max(n, 1))
    best = total = 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        x = lam * s - base
        if x <= 0:
            break
        total += x
        best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
    return best


def extreme_value(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and K of P(best <= s) = exp(-K n exp(-lambda s)) by maximum likelihood; best 0 is censored. For a given lambda, K = (texts with a passage) / sum(n exp(-lambda best))."""
    hit = best > 0
    m = int(hit.sum())
    if not m:
        return 1.0, 0.5 / max(float(n.sum()), 1.0)
    rest = lambda lam: max(float((n * np.exp(-lam * best)).sum()), 1e-300)
    gain = lambda lam: m * math.log(lam) - m * math.log(rest(lam)) - lam * float(best.sum())
    lo, hi = math.log(0.05), math.log(20.0)
    for _ in range(80):  # the likelihood has one maximum
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (a, hi) if gain(math.exp(a)) < gain(math.exp(b)) else (lo, b)
    lam = math.exp((lo + hi) / 2)
    return lam, m / rest(lam)


def logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Intercept and slope by Newton steps with a small ridge."""
    a = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - 1e-2 * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), grad)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def training_labels(labels: DataFrame, label: str, held_out, max_train: int) -> DataFrame:
    """(doc_id, y): labelled ids outside the held-out fold, at most max_train of them, by hash of the id."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out)
        .groupBy("doc_id").agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, caution: float = 1.5, drift: float = 1.0, p_max: float = 0.05) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic."""
    spark = docs.sparkSession
    ids = training_labels(labels, "toxic", crc_mod("doc_id", 5) == 0, max_train)
    train = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # max_train rows at most

    def sketch(batches):
        for batch in batches:
            keys, cells, texts = [], [], []
            for _, data, offsets in chunks(batch, "text"):
                starts, ends, at = tokens_of(data, offsets)
                words, parts = word_hashes(LOWER[data], starts, ends), list(features(data, starts, ends))
                of = np.repeat(np.arange(len(at) - 1), np.diff(at))
                of, cell = np.concatenate([of[w] for w, _ in parts]), np.concatenate([c for _, c in parts])
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(len(at)))
                raw = data.tobytes()
                for i in range(len(at) - 1):
                    w = words[at[i] : at[i + 1]]
                    keys.append(hashlib.blake2b(np.unique(w).tobytes(), digest_size=16).digest())
                    held = keys[-1][0] % FOLDS == 0  # copies share a key, and so a fold
                    cells.append(np.unique(cell[order[cuts[i] : cuts[i + 1]]]).astype(np.int32))
                    texts.append(raw[offsets[i] : offsets[i + 1]] if held else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("y").cast(pa.int32()), pa.array(keys, pa.binary()), pa.array(cells, pa.list_(pa.int32())), pa.array(texts, pa.binary())], ["doc_id", "y", "key", "cells", "text"])

    rows = train.mapInArrow(sketch, "doc_id long, y int, key binary, cells array<int>, text binary")
    rows = written(rows.groupBy("y", "key").agg(F.min(F.struct("doc_id", "cells", "text")).alias("r")).select((F.col("y") > 0).alias("toxic"), "r.cells", "r.text"), "toxic-train")
    n0, n1, held0, held1 = rows.agg(*[F.expr(f"count_if({a} and text is {b})") for b in ("null", "not null") for a in ("not toxic", "toxic")]).first()
    model = Model(np.zeros(1 << BITS, np.float32), drift, 1.0, 1.0, p_max, [], (n1 + held1) / max(n0 + n1 + held0 + held1, 1))
    if not n0 or not n1 or not 0 < model.share < 1:
        return model
    used = written(rows.where("text is null").select("toxic", F.explode("cells").alias("cell")).groupBy("cell").agg(F.expr("count_if(not toxic)").alias("n0"), F.expr("count_if(toxic)").alias("n1")), "toxic-cells")
    t0, t1 = (float(x or 0) for x in used.agg(F.sum("n0"), F.sum("n1")).first())
    if not t0 or not t1:
        return model
    weight = PRIOR * (t0 + t1)
    a0, a1 = (F.col(n) + PRIOR * (F.col("n0") + F.col("n1")) for n in ("n0", "n1"))
    delta = F.ln(a1 / (t1 + weight - a1)) - F.ln(a0 / (t0 + weight - a0))
    sure = F.abs(F.col("delta")) - caution * F.sqrt(1 / a0 + 1 / a1)
    odds = used.withColumn("delta", delta).select("cell", (F.signum("delta") * sure).alias("w"), sure.alias("sure")).where("sure > 0").select("cell", "w").toPandas()  # 2^BITS rows at most; most cells have no sure odds
    model.weights[odds["cell"]] = odds["w"]
    cast = spark.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            n, found = [], []
            for _, data, offsets in chunks(batch, "text"):
                starts, ends, at = tokens_of(data, offsets)
                scores = token_scores(data, starts, ends, cast.value)
                for i in range(len(at) - 1):
                    n.append(int(at[i + 1] - at[i]))
                    found.append([s for *_, s in found_in(scores[at[i] : at[i + 1]])])
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["toxic", "n", "found"])

    if held0 and held1:
        texts = rows.where("text is not null").select("toxic", "text")
    else:
        texts = train.select((F.col("y") > 0).alias("toxic"), "text")
    seen = texts.mapInArrow(measure, "toxic boolean, n long, found array<double>").toPandas()  # max_train rows at most
    y, n = seen["toxic"].to_numpy(bool), seen["n"].to_numpy(float)
    best = np.array([max(x, default=0.0) for x in seen["found"]])
    model.lam, model.k = extreme_value(best[~y & (n > 0)], n[~y & (n > 0)])
    x = np.array([math.log1p(evidence(list(f), int(m), model.lam, model.k)) for f, m in zip(seen["found"], n, strict=True)])
    order = np.lexsort((y, x))  # sums in one order, whichever way the rows came
    model.coef = logistic(x[order], y[order].astype(float))
    return model


def score(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """docs without text, with toxicity (0 to 1); with spans, docs with toxicity and the significant passages: array of (start, end) in bytes of the UTF-8 text, token count, score and p
    value. Columns of these names are replaced."""
    cast = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("toxicity", "passages")
    plain, types = numbered_columns(docs)
    text = docs.columns.index("text")
    kept = [i for i in range(len(docs.columns)) if i != text or spans]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.int32()), ("score", pa.float64()), ("p", pa.float64())]))
    more = ["toxicity", *["passages"] * spans]

    def run(batches):
        m = cast.value
        for batch in batches:
            x = np.zeros(batch.num_rows)
            where: list = []
            for rows, data, offsets in chunks(batch, f"c{text}"):
                starts, ends, at = tokens_of(data, offsets)
                scores = token_scores(data, starts, ends, m)
                for i, k in enumerate(range(rows.start, rows.stop)):
                    n = int(at[i + 1] - at[i])
                    found = found_in(scores[at[i] : at[i + 1]])
                    x[k] = math.log1p(evidence([s for *_, s in found], n, m.lam, m.k))
                    if spans:
                        odds = [(a, b, s, -math.expm1(-m.k * n * math.exp(-m.lam * s))) for a, b, s in found]
                        where.append([{"start": int(starts[at[i] + a] - offsets[i]), "end": int(ends[at[i] + b] - offsets[i]), "tokens": b - a + 1, "score": s, "p": p} for a, b, s, p in odds if p <= m.p_max])
            out = 1 / (1 + np.exp(-(m.coef[0] + m.coef[1] * x))) if m.coef else np.full(len(x), m.share)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(out), *([pa.array(where, kind)] if spans else [])], [*(f"c{i}" for i in kept), *more])

    ddl = ", ".join([types[i] for i in kept] + ["toxicity double"] + ["passages array<struct<start:int,end:int,tokens:int,score:double,p:double>>"] * spans)
    return plain.mapInArrow(run, ddl).toDF(*[docs.columns[i] for i in kept], *more)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )
