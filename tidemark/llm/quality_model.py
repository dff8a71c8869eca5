"""Quality classifier: a factorisation machine on hashed words and text statistics.

A text is a sparse vector of hashed words (share of the text's words, square root,
then unit length) and of structure statistics and the text's size as metadata. The
model is w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j; the pair term is computed
as half of the sum over factors of (sum v x)^2 - sum (v x)^2, so scoring is linear.

It is fitted on at most `most_rows` labelled rows, those with the smallest hashes of
doc_id: a bounded sample of labels, the only bound here. Labels, lang, source and
doc_id are never inputs. Every text is scored whole. Null and empty texts are
scored by their statistics alone. Repeated rows get equal scores; repeated labels
count once (the larger), and of several texts with one doc_id the least is learnt
from. Without labels the model is constant at 0.5.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import quality_rules
from tidemark.llm import text as tx

BUCKETS = 1 << 15
FACTORS = 8
EPOCHS = 8
MOST_ROWS = 6_000
THRESHOLD = 0.3
N_STATS = len(quality_rules.STATS) + 2


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, values and row offsets of the sparse vectors; statistics take the ids after the buckets."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, stats = quality_rules.text_counts(texts)
    chars = np.asarray(pc.utf8_length(texts)).astype(np.float64)
    newlines = np.asarray(pc.count_substring(texts, "\n")).astype(np.float64)
    stats = np.column_stack([stats, np.log1p(chars), np.sqrt(newlines / np.maximum(chars, 1))])
    flat, offsets = tx.words(texts, lower=True)
    codes, distinct = tx.coded(flat)
    bucket = (tx.mixed(tx.hashed(distinct)) % np.uint64(BUCKETS)).astype(np.int64)[codes]
    row = tx.row_of(offsets)
    pair, n = np.unique(row * BUCKETS + bucket, return_counts=True)
    row, ids, val = pair // BUCKETS, pair % BUCKETS, np.sqrt(n.astype(np.float64))
    norm = np.sqrt(np.bincount(row, val * val, minlength=len(texts)))
    val = val / np.maximum(norm[row], 1e-9)
    rows = np.concatenate([row, np.repeat(np.arange(len(texts)), N_STATS)])
    ids = np.concatenate([ids, np.tile(np.arange(BUCKETS, BUCKETS + N_STATS), len(texts))])
    val = np.concatenate([val, stats.ravel()])
    order = np.argsort(rows, kind="stable")
    return ids[order], val[order], np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(texts)))]).astype(np.int64)


class Model:
    """Parameters of fixed size: 1 + (BUCKETS + N_STATS) * (1 + FACTORS) numbers and the statistics' scales."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray, centre: np.ndarray, scale: np.ndarray):
        self.w0, self.w, self.v, self.centre, self.scale = w0, w, v, centre, scale

    def scaled(self, ids: np.ndarray, val: np.ndarray) -> np.ndarray:
        is_stat = ids >= BUCKETS
        k = np.where(is_stat, ids - BUCKETS, 0)
        return np.where(is_stat, np.clip((val - self.centre[k]) / self.scale[k], -6, 6) * 0.3, val)

    def raw(self, ids: np.ndarray, val: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The model's value of each row, and its sums of v x."""
        at = offsets[:-1]
        linear = np.add.reduceat(self.w[ids] * val, at)
        sums, squares = np.empty((len(at), FACTORS), np.float64), np.zeros(len(at))
        for f in range(FACTORS):
            vx = self.v[ids, f] * val
            sums[:, f] = np.add.reduceat(vx, at)
            squares += np.add.reduceat(vx * vx, at)
        return self.w0 + linear + 0.5 * (np.square(sums).sum(axis=1) - squares), sums

    def score(self, texts: pa.Array) -> np.ndarray:
        ids, val, offsets = features(texts)
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, self.scaled(ids, val), offsets)[0], -30, 30)))


def fit(texts: pa.Array, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.15, seed: int = 7) -> Model:
    """Minibatch AdaGrad on the logistic loss; statistics are centred and scaled by the sample."""
    rng = np.random.default_rng(seed)
    n = BUCKETS + N_STATS
    model = Model(0.0, np.zeros(n), rng.normal(0, 0.02, (n, FACTORS)), np.zeros(N_STATS), np.ones(N_STATS))
    if not len(y):
        return model
    ids, val, offsets = features(texts)
    stats = val[ids >= BUCKETS].reshape(len(y), N_STATS)
    model.centre, model.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    val = model.scaled(ids, val)
    g0, gw, gv = 1e-6, np.full(n, 1e-6), np.full((n, FACTORS), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for b in range(0, len(y), 32):
            pick = order[b : b + 32]
            sizes = offsets[pick + 1] - offsets[pick]
            offs = np.concatenate([[0], np.cumsum(sizes)])
            at = np.arange(offs[-1]) - np.repeat(offs[:-1] - offsets[pick], sizes)
            i, x = ids[at], val[at]
            z, sums = model.raw(i, x, offs)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            e = np.repeat(err, sizes)
            u, inv = np.unique(i, return_inverse=True)
            dw = np.bincount(inv, e * x) + 1e-5 * model.w[u]
            gw[u] += dw * dw
            model.w[u] -= rate * dw / np.sqrt(gw[u])
            per = np.repeat(np.arange(len(pick)), sizes)
            for f in range(FACTORS):
                dv = np.bincount(inv, e * x * (sums[per, f] - model.v[i, f] * x)) + 1e-4 * model.v[u, f]
                gv[u, f] += dv * dv
                model.v[u, f] -= 0.3 * rate * dv / np.sqrt(gv[u, f])
            d0 = err.sum()
            g0 += d0 * d0
            model.w0 -= rate * d0 / np.sqrt(g0)
    return model


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Fits on at most most_rows labelled rows outside the held-out fold."""
    y = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y"))
    y = y.where("crc32(cast(doc_id as string)) % 5 != 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    sample = tx.documents(docs).join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

    def run(frames):
        pdf = pd.concat(list(frames)).sort_values("doc_id")
        m = fit(pa.array(pdf["text"], pa.string()), pdf["y"].to_numpy(float))
        yield pd.DataFrame({"w0": [m.w0], "w": [m.w], "v": [m.v.ravel()], "centre": [m.centre], "scale": [m.scale]})

    one = sample.coalesce(1).mapInPandas(run, "w0 double, w array<double>, v array<double>, centre array<double>, scale array<double>")
    row = one.first() if y.take(1) else None
    if row is None:
        return fit(pa.array([], pa.string()), np.zeros(0))
    return Model(row.w0, np.array(row.w), np.array(row.v).reshape(-1, FACTORS), np.array(row.centre), np.array(row.scale))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, about 2.7 MB

    def run(batches):
        for block in tx.blocks(batches, 6 << 20):
            p = shared.value.score(tx.column(block, "text"))
            yield pa.RecordBatch.from_arrays([tx.column(block, "doc_id"), tx.column(block, "held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out")
    return tx.documents(docs).select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, train(docs, labels, most_rows), threshold)
