"""Text quality by a byte-level convolutional network in numpy.

Every byte has a learned vector; learned filters look at 16 bytes at a time, every
8 bytes, so windows overlap and cover the whole document. Filter responses (ReLU)
are max-pooled within each chunk of 64 windows (512 bytes and the 8 they share
with the next), and the mean over all chunks of a document goes through a hidden
layer to one probability: a single odd chunk in a long text does not decide.

Fitting reads a bounded sample, the ``SAMPLE_ROWS`` learnable labelled rows with
the smallest hash of their id among those of at most ``SAMPLE_TEXT_BYTES`` bytes;
scoring broadcasts the model (a few thousand numbers) and reads every whole
text, piece by piece, so memory does not follow a text's length.

Defined results: a null or empty text is one chunk of padding; a document labelled
more than once takes the smaller mark; labels with a null id or mark are not
learned from; without any label the score is 0; with labels of one class alone it
is that class's smoothed share; repeated rows are scored alike. Other columns are
not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.llm.common import held_out, prepare

DEPTH = 4
STRIDE = 8
FILTERS = 32
HIDDEN = 16
POOL = 64  # windows of a chunk
CHUNK = POOL * STRIDE  # bytes by which chunks advance
PIECE = 1 << 20  # bytes looked at together
SAMPLE_ROWS = 5_000
SAMPLE_TEXT_BYTES = 32 << 10
STEPS = 800
BATCH = 64
RATE = 4e-3
ACCEPT = 0.3
HELD_OUT = (5, 0)


@dataclass
class Model:
    bytes_: np.ndarray  # [256, DEPTH]; byte 0 stands for padding, too
    front: np.ndarray  # [STRIDE * DEPTH, FILTERS], a window's first half
    back: np.ndarray  # a window's second half
    bias: np.ndarray
    hidden: np.ndarray  # [FILTERS, HIDDEN]
    hidden_bias: np.ndarray
    out: np.ndarray  # [HIDDEN]
    out_bias: np.ndarray  # [1]

    def responses(self, block: np.ndarray) -> np.ndarray:
        """Filter responses of all windows over whole 8-byte blocks."""
        x = self.bytes_[block].reshape(-1, STRIDE * DEPTH)
        return np.maximum((x @ self.front)[:-1] + (x @ self.back)[1:] + self.bias, 0)

    def pooled(self, text: np.ndarray) -> np.ndarray:
        """The mean over a document's chunks of each filter's largest response."""
        blocks = max(2, -(-len(text) // STRIDE))
        chunks = -(-(blocks - 1) // POOL)
        total = np.zeros(FILTERS)
        step = PIECE // CHUNK
        for lo in range(0, chunks, step):
            hi = min(chunks, lo + step)
            size = (min(hi * POOL, blocks - 1) - lo * POOL + 1) * STRIDE
            part = np.zeros(size, np.uint8)
            got = text[lo * CHUNK : lo * CHUNK + size]
            part[: len(got)] = got
            h = self.responses(part)
            total += np.maximum.reduceat(h, np.arange(0, len(h), POOL), axis=0).sum(axis=0)
        return total / chunks

    def scores(self, features: np.ndarray) -> np.ndarray:
        # row by row: in a product of matrices the last digit of a row hangs on the rows beside it
        hidden = [np.maximum(x @ self.hidden + self.hidden_bias, 0) for x in features]
        logits = np.array([h @ self.out for h in hidden]) + self.out_bias[0]
        return np.where(logits == -np.inf, 0.0, 1 / (1 + np.exp(-np.clip(logits, -500, 500))))


def _start(rng) -> Model:
    f32 = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Model(f32(256, DEPTH, scale=0.5), f32(STRIDE * DEPTH, FILTERS, scale=0.2), f32(STRIDE * DEPTH, FILTERS, scale=0.2),
                 np.zeros(FILTERS, np.float32), f32(FILTERS, HIDDEN, scale=0.3), np.zeros(HIDDEN, np.float32),
                 f32(HIDDEN, scale=0.3), np.zeros(1, np.float32))


def _chunked(text: bytes) -> np.ndarray:
    """A text's chunks as rows of POOL + 1 blocks of bytes, padded with 0."""
    blocks = max(2, -(-len(text) // STRIDE))
    n = -(-(blocks - 1) // POOL)
    raw = np.zeros(n * CHUNK + STRIDE, np.uint8)
    raw[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(raw, CHUNK + STRIDE)[::CHUNK].copy()


def fit(texts: list[bytes], marks: np.ndarray, seed: int = 3) -> Model:
    """The network from texts and their marks (0 or 1), by Adam over whole texts."""
    rng = np.random.default_rng(seed)
    model = _start(rng)
    n, positive = len(texts), int(marks.sum())
    if positive in (0, n):  # nothing to tell apart
        model.out[:] = 0
        model.out_bias[0] = np.log((positive + 0.5) / (n - positive + 0.5)) if n else -np.inf
        return model
    names = list(model.__dataclass_fields__)
    first = {k: np.zeros_like(getattr(model, k)) for k in names}
    second = {k: np.zeros_like(getattr(model, k)) for k in names}
    model.out_bias[0] = np.log(positive / (n - positive))
    step = 0
    for _ in range(-(-STEPS * BATCH // n)):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            pick = order[lo : lo + BATCH]
            rows = [_chunked(texts[i]) for i in pick]
            counts = np.array([len(r) for r in rows])
            owner = np.repeat(np.arange(len(pick)), counts)
            raw = np.concatenate(rows)  # [S, CHUNK + STRIDE]
            x = model.bytes_[raw].reshape(len(raw), POOL + 1, STRIDE * DEPTH)
            h = (x @ model.front)[:, :-1] + (x @ model.back)[:, 1:] + model.bias
            best = h.argmax(axis=1)  # [S, FILTERS]
            top = np.take_along_axis(h, best[:, None], axis=1)[:, 0]
            features = np.zeros((len(pick), FILTERS), np.float32)
            np.add.at(features, owner, np.maximum(top, 0))
            features /= counts[:, None]
            z = features @ model.hidden + model.hidden_bias
            a = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-np.clip(a @ model.out + model.out_bias[0], -30, 30)))
            gap = ((p - marks[pick]) / len(pick)).astype(np.float32)
            grad = {"out": a.T @ gap, "out_bias": np.array([gap.sum()], np.float32)}
            gz = gap[:, None] * model.out * (z > 0)
            grad |= {"hidden": features.T @ gz, "hidden_bias": gz.sum(axis=0)}
            gt = ((gz @ model.hidden.T) / counts[:, None])[owner] * (top > 0)  # [S, FILTERS]
            s = np.arange(len(raw))[:, None]
            xf, xb = x[s, best], x[s, best + 1]  # [S, FILTERS, STRIDE * DEPTH]
            grad |= {"front": np.einsum("sfi,sf->if", xf, gt), "back": np.einsum("sfi,sf->if", xb, gt), "bias": gt.sum(axis=0)}
            gbytes = np.zeros_like(model.bytes_)
            blocks = raw.reshape(len(raw), POOL + 1, STRIDE)
            for at, half in ((best, model.front), (best + 1, model.back)):
                g = (gt[:, :, None] * half.T[None]).reshape(len(raw), FILTERS, STRIDE, DEPTH)
                which = blocks[s, at].reshape(-1)
                flat = g.reshape(-1, DEPTH)
                for d in range(DEPTH):
                    gbytes[:, d] += np.bincount(which, flat[:, d], 256)
            grad["bytes_"] = gbytes
            step += 1
            for k in names:
                g = np.asarray(grad[k], np.float32)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(model, k, (getattr(model, k) - RATE * move).astype(np.float32))
    return model


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, mark: str = "quality",
          split: tuple[int, int] | None = HELD_OUT, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled documents, none of them held out by ``split``."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(mark).isNotNull())
    if split:
        known = known.filter(~held_out(F.col("doc_id"), *split))
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.min(F.col(mark).cast("int")).alias("__mark"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    # at most sample_rows pairs of numbers are broadcast
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    chosen = chosen.filter(F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_TEXT_BYTES)
    got = sorted({(r[0], r[1] or "", r[2]) for r in chosen.select("doc_id", "text", "__mark").toLocalIterator()})
    return fit([t.encode("utf-8", "replace") for _, t, _ in got], np.array([m for *_, m in got], np.int64))


def scorer(spark: SparkSession, model: Model):
    """A function of the text column that gives the score."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        m = shared.value
        if len(text) == 0:
            return pd.Series([], dtype=float)
        raw = [np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8) for t in text]
        return pd.Series(m.scores(np.stack([m.pooled(x) for x in raw])).astype(np.float64))

    return score


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    score = scorer(spark, train(spark, docs, labels))
    return docs.select(
        "doc_id", held_out(F.col("doc_id"), *HELD_OUT).alias("held_out"), score("text").alias("score")
    ).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
