"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-case words (runs of ASCII letters and
digits and all non-ASCII bytes) and the first 4, 5 and 6 bytes of longer words,
each hashed to one of 2^18 places; each term counts once. The logit is

    bias + sum w_i + sum_{i<j} <v_i, v_j>

so a pair such as an insult and a group's name can weigh more than its parts.
Only terms whose presence goes with the mark are learned (a chi-square test on the
sample), and the weights are fitted with AdaGrad and a proximal L1 step, which
leaves terms without evidence at exactly 0: a long text does not gather noise. Fitting reads a
bounded sample, the ``SAMPLE_ROWS`` learnable labelled rows with the smallest
hash of their id; scoring broadcasts the model (2^18 x 9 numbers, whatever
the input) and reads every whole text.

Defined results: a null or empty text has no terms and scores the sigmoid of the
bias; a document labelled more than once is toxic if any label says so; labels
with a null id or mark are not learned from; without any label the score is 0;
with labels of one class alone it is that class's smoothed share; repeated rows
are scored alike. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.llm.common import held_out, prepare

PLACES = 1 << 18
FACTORS = 8
PREFIXES = (4, 5, 6)
SAMPLE_ROWS = 16_000
MIN_SAMPLE_DOCS = 3  # terms in fewer sample documents are not learned
LEAST_CHI2 = 20.0  # nor are terms whose presence is unrelated to the mark
EPOCHS = 25
BATCH = 128
RATE = 0.3
L1 = 1e-5
L2 = 3e-3
REJECT = 0.7
HELD_OUT = (3, 1)
_KEEP = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))


def places_of(word: bytes) -> tuple[int, ...]:
    from xxhash import xxh32_intdigest

    out = [xxh32_intdigest(b"w" + word)]
    out += [xxh32_intdigest(b"p%d" % n + word[:n]) for n in PREFIXES if len(word) > n]
    return tuple(x & (PLACES - 1) for x in out)


class Terms(dict):
    """Places of words, computed once each; with ``active`` only those places are kept."""

    def __init__(self, active: np.ndarray | None = None, most: int = 200_000):
        super().__init__()
        self.active, self.most = active, most

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = places_of(word)
        if self.active is not None:
            found = tuple(x for x in found if self.active[x])
        if len(self) >= self.most:
            self.clear()
        self[word] = found
        return found

    def of(self, text: str) -> list[int]:
        out: set[int] = set()
        for word in set(text.lower().encode("utf-8", "replace").translate(_KEEP).split()):
            if places := self[word]:
                out.update(places)
        return sorted(out)


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # float32 [PLACES]
    factors: np.ndarray  # float32 [PLACES, FACTORS]

    def logit(self, places: list[int]) -> float:
        if not places:
            return self.bias
        v = self.factors[places]
        s = v.sum(axis=0)
        return float(self.bias + self.weights[places].sum() + 0.5 * (s @ s - (v * v).sum()))


def screened(rows: list[np.ndarray], marks: np.ndarray) -> np.ndarray:
    """Places whose presence goes with the mark: a chi-square test of presence and mark."""
    n, positive = len(rows), int(marks.sum())
    every = np.bincount(np.concatenate(rows), minlength=PLACES).astype(float)
    hit = np.bincount(np.concatenate([r for r, m in zip(rows, marks) if m]), minlength=PLACES)
    expected = every * positive / n
    spread = expected * (1 - positive / n) * (1 - every / n)
    return (every >= MIN_SAMPLE_DOCS) & ((hit - expected) ** 2 > LEAST_CHI2 * np.maximum(spread, 1e-12))


def fit(rows: list[np.ndarray], marks: np.ndarray, seed: int = 5) -> Model:
    """Weights of the machine from each row's places and its mark (0 or 1)."""
    rng = np.random.default_rng(seed)
    n, positive = len(rows), int(marks.sum())
    model = Model(0.0, np.zeros(PLACES, np.float32), np.zeros((PLACES, FACTORS), np.float32))
    if n == 0:
        model.bias = -np.inf
        return model
    model.bias = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    if positive in (0, n):
        return model
    kept = screened(rows, marks)
    rows = [r[kept[r]] for r in rows]
    used = np.flatnonzero(kept)
    model.factors[used] = rng.normal(0, 0.01, (len(used), FACTORS))
    sum_w, sum_v, sum_b = np.full(PLACES, 1e-2, np.float32), np.full((PLACES, FACTORS), 1e-2, np.float32), 1.0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            pick = order[lo : lo + BATCH]
            places = np.concatenate([rows[i] for i in pick])
            lengths = np.array([len(rows[i]) for i in pick])
            owner = np.repeat(np.arange(len(pick)), lengths)
            v = model.factors[places]
            s = np.zeros((len(pick), FACTORS), np.float32)
            np.add.at(s, owner, v)
            squares = np.bincount(owner, (v * v).sum(axis=1), len(pick))
            linear = np.bincount(owner, model.weights[places], len(pick))
            logit = model.bias + linear + 0.5 * ((s * s).sum(axis=1) - squares)
            gap = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - marks[pick]
            touched, inverse = np.unique(places, return_inverse=True)
            g = np.bincount(inverse, gap[owner], len(touched)).astype(np.float32)
            gv = np.zeros((len(touched), FACTORS), np.float32)
            np.add.at(gv, inverse, gap[owner, None].astype(np.float32) * (s[owner] - v))
            w = model.weights[touched]
            sum_w[touched] += g * g
            step = RATE / np.sqrt(sum_w[touched])
            w = w - step * g
            shrink = step * L1 * len(pick)
            model.weights[touched] = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
            f = model.factors[touched]
            gv += L2 * len(pick) * f
            sum_v[touched] += gv * gv
            model.factors[touched] = f - 0.5 * RATE / np.sqrt(sum_v[touched]) * gv
            gb = float(gap.sum())
            sum_b += gb * gb
            model.bias -= RATE / np.sqrt(sum_b) * gb
    # a term without a linear weight has no evidence of its own; its pairs go with it
    model.factors[model.weights == 0] = 0
    return model


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, mark: str = "toxic",
          split: tuple[int, int] | None = HELD_OUT, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled documents, none of them held out by ``split``."""
    prepare(spark)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(mark).isNotNull())
    if split:
        known = known.filter(~held_out(F.col("doc_id"), *split))
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col(mark).cast("int")).alias("__mark"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)

    @F.pandas_udf("binary")
    def places(text: pd.Series) -> pd.Series:
        terms = Terms()
        return text.map(lambda t: np.array(terms.of(t or ""), np.int32).tobytes())

    # at most sample_rows pairs of numbers are broadcast
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    got = chosen.select("doc_id", "__mark", places("text").alias("places")).toPandas()
    got = got.sort_values(["doc_id", "places"]).drop_duplicates(["doc_id", "places"])
    return fit([np.frombuffer(x, np.int32) for x in got["places"]], got["__mark"].to_numpy(np.int64))


def scorer(spark: SparkSession, model: Model):
    """A function of the text column that gives the score."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        m = shared.value
        terms = Terms(m.weights != 0)
        logits = np.array([m.logit(terms.of(t or "")) for t in text], np.float64)
        return pd.Series(1 / (1 + np.exp(-np.clip(logits, -500, 500))) * (logits > -np.inf))

    return score


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    score = scorer(spark, train(spark, docs, labels))
    return docs.select(
        "doc_id", held_out(F.col("doc_id"), *HELD_OUT).alias("held_out"), score("text").alias("score")
    ).withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject, as they are."""
    spark = docs.sparkSession
    score = scorer(spark, train(spark, docs, labels))
    return docs.withColumn("__toxicity", score(docs["text"])).filter(F.col("__toxicity") < REJECT).select(*docs.columns)
