import random

import numpy as np
import pytest

from quayline.llm import quality, toxicity
from quayline.llm.common import held_out
from pyspark.sql import functions as F
from tests.llm.data import HAVE_DATA, SF2, awkward_rows, docs_frame, rows_of

LABELS = "doc_id long, quality int, toxic int, score string, text string"


def labels(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], LABELS)


def test_pairs_outweigh_parts():
    """Two terms that mean something only together: a linear model cannot tell, the machine can."""
    rng = random.Random(0)
    a, b = toxicity.places_of(b"aaa")[0], toxicity.places_of(b"bbb")[0]
    rows, marks = [], []
    for _ in range(3000):
        both = (rng.random() < 0.5, rng.random() < 0.5)
        noise = {toxicity.places_of(b"n%d" % rng.randrange(50))[0] for _ in range(5)}
        rows.append(np.array(sorted(noise | {x for x, on in zip((a, b), both) if on}), np.int32))
        marks.append(int(all(both)))
    model = toxicity.fit(rows, np.array(marks))
    logit = lambda *p: model.logit([x for x in p if model.weights[x]])
    assert logit(a, b) > 0 > max(logit(a), logit(b), logit())
    assert logit(a, b) - logit() > (logit(a) - logit()) + (logit(b) - logit()) + 0.5


def test_model_score_is_the_pairwise_sum():
    rng = np.random.default_rng(1)
    model = toxicity.Model(0.3, rng.normal(size=toxicity.PLACES).astype(np.float32),
                           rng.normal(size=(toxicity.PLACES, toxicity.FACTORS)).astype(np.float32))
    p = [3, 77, 1000, 5000]
    pairs = sum(float(model.factors[i] @ model.factors[j]) for n, i in enumerate(p) for j in p[:n])
    assert abs(model.logit(p) - (0.3 + float(model.weights[p].sum()) + pairs)) < 1e-3
    assert model.logit([]) == 0.3


def test_network_pooling_covers_whole_texts(monkeypatch):
    model = quality._start(np.random.default_rng(2))
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 16, 17, 519, 520, 521, 5000, 70_001):
        text = rng.integers(1, 256, n).astype(np.uint8)
        rows = quality._chunked(text.tobytes())
        x = model.bytes_[rows].reshape(len(rows), quality.POOL + 1, -1)
        h = np.maximum((x @ model.front)[:, :-1] + (x @ model.back)[:, 1:] + model.bias, 0)
        blocks = max(2, -(-n // quality.STRIDE))
        h[-1, (blocks - 1) - (len(rows) - 1) * quality.POOL :] = 0  # windows past the end
        monkeypatch.setattr(quality, "PIECE", 1 << 20)
        whole = model.pooled(text)
        monkeypatch.setattr(quality, "PIECE", quality.CHUNK * 3)  # pieces give the same
        assert np.allclose(whole, h.max(axis=1).mean(axis=0), atol=1e-4)
        assert np.allclose(whole, model.pooled(text), atol=1e-4)


def test_network_learns_a_byte_pattern():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, marks = [], []
    for i in range(600):
        bad = i % 3 == 0
        texts.append(" ".join(word() + ("$$%" if bad else "") for _ in range(rng.randrange(5, 200))).encode())
        marks.append(0 if bad else 1)
    model = quality.fit(texts[:400], np.array(marks[:400]))
    score = model.scores(np.stack([model.pooled(np.frombuffer(t, np.uint8)) for t in texts[400:]]))
    assert ((score >= 0.5) == (np.array(marks[400:]) == 1)).mean() > 0.97


@pytest.mark.parametrize("op,mark", [(toxicity, "toxic"), (quality, "quality")])
def test_awkward_rows(spark, op, mark):
    docs = docs_frame(spark, awkward_rows())
    known = labels(spark, [(2, 1, 1), (3, 0, 0), (4, 1, 0), (6, 0, 1), (8, 1, 0), (None, 1, 1), (10, None, None), (4, 1, 0)])
    got = op.scored(docs, known)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = rows_of(got, "doc_id", "held_out", "score", "predicted")
    assert len(rows) == len(awkward_rows())
    assert all(0 <= r[2] <= 1 and r[3] in (0, 1) for r in rows)
    same = {r[2] for r in rows if r[0] in (11, 12)}
    assert len(same) == 1
    limit = op.REJECT if op is toxicity else op.ACCEPT
    assert all(r[3] == int(r[2] >= limit) for r in rows)
    assert op.scored(docs.limit(0), known).count() == 0
    assert {r[2] for r in rows_of(op.scored(docs, known.limit(0)), "doc_id", "held_out", "score")} == {0.0}
    one = op.scored(docs, known.withColumn(mark, F.lit(1)))
    assert len({round(r.score, 12) for r in one.collect()}) == 1


@pytest.mark.skipif(not HAVE_DATA, reason="driver tables not present")
@pytest.mark.parametrize("op,mark,least", [(toxicity, "toxic", 0.85), (quality, "quality", 0.9)])
def test_held_out_accuracy(spark, op, mark, least):
    docs, known = (spark.read.parquet(f"{SF2}/{t}.parquet") for t in ("documents", "labels"))
    got = op.scored(docs, known).filter("held_out").join(known, "doc_id").toPandas()
    assert (got["predicted"] == got[mark]).mean() > least


@pytest.mark.skipif(not HAVE_DATA, reason="driver tables not present")
@pytest.mark.parametrize("op", [toxicity, quality])
def test_held_out_labels_do_not_matter(spark, op):
    docs, known = (spark.read.parquet(f"{SF2}/{t}.parquet") for t in ("documents", "labels"))
    other = known.withColumns({
        c: F.when(held_out(F.col("doc_id"), *op.HELD_OUT), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    docs = docs.filter("doc_id < 300")
    columns = ("doc_id", "score")
    assert rows_of(op.scored(docs, known), *columns) == rows_of(op.scored(docs, other), *columns)
