import math
import random

import pyarrow as pa
import pytest

from quayline.llm import topk
from tests.llm.data import HAVE_DATA, SF, duck, oracle_rows, rows_of

COLUMNS = ("query_id", "rank", "vec_id", "score")
SCHEMA = "vec_id long, embedding array<float>, query long, score string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(4)


def long_of(x):
    return min(max(x, topk.LOWEST), topk.HIGHEST)


def brute(rows, every, k):
    kept = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [long_of(math.floor(64 * x)) if math.isfinite(64 * x) else long_of(int(x)) for x in v]))
    out = []
    for n, (i, q) in enumerate(kept):
        if i % every == 0:
            s = sorted((-long_of(sum(a * b for a, b in zip(q, w))), j) for m, (j, w) in enumerate(kept) if m != n)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("lists", [1, 2, 5])
def test_matches_brute_force(spark, lists):
    rng = random.Random(lists)
    # exact in float32, many ties
    rows = [(i, [rng.randrange(-64, 64) / 64 for _ in range(8)]) for i in range(400)]
    rows += [(401 + i, [0.5] * 8) for i in range(60)]
    got = topk.search(frame(spark, rows), every=20, k=7, lists=lists)
    assert rows_of(got, *COLUMNS) == brute(rows, 20, 7)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, -inf]), (6, []),
            (7, [0.5]), (8, [1.0, 1.0, 4.0]), (None, [9.0, 9.0]), (20, [-3.0, 0.25]), (20, [-3.0, 0.25]), (9, [2.0, 1.0]),
            (9, [1.0, 2.0]), (40, [2.0**40, 2.0**40])]
    got = topk.search(frame(spark, rows), every=20, k=3)
    assert rows_of(got, *COLUMNS) == brute(rows, 20, 3)


def test_rows_that_repeat_an_id(spark):
    rng = random.Random(9)
    rows = [(rng.choice([20, 40, 7, 8]), [rng.randrange(-9, 9) / 8 for _ in range(4)]) for _ in range(120)]
    rows += [(20, [5.0, 0.0, 0.0, 0.0])] * 3 + [(7, [2.0, 0.0]), (7, [3.0, 0.0])]
    got = topk.search(frame(spark, rows), every=20, k=9)
    assert rows_of(got, *COLUMNS) == brute(rows, 20, 9)
    con = duck()
    con.register("embeddings", pa.table({"vec_id": [i for i, _ in rows], "embedding": [v + [0.0] * (4 - len(v)) for _, v in rows]}))
    assert brute(rows, 20, 9) == oracle_rows(con, topk.oracle_sql(k=9), *COLUMNS)


@pytest.mark.parametrize("lists", [1, 2, 3])
def test_products_beyond_doubles_and_longs(spark, lists):
    """Scores that differ below the precision of doubles, beyond 64 bits, and components beyond them."""
    rng = random.Random(lists)
    rows = [(i, [float(rng.randrange(2**18, 2**26)) for _ in range(3)]) for i in range(60)]
    wide = rows + [(100 + i, [rng.choice([-1.0, 1.0]) * 2.0 ** rng.randrange(0, 60) for _ in range(3)]) for i in range(60)]
    wide += [(200, [1e300, 1.0, 0.0]), (201, [-1e308, 1e-3, 2.0]), (202, [1.7e308, -1.7e308, 0.0]), (203, [0.0, 0.0, 1.0])]
    for some in (rows, wide):
        df = spark.createDataFrame(some, "vec_id long, embedding array<double>").repartition(3)
        assert rows_of(topk.search(df, every=20, k=5, lists=lists), *COLUMNS) == brute(some, 20, 5)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(0, [1.0]), (1, [2.0])]
    assert rows_of(topk.search(frame(spark, rows)), *COLUMNS) == [(0, 1, 1, 64 * 128)]
    assert topk.search(frame(spark, rows).limit(0)).count() == 0
    assert topk.search(frame(spark, [(1, [1.0])])).count() == 0


@pytest.mark.skipif(not HAVE_DATA, reason="driver tables not present")
def test_matches_sql(spark):
    got = topk.search(spark.read.parquet(f"{SF}/embeddings.parquet"))
    con = duck(embeddings=f"{SF}/embeddings.parquet")
    assert rows_of(got, *COLUMNS) == oracle_rows(con, topk.oracle_sql(), *COLUMNS)
