import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quayline.llm import suffixes
from tests.llm.data import HAVE_DATA, SF, awkward_rows, docs_frame, rows_of

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows, length=200):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(t[s : s + length] for _, t in texts for s in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - length + 1):
            if count[t[s : s + length]] > 1:
                gone[s : s + length] = True
        gone = gone[: len(t)]
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(t) else 0
        rest = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n_docs=60):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    shared = [text(n) for n in (180, 199, 200, 201, 260, 800, 3000)]
    rows = []
    for i in range(n_docs):
        parts = [text(rng.randrange(0, 500))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            cut = rng.randrange(0, max(1, len(s) - 150))
            parts += [s[cut:] if rng.random() < 0.5 else s, text(rng.randrange(0, 300))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[5][1] + "!"), (103, "ab" * 400), (104, rows[7][1] * 2)]
    return rows


def test_minima_and_anchors():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1000, 2000).astype(np.uint64)
    got = suffixes.sliding_minimum(x, 153)
    assert (got == [x[i : i + 153].min() for i in range(len(x) - 152)]).all()
    raw = rng.integers(97, 105, 5000).astype(np.uint8)
    ends = np.array([0, 150, 1500, 1500, 5000])
    text, first, last, anchor, _, _ = suffixes.anchored_runs(raw, ends, 200, 48)
    windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    assert (windows == [s for a, b in zip(ends[:-1], ends[1:]) for s in range(a, b - 199)]).all()
    assert ((anchor >= last) & (anchor <= first + 152)).all() and set(text) == {1, 3}


def test_pieces_of_long_texts_give_the_same_runs(monkeypatch):
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 101, 30_000).astype(np.uint8)
    ends = np.array([0, 700, 25_000, 25_000, 30_000])
    windows = lambda: sorted(
        (int(numbers[t]), int(s - cuts[t] + moved[t]), int(k))
        for part, cuts, numbers, moved in suffixes._pieces(raw, ends, 200)
        for t, a, b, _, k, _ in zip(*suffixes.anchored_runs(part, cuts, 200, 48)) for s in range(a, b + 1))
    whole = windows()
    monkeypatch.setattr(suffixes, "PIECE", 3000)
    assert windows() == whole


@pytest.mark.parametrize("seed,batches", [(1, 1), (2, 3), (3, 4)])
def test_matches_brute_force(spark, seed, batches):
    rows = made(seed)
    assert rows_of(suffixes.deduplicated(docs_frame(spark, rows), batches=batches), *COLUMNS) == brute(rows)


def test_awkward_rows(spark):
    rows = [r[:2] for r in awkward_rows()]
    rows = [(i, t[:20_000] if t else t) for i, t in rows] + [(40, None), (None, "z" * 250), (None, "z" * 199)]
    docs = docs_frame(spark, rows)
    assert rows_of(suffixes.deduplicated(docs), *COLUMNS) == brute(rows)
    assert suffixes.deduplicated(docs.limit(0)).count() == 0


def test_levels_merge_like_a_counter(spark):
    docs = docs_frame(spark, [r for r in made(9, 30) if r[0] not in (100, 101)])  # a task indexes copies once
    family = suffixes.IndexFamily(spark, buckets=4)
    held = []
    for b in range(5):
        family.add(docs.filter(f"doc_id % 5 = {b}"))
        held.append(sorted(family.levels))
    assert held == [[0], [1], [0, 1], [2], [0, 2]]
    merged = spark.table(family.levels[2]).unionAll(spark.table(family.levels[0]))
    one = suffixes.IndexFamily(spark, buckets=4)
    one.add(docs)
    columns = ("key", "span", "doc", "packed")
    distinct = lambda df: sorted(set(map(tuple, df.select(*columns).collect())))
    assert distinct(merged) == distinct(spark.table(one.levels[0]))
    assert distinct(family.entries()) == distinct(one.entries())
    plan = merged.join(spark.table(family.levels[2]).select("key"), "key", "left_semi")._jdf.queryExecution().executedPlan().toString()
    family.close()
    one.close()
    assert "Exchange hashpartitioning" not in plan


@pytest.mark.skipif(not HAVE_DATA, reason="driver tables not present")
def test_driver_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(suffixes.deduplicated(docs), *COLUMNS) == brute(rows)


def test_rows_with_null_or_repeated_ids_keep_their_own_cuts(spark):
    rng = random.Random(4)
    letters = "".join(rng.choice("abcdefghijklmnop") for _ in range(200_000))
    shared = [letters[k * 400 : k * 400 + 210 + k] for k in range(60)]
    rows = []
    for i in range(3000):
        at, cut = rng.randrange(150_000), rng.randrange(0, 60)
        rows.append((None if i % 3 else 7 if i % 2 else i, f"{i} {letters[at : at + cut]}{shared[i % 60]}" + f" {i} end" * (i % 5)))
    assert rows_of(suffixes.deduplicated(docs_frame(spark, rows), batches=2), *COLUMNS) == brute(rows)
