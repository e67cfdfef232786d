import random

import numpy as np
import pytest

from quayline.llm import graph, jaccard
from quayline.llm.common import ROWS_PER_BATCH, written
from quayline.llm.graph import components
from quayline.session import settings
from tests.llm.data import HAVE_DATA, SF, awkward_rows, docs_frame, rows_of


def shingle_set(text, words=3):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute(rows, least=90, words=3):
    sets = [shingle_set(r[1], words) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            n = len(a & b)
            if a and b and 100 * n >= least * (len(a) + len(b) - n):
                root[find(i)] = find(j)
    name = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            name[find(i)] = min(name.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), name.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=repr)


def near_copies(seed, texts=25):
    """Chains of edits around the threshold, over sizes from a few words to thousands."""
    rng = random.Random(seed)
    rows = []
    for _ in range(texts):
        n = rng.choice([3, 4, 6, 9, 11, 14, 21, 29, 60, 150, 700, 2500])
        w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        rows.append(" ".join(w))
        for _ in range(rng.randrange(0, 6)):
            w = list(w)
            for _ in range(max(1, int(n * rng.choice([0.004, 0.01, 0.02, 0.03])))):
                kind, i = rng.random(), rng.randrange(len(w))
                if kind < 0.4:
                    w[i] = f"x{rng.randrange(10**6)}"
                elif kind < 0.7:
                    w.insert(i, f"y{rng.randrange(10**6)}")
                elif len(w) > 3:
                    del w[i]
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return [(1000 + i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("least", [90, 80])
def test_linked_sets_share_a_signature(least):
    """PartEnum's promise, for pairs at the threshold across sizes and band borders."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(2, 1500))
        most = (100 - least) * n // 100  # |B| >= least % of |A|: drop some, and replace some
        drop = int(rng.integers(0, most + 1))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = a[: n - drop].copy()
        swap = 0
        while 100 * (len(b) - swap - 1) >= least * (n + swap + 1) and rng.random() < 0.9:
            swap += 1
        b[:swap] = rng.integers(0, 2**63, swap)
        shared = len(set(a.tolist()) & set(b.tolist()))
        if 100 * shared < 90 * (len(a) + len(b) - shared) or (drop == 0 and swap == 0):
            continue
        got = []
        for x in (a, b):
            band = int(np.searchsorted(jaccard.EDGES, len(x), "left")) - 1
            bands = [band] + [band + 1] * int(len(x) * 100 // least > jaccard.EDGES[band + 1])
            got.append({int(s) for k in bands for s in jaccard.signatures(np.unique(x), np.array([len(x)]), np.array([k]), least)[0]})
        assert got[0] & got[1], (n, drop, swap)


def test_sketches_differ_by_no_more_than_the_sets():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a = rng.integers(0, 2**63, int(rng.integers(1, 900))).astype(np.uint64)
        b = np.concatenate((a[int(rng.integers(0, len(a))) :], rng.integers(0, 2**63, int(rng.integers(0, 300))).astype(np.uint64)))
        one, two = (np.unique(x) for x in (a, b))
        words = jaccard.sketches(np.concatenate((one, two)), np.array([len(one), len(two)]))
        differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in words[0] ^ words[1])
        assert differ <= len(set(one.tolist()) ^ set(two.tolist()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    rows = near_copies(seed)
    assert rows_of(jaccard.classes(docs_frame(spark, rows)), "doc_id", "n_shingles", "component_id") == brute(rows)


@pytest.mark.parametrize("seed", [5, 6])
def test_five_words_and_four_fifths(spark, seed):
    rows = near_copies(seed)
    got = jaccard.classes(docs_frame(spark, rows), least=80, words=5)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute(rows, 80, 5)
    kept = {r.doc_id for r in jaccard.representatives(docs_frame(spark, rows), least=80, words=5).collect()}
    assert kept == {c for _, _, c in brute(rows, 80, 5)}


def test_pivots_go_on_until_no_link_is_missed(spark, monkeypatch):
    """With few signatures many sets share each, and most of them are not similar."""
    rows = near_copies(4, 40)
    plain = jaccard.signed_documents

    def coarse(docs, least, words):
        from pyspark.sql import functions as F

        return plain(docs, least, words).withColumn("signatures", F.array_distinct(F.transform("signatures", lambda s: F.pmod(s, F.lit(3)))))

    monkeypatch.setattr(jaccard, "signed_documents", coarse)
    assert rows_of(jaccard.classes(docs_frame(spark, rows)), "doc_id", "n_shingles", "component_id") == brute(rows)


def test_awkward_rows(spark):
    rows = [r[:2] for r in awkward_rows()] + [(None, "same text here " * 40), (50, "Same\tTEXT here " * 40)]
    docs = docs_frame(spark, rows)
    assert rows_of(jaccard.classes(docs), "doc_id", "n_shingles", "component_id") == brute(rows)
    assert jaccard.classes(docs.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    rows = [r[:2] for r in awkward_rows()] + [(5, "other text with id five"), (60, "other text with id five"), (4, "one"), (2, "")]
    docs = docs_frame(spark, rows)
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    blank = [r for r in rows if not shingle_set(r[1])]
    assert sorted([r for r in got if not shingle_set(r[1])], key=repr) == sorted(blank, key=repr)  # texts without words stay
    first = {}  # in this table components are equal sets, and 9 with 8
    for i, t in rows:
        if s := shingle_set(t):
            s = s if len(s) < 100 else "long"
            first[s] = min(first.get(s, (10**9, "")), (-1 if i is None else i, t))
    assert sorted((-1 if i is None else i, t) for i, t in got if shingle_set(t)) == sorted(first.values())


def shuffled(node):
    """Rows that each shuffle of an executed plan wrote."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled(node.executedPlan())
    if name.endswith("QueryStage"):
        return shuffled(node.plan())
    own = [node.metrics().apply("shuffleRecordsWritten").value()] if name == "Exchange" else []
    kids = node.children()
    return own + [n for i in range(kids.size()) for n in shuffled(kids.apply(i))]


@pytest.mark.parametrize("again", [0, 3])
def test_texts_that_stay_are_not_shuffled(spark, again):
    rng = random.Random(7)
    text = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(20))
    rows = [(i, text()) for i in range(200)]
    rows += [(1000 + i, rows[i][1]) for i in range(5)] + [rows[100 + i] for i in range(again)]
    docs = written(docs_frame(spark, rows), "test")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": -1}):
        kept = jaccard.representatives(docs)
        got = kept.collect()
        plan = kept._jdf.queryExecution().executedPlan()
    assert sorted(r.doc_id for r in got) == list(range(200))
    assert 5 <= max(shuffled(plan)) <= 20


def test_a_batch_that_holds_nothing_new(spark):
    """More equal rows than an Arrow batch holds: later batches have no set of their own to sign."""
    rows = [(i, "the same few words") for i in range(2 * ROWS_PER_BATCH + 9)]
    got = rows_of(jaccard.classes(docs_frame(spark, rows, 1)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((i, 2, 0) for i, _ in rows), key=repr)


@pytest.mark.parametrize("one_task", [0, 1 << 19])
def test_components_of_chains_and_stars(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(41, 100)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.skipif(not HAVE_DATA, reason="driver tables not present")
def test_driver_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(jaccard.classes(docs), "doc_id", "n_shingles", "component_id") == brute(rows)
