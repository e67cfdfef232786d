import random

import numpy as np
import pytest

from quayline.llm import decontamination as d
from tests.llm.data import awkward_rows, docs_frame, rows_of

BENCH = "item_id long, text string, doc_id string, score int"


def bench(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], BENCH)


def made_words(rng, n):
    return ["".join(rng.choice("abcdefghklmnoprstuvz") for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def brute(a, b):
    h = np.zeros((len(b) + 1, len(a) + 1), int)
    for i in range(1, len(b) + 1):
        for j in range(1, len(a) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[j - 1] == b[i - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_is_smith_waterman():
    rng = random.Random(1)
    for _ in range(300):
        a = np.array([rng.randrange(5) for _ in range(rng.randrange(30))], np.uint64)
        b = np.array([rng.randrange(5) for _ in range(rng.randrange(12))], np.uint64)
        score, start, end = d.alignment(a, b)
        assert score == brute(a, b)
        if score:
            assert brute(a[start:end], b) == score


def test_finds_copies_and_leaves_clean_documents(spark):
    rng = random.Random(7)
    common = made_words(rng, 12)
    items = [(i, " ".join(made_words(rng, rng.randrange(12, 40)))) for i in range(12)]
    rows, want = [], set()
    for k in range(60):
        filler = [rng.choice(common) for _ in range(80)]
        kind, (item, text) = k % 6, items[k % 12]
        w = text.split()
        if kind == 0:
            passage = w
        elif kind == 1:  # changed case and punctuation
            passage = [x.upper() + "," for x in w]
        elif kind == 2:  # one word in eight replaced
            passage = [x if i % 8 != 3 else rng.choice(common) for i, x in enumerate(w)]
        elif kind == 3:  # words left out and put in
            passage = [y for i, x in enumerate(w) for y in ([x, "extra"] if i % 9 == 4 else [] if i % 11 == 6 else [x])]
        elif kind == 4:  # a short quotation is no leak
            passage = w[2:6]
        else:
            passage = []
        if kind < 4:
            want.add((100 + k, item))
        rows.append((100 + k, " ".join(filler[:40] + passage + filler[40:])))
    docs = docs_frame(spark, rows)
    got = d.matches(docs, bench(spark, items))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    words = {i: t.split() for i, t in items}
    texts = {i: t.lower().replace(",", "").split() for i, t in rows}
    for r in got.collect():
        share = brute(texts[r.doc_id], words[r.item_id]) / (2 * len(words[r.item_id]))
        assert abs(share - r.score) < 1e-9
    kept = d.clean_documents(docs, bench(spark, items))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_passage_in_most_documents_is_found_in_each(spark):
    rng = random.Random(3)
    item = " ".join(made_words(rng, 30))
    rows = [(i, " ".join(made_words(rng, 20)) + " " + item) for i in range(60)] + [(99, "clean words only")]
    got = d.matches(docs_frame(spark, rows), bench(spark, [(1, item)]))
    assert {r.doc_id for r in got.collect()} == set(range(60))


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(d, "item_blocks", lambda b, n=200, f=d.item_blocks: f(b, n))
    rng = random.Random(5)
    items = [(i, " ".join(made_words(rng, 15))) for i in range(10)]
    rows = [(i, "before " + t + " after") for i, t in items]
    got = d.matches(docs_frame(spark, rows), bench(spark, items))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i) for i in range(10)}


def test_awkward_rows(spark):
    docs = docs_frame(spark, awkward_rows())
    items = [(1, "one two three"), (2, None), (3, ""), (None, "no id here at all"), (4, "One, two"), (4, "same text here same text"),
             (5, "no id here at all"), (6, "one two three"), (6, "one two three")]
    got = rows_of(d.matches(docs, bench(spark, items)), "doc_id", "item_id", "score")
    found = {(i, k) for i, k, _ in got}
    assert {(6, 1), (7, 1), (6, 6), (5, 4), (11, 4), (12, 4), (None, 5)} <= found
    assert sum(1 for r in got if r[:2] == (12, 4)) == 2  # repeated rows are reported each
    assert not {i for i, _ in found} & {1, 2, 3, 8, 13}
    assert d.matches(docs.limit(0), bench(spark, items)).count() == 0
    assert d.matches(docs, bench(spark, items).limit(0)).count() == 0
    assert d.clean_documents(docs, bench(spark, [])).count() == docs.count()


@pytest.mark.parametrize("every,copies", [(4, 0), (5, 0), (6, 0), (4, 40), (6, 40)])
def test_edited_copies_in_many_documents(spark, every, copies):
    rng = random.Random(every)
    item = made_words(rng, 30)
    edited = " ".join(made_words(rng, 1)[0] + "x" if i % every == every - 1 else x for i, x in enumerate(item))
    rows = [(i, " ".join(made_words(rng, 20)) + " " + edited) for i in range(20)]
    rows += [(100 + i, " ".join(made_words(rng, 20)) + " " + " ".join(item)) for i in range(copies)]
    for i in range(20):  # each with words of its own
        w = [made_words(rng, 1)[0] + "y" if (j + i) % every == 0 else x for j, x in enumerate(item)]
        rows.append((200 + i, " ".join(w)))
    docs = docs_frame(spark, rows + [(999, " ".join(made_words(rng, 50)))])
    got = d.matches(docs, bench(spark, [(1, " ".join(item)), (2, " ".join(made_words(rng, 30)))]))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, 1) for i, _ in rows}


def test_bounds_lose_no_alignment():
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 14)))) for i in range(40)]
    items = d.Items(rows)
    for _ in range(150):
        text = " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 90))).encode()
        h = d.word_hashes(d.words(text))
        best = lambda least: {
            (k, s) for k, a, b, _ in d.passages(h, items, least)
            if (s := d.alignment(h[a:b], items.words[k])[0] / (2 * len(items.words[k]))) >= 0.6}
        assert best(0.6) == best(0.0)


def test_rows_go_by_their_own_text(spark):
    rng = random.Random(8)
    item = " ".join(made_words(rng, 20))
    rows = [(None, f"before {item} after"), (None, "clean words of a row without id"), (5, item), (5, "clean words beside a leak"),
            (5, None), (6, "other clean words"), (None, None), (7, item), (7, item)]
    kept = d.clean_documents(docs_frame(spark, rows), bench(spark, [(1, item)]))
    assert rows_of(kept, "doc_id", "text") == sorted((r for r in rows if not r[1] or item not in r[1]), key=repr)
