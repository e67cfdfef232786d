import math

import pytest
from pyspark.sql import functions as F

from quayline.llm import mixing
from tests.llm.data import HAVE_DATA, SF, awkward_rows, docs_frame, duck, oracle_rows, rows_of

COLUMNS = ("doc_id", "size", "source_size", "target", "taken")


def rounded(rows):
    return [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows]


def many(n=600):
    rows = []
    for i in range(n):
        source = None if i % 19 == 0 else "hot" if i % 3 else f"s{i % 7}" if i % 2 else "é"
        rows.append((i, " ".join(["w"] * (1 + (i * 37) % 60 + (400 if i % 97 == 0 else 0))), source))
    return rows + [(900, "", "empty"), (901, None, "empty"), (5, "w w w", "hot"), (5, "w w w", "hot")]


def water_filled(sizes, weights, most=3):
    total, clamped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in clamped)
        share = sum(weights[s] for s in sizes if s not in clamped)
        goal = {s: most * sizes[s] if s in clamped else left * weights[s] / share for s in sizes}
        over = {s for s in sizes if s not in clamped and goal[s] > most * sizes[s]}
        if not over:
            return goal
        clamped |= over


def test_targets_are_those_of_repeated_clamping(spark):
    rows = many()
    got = mixing.mix(docs_frame(spark, rows)).collect()
    sizes, taken, of = {}, {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
        of[i] = s
    names = sorted(sizes, key=lambda s: (s is None, s))
    goal = water_filled(sizes, {s: 1 + k % 3 for k, s in enumerate(names)})
    longest = max(r["size"] for r in got)
    for r in got:
        s = of[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        assert math.isclose(r.target, goal[s], rel_tol=1e-9, abs_tol=1e-9)
        assert r.source_size == sizes[s] and 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    assert all(abs(taken[s] - goal[s]) <= longest for s in sizes)
    assert math.isclose(sum(goal.values()), sum(sizes.values()))


@pytest.mark.parametrize("rows", [many(), awkward_rows(), [(1, "a b"), (2, "c")], []])
def test_matches_sql(spark, rows):
    docs = docs_frame(spark, rows)
    con = duck(documents=docs.select("doc_id", "text", "source"))
    got = rounded(rows_of(mixing.mix(docs), *COLUMNS))
    if rows:
        assert got == rounded(oracle_rows(con, mixing.oracle_sql(), *COLUMNS))
    else:
        assert got == []


def test_reruns_agree_and_seeds_differ(spark):
    docs = docs_frame(spark, many())
    first = rows_of(mixing.mix(docs), *COLUMNS)
    assert first == rows_of(mixing.mix(docs.repartition(7)), *COLUMNS)
    assert first != rows_of(mixing.mix(docs, seed=18), *COLUMNS)


def test_documents_repeat_as_the_plan_says(spark):
    docs = docs_frame(spark, many())
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    counts = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    want = {}
    for r in mixing.mix(docs).collect():
        if r.taken:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.taken // r["size"]
    assert counts == want


@pytest.mark.skipif(not HAVE_DATA, reason="driver tables not present")
def test_driver_documents(spark):
    got = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"))
    con = duck(documents=f"{SF}/documents.parquet")
    assert rounded(rows_of(got, *COLUMNS)) == rounded(oracle_rows(con, mixing.oracle_sql(), *COLUMNS))


@pytest.mark.parametrize("shared_id", [None, 7])
def test_rows_without_an_id_of_their_own_still_meet_the_target(spark, shared_id):
    """A third of the ids null, or all the same: taken words lie within one document of each target."""
    rows = [(shared_id if i % 3 == 0 else i, f"t{i} " + "w " * (5 + i % 40), ["a", "b", None][i % 3 if i % 2 else 0]) for i in range(3000)]
    docs = docs_frame(spark, rows)
    got = mixing.mix(docs).groupBy("source_size", "target").agg(
        F.sum("taken").alias("taken"), F.max("size").alias("longest")).collect()
    assert len(got) == 3 and all(abs(r.taken - r.target) <= r.longest for r in got)
    con = duck(documents=docs.select("doc_id", "text", "source"))
    assert rounded(rows_of(mixing.mix(docs), *COLUMNS)) == rounded(oracle_rows(con, mixing.oracle_sql(), *COLUMNS))
