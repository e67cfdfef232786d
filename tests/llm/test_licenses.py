import pytest

from quayline.llm import licenses
from tests.llm.data import HAVE_DATA, SF, awkward_rows, docs_frame, duck, oracle_rows, rows_of

COLUMNS = ("doc_id", "unit", "license", "template", "dice")
EXTRA = [
    (30, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
         "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
         "copy, modify, merge, publish, distribute, sublicense, and sell copies of the Software, and to permit persons to "
         "whom the Software is furnished to do so, subject to the following conditions:"),
    (31, "first line\nLICENSED UNDER THE -- APACHE LICENSE; version 2.0\nlast"), (32, "under the"), (33, "This work is licensed"),
    (34, "Licensed under CC BY 4.0. Licensed under CC BY 4.0."),
]


def test_matches_sql_on_awkward_rows(spark):
    docs = docs_frame(spark, awkward_rows() + EXTRA)
    con = duck(documents=docs.select("doc_id", "text"))
    got = rows_of(licenses.scan(docs), *COLUMNS)
    assert got == oracle_rows(con, licenses.oracle_sql(), *COLUMNS)
    found = {(i, u, name) for i, u, name, *_ in got}
    assert {(14, 0, "MIT"), (14, 1, "MIT"), (15, 3, "CC-BY-NC-4.0"), (30, 0, "MIT"), (31, 2, "Apache-2.0")} <= found
    assert not {i for i, *_ in got} & {1, 2, 3, 4, 8, 32}


def test_bounds_prune_no_match(spark):
    rows = [(i, " ".join("abcdefghij"[:n]) ) for i, n in enumerate(range(1, 11))]
    templates = (("T", "a b c d e"), ("U", "a b c d e f g h"))
    got = rows_of(licenses.scan(docs_frame(spark, rows), 0.7, templates), "doc_id", "unit", "license", "dice")
    want = []
    for i, t in rows:
        w = t.split()
        a = set(zip(w, w[1:]))
        for name, notice in templates:
            n = notice.split()
            b = set(zip(n, n[1:]))
            if a and (d := 2.0 * len(a & b) / (len(a) + len(b))) >= 0.7:
                want += [(i, 0, name, d), (i, 1, name, d)]
    assert got == sorted(want, key=repr)


def test_empty_table_and_native_plan(spark):
    docs = docs_frame(spark, awkward_rows())
    assert licenses.scan(docs.limit(0)).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


@pytest.mark.skipif(not HAVE_DATA, reason="driver tables not present")
def test_matches_sql(spark):
    got = licenses.scan(spark.read.parquet(f"{SF}/documents.parquet"))
    con = duck(documents=f"{SF}/documents.parquet")
    assert rows_of(got, *COLUMNS) == oracle_rows(con, licenses.oracle_sql(), *COLUMNS)
