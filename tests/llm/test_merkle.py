import hashlib
import zlib

import pytest

from quayline.llm import merkle
from tests.llm.data import HAVE_DATA, SF, awkward_rows, docs_frame, duck, oracle_rows, rows_of

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields):
    return H(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute(rows):
    """From the definition; rows are (doc_id, source, lang, n_chars, text)."""
    per = {}
    for r in rows:
        per.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    langs = sorted(per, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: climb([y[2] for y in sorted(per[x], key=lambda y: y[:3])]) for x in langs}
    top = climb([trees[x][-1][0] for x in langs]) if langs else []
    out = []
    for nth, lang in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(sorted(per[lang], key=lambda y: y[:3])):
            sides = []
            for levels, at in ((trees[lang], i), (top, nth)):
                for level in levels[:-1]:
                    sides.append((at % 2, level[at ^ 1] if at ^ 1 < len(level) else ""))
                    at //= 2
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            back = leaf_of(r[0], r[1], r[2], r[3] + 1, r[4]) if tampered else leaf
            for left, other in sides:
                back = H(other, back) if left else H(back, other)
            out.append((r[0], leaf, trees[lang][-1][0], top[-1][0], H(*(s for _, s in sides)), back, back == top[-1][0]))
    return sorted(out, key=repr)


def tables():
    plain = [(r[0], r[1], r[2] if len(r) > 2 else "s", ["en", "fr", None, "é", ""][i % 5] if i % 3 else "en")
             for i, r in enumerate(awkward_rows())]
    many = [(i, f"text {i}", None if i % 11 == 0 else "s", "hot" if i % 3 else f"l{i % 13}") for i in range(400)]
    nulls = [(None, f"t{i % 4}", "s", None) for i in range(37)]
    return [plain, many, nulls, [(5, "x")], [(5, "x"), (5, "x"), (5, "y")], []]


def fields(rows):
    return [(r[0], r[2] if len(r) > 2 else "s", r[3] if len(r) > 3 else "en", None if r[1] is None else len(r[1]), r[1]) for r in rows]


@pytest.mark.parametrize("bits", [2, 12])
@pytest.mark.parametrize("rows", tables())
def test_matches_brute_force(spark, rows, bits):
    # small superblocks make several floors of outer nodes
    assert rows_of(merkle.manifest(docs_frame(spark, rows), bits), *COLUMNS) == brute(fields(rows))


def test_sql_matches_brute_force(spark):
    for rows in tables()[:5]:
        con = duck(documents=docs_frame(spark, rows).select("doc_id", "source", "lang", "n_chars", "text"))
        assert oracle_rows(con, merkle.oracle_sql(), *COLUMNS) == brute(fields(rows))


def test_tampering_is_seen_and_nothing_else(spark):
    rows = tables()[1]
    got = merkle.manifest(docs_frame(spark, rows)).collect()
    assert {r.doc_id for r in got if not r.verified} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 0}


@pytest.mark.skipif(not HAVE_DATA, reason="driver tables absent")
def test_driver_table(spark):
    got = rows_of(merkle.manifest(spark.read.parquet(f"{SF}/documents.parquet")), *COLUMNS)
    assert got == oracle_rows(duck(documents=f"{SF}/documents.parquet"), merkle.oracle_sql(), *COLUMNS)
