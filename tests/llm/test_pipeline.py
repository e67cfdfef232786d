import subprocess
import sys

import numpy as np
import pytest

import corpus_pipeline
from quayline.llm import decontamination, mixing, queries, token_codes, toxicity
from quayline.llm.common import table, written
from tests.llm.data import HAVE_DATA, SF
from tests.llm.test_decontamination import brute as smith_waterman
from tests.llm.test_jaccard import brute as jaccard_classes
from tests.llm.test_tokens import brute as token_rows

pytestmark = pytest.mark.skipif(not HAVE_DATA, reason="driver tables not present")


def test_every_operator_has_its_query():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {*queries.QUERIES, "pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


def test_entry_works_without_the_operators():
    code = ("import sys; sys.modules['quayline.llm'] = None; import __spark_entry__ as e; "
            "assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); assert e.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])


def key(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)


def test_stages_match_brute_force(spark):
    docs = written(table(spark, SF, "documents"), "test")
    before = docs.collect()
    columns = docs.columns

    docs = written(corpus_pipeline.STAGES[0][1](spark, docs, SF), "test")
    assert docs.columns == columns
    scores = {r.doc_id: r.score for r in toxicity.scored(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert key(docs.collect()) == key([r for r in before if scores[r.doc_id] < toxicity.REJECT])

    before = docs.collect()
    docs = written(corpus_pipeline.STAGES[1][1](spark, docs, SF), "test")
    assert docs.columns == columns
    classes = jaccard_classes([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in docs.collect()) == sorted({c for _, _, c in classes})

    before = docs.collect()
    docs = written(corpus_pipeline.STAGES[2][1](spark, docs, SF), "test")
    assert docs.columns == columns
    gone = {r.doc_id for r in before} - {r.doc_id for r in docs.collect()}
    items = [decontamination.words(r.text.encode()) for r in table(spark, SF, "benchmark").collect()]
    grams = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in items]
    for r in before:
        w = decontamination.words(r.text.encode())
        have = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        near = [item for item, g in zip(items, grams) if len(have & g) >= 3]
        share = max((smith_waterman(w, item) / (2 * len(item)) for item in near), default=0)
        assert (r.doc_id in gone) == (share >= decontamination.LEAST_SCORE), (r.doc_id, share)

    before = docs
    docs = written(corpus_pipeline.STAGES[3][1](spark, docs, SF), "test")
    assert docs.columns == columns
    want = {r.doc_id: r.taken // r["size"] for r in mixing.mix(before).collect() if r.taken}
    got = [r.doc_id for r in docs.collect()]
    assert {i: got.count(i) for i in set(got)} == want

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert sorted(map(tuple, out.collect()), key=repr) == token_rows(token_codes.Encoder(token_codes.TOKENIZER), rows)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)
    assert np.array_equal(out.columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def test_empty_corpus(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test")
        assert docs.count() == 0
