"""Small tables for the operators' tests: every awkward row at once, and driver tables."""

import os

import duckdb
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
HAVE_DATA = os.path.isdir(SF) and os.path.isdir(SF2)

# extra columns carry names that operators use for their own columns
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
    T.StructField("size", T.IntegerType()), T.StructField("node", T.IntegerType()), T.StructField("place", T.IntegerType()),
    T.StructField("mark", T.IntegerType()), T.StructField("root", T.StringType()), T.StructField("key", T.StringType()),
])


def doc(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 1, 2, 3, 4, "r", "k")


def docs_frame(spark, rows, parts=3):
    return spark.createDataFrame([doc(*r) for r in rows], DOCS).repartition(parts)


def awkward_rows():
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma".split()
    long = " ".join(words[(i * i + i // 7) % len(words)] + str(i % 13) for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "one two three"), (7, "ONE two\tthree"),
        (8, long), (8, long), (9, long + " tail"), (10, "é日本 ☃ <|endoftext|>  x   y   z"), (None, "no id here at all"),
        (None, None), (11, "same text here " * 40, None), (12, "same text here " * 40, None), (12, "same text here " * 40, None),
        (13, "a" * 700), (14, "Released under the MIT License."), (15, "x\n\nLicensed under CC BY-NC 4.0.\ny"), (16, "\x00\x01 \r\n"),
    ]


def duck(**tables):
    con = duckdb.connect()
    for name, df in tables.items():
        frame = df.toPandas().convert_dtypes() if not isinstance(df, str) else None  # noqa: F841
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM " + ("frame" if frame is not None else f"'{df}'"))
    return con


def rows_of(df, *order):
    return sorted((tuple(r) for r in df.select(*order).collect()), key=repr)


def oracle_rows(con, sql, *order):
    cur = con.execute(sql)
    at = [[d[0] for d in cur.description].index(c) for c in order]
    return sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)
