"""Read a schedule feed (zip archives or extracted ``*.txt`` members).

* S01 every member is read verbatim as text, one record per CSV record;
* S02 columns are found by header name, absent optional columns are NULL,
  unknown columns are reported;
* S03 records with too many / too few fields are kept best-effort and counted;
* S04 ``src_line_no`` numbers a member's records (header = 1, data from 2). Where
  a member comes from several files, files count in the order of their names and
  each has a number range of its own, so a line number names one record;
* S05 a UTF-8 byte-order mark on the header is stripped; records with bytes that
  are not UTF-8 are kept with U+FFFD and counted as damaged;
* S06 every feed must have the required members, extra members are reported, an
  absent optional member yields zero rows (a member may also be a Spark-written
  ``<member>.txt/`` directory of CSV parts, each part with its own header);
* S07 staged row counts per member.

A file is read in byte ranges by as many tasks as Spark cuts it into, and the members
of a zip archive by a task each (``byte_ranges``). The lines are written once; records,
their numbers and fields are DataFrame expressions over them. Records, not physical
lines, are numbered, so a quoted newline inside a field does not shift later numbers;
only the few records that span lines are put together by a shuffle. Records end at a
line feed, with or without a carriage return before it.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayline.schemas import MEMBER_COLUMNS, REQUIRED_MEMBERS
from quayline.session import settings
from quayline.sources import byte_ranges
from quayline.storage import checkpoint_root, list_files

MEMBER_WRITERS = 16  # files that a task keeps open; more members are sorted
FILE_LINES = 1 << 40  # the range of line numbers of one member file


class MissingMemberError(ValueError):
    pass


def _member_of(path: Column, entry: Column) -> dict[str, Column]:
    """Feed, archive and member of a file (``<member>.txt`` or ``<member>.txt/part``) or of an archive's entry."""
    parts = F.split(path, "/")
    name, folder = F.element_at(parts, -1), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    in_folder = F.lower(folder).endswith(".txt")
    above = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "/")
    stem = lambda x: F.regexp_replace(x, r"\.[^.]*$", "")
    return {
        "feed": F.when(entry.isNotNull(), path).when(in_folder, above).otherwise(folder),
        "archive": path,
        "member": F.when(entry.isNotNull(), stem(F.element_at(F.split(entry, "/"), -1)))
        .when(in_folder, stem(F.element_at(parts, -2))).otherwise(stem(name)),
    }


def stage_lines(spark: SparkSession, path: str, stage_dir: str, ranges: int | None = None) -> None:
    """Write the lines of all members under ``<stage_dir>/lines``, by member, and where each byte range begins.

    ``ranges`` asks for about so many ranges in all; otherwise Spark's file settings decide.
    """
    files = [(p, n) for p, n, _ in list_files(spark, path)]
    zips = [p for p, _ in files if p.lower().endswith(".zip")]
    plain = [p for p, _ in files if p.lower().endswith(".txt") or (".txt/" in p.lower() and p.lower().endswith(".csv"))]
    # a task has lines of few members: a writer for each, so the lines are not sorted by member first
    values = {"spark.sql.maxConcurrentOutputFileWriters": MEMBER_WRITERS}
    if ranges:
        values["spark.sql.files.maxPartitionBytes"] = max(1, -(-sum(n for _, n in files) // ranges))
    with settings(spark, values):
        parts = [byte_ranges.plain_lines(spark, plain)] if plain else []
        if zips:
            parts.append(byte_ranges.zip_lines(spark, zips, stage_dir))
        if not parts:
            parts = [spark.createDataFrame([], byte_ranges.LINE_SCHEMA)]
        lines = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        named = lines.withColumns(_member_of(F.col("path"), F.col("entry")))
        named.write.mode("overwrite").partitionBy("member").parquet(f"{stage_dir}/lines")
    byte_ranges.range_starts(_lines(spark, stage_dir)).write.mode("overwrite").parquet(f"{stage_dir}/starts")
    # one header per file: the scan stays spread, only the headers meet in one file
    first = staged_records(spark, stage_dir, first_only=True).repartition(1)
    first.write.mode("overwrite").parquet(f"{stage_dir}/headers")


def _lines(spark: SparkSession, stage_dir: str) -> DataFrame:
    schema = f"{byte_ranges.LINE_SCHEMA}, feed string, archive string, member string"
    return spark.read.schema(schema).parquet(f"{stage_dir}/lines")


# a field with its quotes, and its parts: what stands between the quotes, what follows them
QUOTED_FIELD = r'("[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+),'
FIELD_PARTS = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$'


def record_fields(text: Column) -> Column:
    """The fields of a CSV record; a record without quotes is only split."""
    part = lambda x, i: F.regexp_extract(x, FIELD_PARTS, i)
    quoted = F.transform(
        F.regexp_extract_all(F.concat(text, F.lit(",")), F.lit(QUOTED_FIELD), F.lit(1)),
        lambda x: F.when(x.startswith('"'), F.concat(F.replace(part(x, 1), F.lit('""'), F.lit('"')), part(x, 2))).otherwise(x))
    none = F.array().cast("array<string>")
    return F.when(text == "", none).when(F.contains(text, F.lit('"')), quoted).otherwise(F.split(text, ","))


def records_of(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Every CSV record of the staged lines: (feed, archive, member, record_no, fields, damaged)."""
    starts = starts.select(F.col("path").alias("_path"), F.col("entry").alias("_entry"), F.col("range_start").alias("_start"),
                           "inside", "records_before")
    here = (F.col("path") == F.col("_path")) & (F.coalesce("entry", F.lit("")) == F.col("_entry")) & (
        F.col("range_start") == F.col("_start"))
    true = lambda name: F.when(F.col("inside"), F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))
    rows = lines.join(starts, here).select(
        "feed", "archive", "member", "entry", "range_start", "line_no", F.col("line").cast("string").alias("line"),
        (F.col("records_before") + true("ended") + 1).alias("record_no"), true("before").alias("begun"), true("after").alias("open"))
    key = ["feed", "archive", "member", "entry", "record_no"]
    whole = rows.filter(~F.col("begun") & ~F.col("open")).select(*key, "line")
    place = F.struct("range_start", "line_no")
    spread = rows.filter(F.col("begun") | F.col("open")).groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct(place.alias("place"), "line"))).alias("lines"), F.max_by("open", place).alias("open"))
    text = F.array_join("lines.line", "\n")
    spread = spread.select(*key, F.when(F.col("open"), F.concat(text, F.lit('"'))).otherwise(text).alias("line"))
    text = F.when(F.col("line").endswith("\r"), F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line"))
    return whole.unionByName(spread).withColumn("line", text).select(
        "feed", "archive", "member", "record_no", record_fields(F.make_valid_utf8("line")).alias("fields"),
        (~F.is_valid_utf8("line")).alias("damaged"))


def read_records(spark: SparkSession, path: str, stage_dir: str | None = None, ranges: int | None = None) -> DataFrame:
    """Every CSV record of every member; the lines are staged under ``stage_dir`` (a folder of its own by default)."""
    stage_dir = stage_dir or f"{checkpoint_root(spark)}/quayline-feed-lines/{uuid.uuid4().hex}"
    stage_lines(spark, path, stage_dir, ranges)
    return staged_records(spark, stage_dir)


def staged_headers(spark: SparkSession, stage_dir: str) -> DataFrame:
    """The first record of every file."""
    return spark.read.parquet(f"{stage_dir}/headers")


def staged_records(spark: SparkSession, stage_dir: str, first_only: bool = False) -> DataFrame:
    """The records of staged lines; ``first_only``: the headers, without reading the rest."""
    lines, starts = _lines(spark, stage_dir), spark.read.parquet(f"{stage_dir}/starts")
    if first_only:
        return records_of(lines.filter((F.col("ended_0") == 0) | (F.col("ended_1") == 0)), starts).filter("record_no = 1")
    return records_of(lines, starts)


def export_feed(members: dict[str, DataFrame], root: str) -> None:
    """Write staged members as a feed: ``<root>/<member>.txt/part-*.csv`` with headers.

    Each member keeps its declared column order. Values are written as they are:
    outer spaces stay, quotes are doubled, a backslash is a character like any
    other. NULL becomes an empty field, so reading the feed back stages the same
    rows but for NULLs, which come back as empty text.
    """
    for member, df in members.items():
        cols = [c for c in MEMBER_COLUMNS[member] if c in df.columns]
        (df.select(*cols).write.mode("overwrite").option("header", "true").option("emptyValue", "")
         .option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
         .csv(f"{root}/{member}.txt"))


def member_listing(records: DataFrame) -> DataFrame:
    """One row per member file: its header and the first line number of its range."""
    nth = F.row_number().over(Window.partitionBy("member").orderBy("archive")) - 1
    return records.filter(F.col("record_no") == 1).select(
        "feed", "archive", "member", F.transform("fields", lambda c: F.trim(c)).alias("header"),
        (nth.cast("long") * FILE_LINES).alias("line_offset"),
    )


def check_members(headers: DataFrame) -> dict[str, list[str]]:
    """Every feed has the required members (member names per feed are collected, never data)."""
    feeds = headers.groupBy("feed").agg(F.collect_set("member").alias("members")).collect()
    for r in feeds:
        missing = sorted(set(REQUIRED_MEMBERS) - set(r["members"]))
        if missing:
            raise MissingMemberError(f"required members missing in {r['feed']}: {missing}")
    if not feeds:
        raise MissingMemberError(f"required members missing: {sorted(REQUIRED_MEMBERS)}")
    present = set().union(*(r["members"] for r in feeds))
    return {"present": sorted(present), "extra": sorted(present - set(MEMBER_COLUMNS))}


def staged_member(records: DataFrame, headers: DataFrame, member: str) -> DataFrame:
    """Project one member onto its declared columns by header name."""
    h = headers.filter(F.col("member") == member).select("archive", "header", "line_offset")
    data = records.filter((F.col("member") == member) & (F.col("record_no") > 1))
    j = data.join(h, "archive")
    cols = []
    for c in MEMBER_COLUMNS[member]:
        pos = F.array_position(F.col("header"), F.lit(c)).cast("int")
        cols.append(F.when(pos > 0, F.try_element_at(F.col("fields"), pos)).cast("string").alias(c))
    return j.select(*cols, (F.col("record_no") + F.col("line_offset")).alias("src_line_no"),
                    (F.size("fields") != F.size("header")).alias("_shape_mismatch"),
                    (F.size("fields") - F.size("header")).alias("_surplus_fields"), F.col("damaged").alias("_damaged"))


def empty_member(spark: SparkSession, member: str) -> DataFrame:
    cols = ", ".join(f"`{c}` string" for c in MEMBER_COLUMNS[member])
    return spark.createDataFrame([], f"{cols}, src_line_no long")


def aligned_records(records: DataFrame, headers: DataFrame) -> DataFrame:
    """Every record of the declared members in one pass: member, src_line_no, its declared columns in
    order as ``values``, surplus_fields (negative: too few) and damaged."""
    declared = F.create_map(*[x for m, cs in MEMBER_COLUMNS.items() for x in (F.lit(m), F.array(*map(F.lit, cs)))])
    h = headers.select("archive", "member", "header", "line_offset").withColumn("places", F.transform(
        declared[F.col("member")], lambda c: F.array_position(F.col("header"), c).cast("int")))
    rows = records.filter((F.col("record_no") > 1) & F.col("member").isin(*MEMBER_COLUMNS)).join(h, ["archive", "member"])
    values = F.transform("places", lambda p: F.when(p > 0, F.try_element_at(F.col("fields"), p)))
    return rows.select("member", (F.col("record_no") + F.col("line_offset")).alias("src_line_no"), values.alias("values"),
                       (F.size("fields") - F.size("header")).alias("surplus_fields"), "damaged")


def member_report(aligned: DataFrame) -> DataFrame:
    """Rows, records with too many or too few fields and damaged records per member."""
    hits = lambda c: F.count(F.when(c, 1)).cast("long")
    return aligned.groupBy("member").agg(
        F.count(F.lit(1)).cast("long").alias("staged_rows"), hits(F.col("surplus_fields") != 0).alias("shape_mismatches"),
        hits(F.col("surplus_fields") > 0).alias("too_many_fields"), hits(F.col("surplus_fields") < 0).alias("too_few_fields"),
        hits(F.col("damaged")).alias("damaged_records"))


def _listed(report: DataFrame, present: list[str]) -> DataFrame:
    """The report with a row for every declared member that is present, also one without records."""
    spark = report.sparkSession
    names = spark.createDataFrame([(m,) for m in MEMBER_COLUMNS if m in present], "member string")
    counts = [c for c in report.columns if c != "member"]
    return names.join(report, "member", "left").select("member", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts])


def staged_members(spark: SparkSession, path: str, stage_dir: str | None = None, ranges: int | None = None
                   ) -> tuple[dict[str, DataFrame], DataFrame, dict]:
    """All members as staged text DataFrames, plus a per-member report.

    Files are read and archives expanded once: the lines are written under
    ``stage_dir`` as Parquet partitioned by member (each member then reads only its
    own partition, and a lost executor re-reads files instead of expanding again).
    Without ``stage_dir`` (small feeds, tests) the records are kept in memory too.
    """
    keep = stage_dir is None
    stage_dir = stage_dir or f"{checkpoint_root(spark)}/quayline-feed-lines/{uuid.uuid4().hex}"
    records = read_records(spark, path, stage_dir, ranges)
    if keep:
        records = records.persist(StorageLevel.MEMORY_AND_DISK)
    headers = member_listing(staged_headers(spark, stage_dir))
    listing = check_members(headers)
    out: dict[str, DataFrame] = {}
    for member in MEMBER_COLUMNS:
        if member not in listing["present"]:
            out[member] = empty_member(spark, member)
        else:
            out[member] = staged_member(records, headers, member).drop("_shape_mismatch", "_surplus_fields", "_damaged")
    report = _listed(member_report(aligned_records(records, headers)), listing["present"])
    unknown = headers.select("member", F.explode("header").alias("column")).filter(
        F.col("member").isin(*MEMBER_COLUMNS)
    )
    known = F.create_map(*[x for m, cs in MEMBER_COLUMNS.items() for x in (F.lit(m), F.array(*map(F.lit, cs)))])
    listing["unknown_columns"] = unknown.filter(~F.array_contains(known[F.col("member")], F.col("column")))
    return out, report, listing


def numbers_without_gaps(aligned: DataFrame) -> DataFrame:
    """Per member, whether the records of every file are numbered from 2 on without a gap."""
    place = F.col("src_line_no") % FILE_LINES
    # n numbers from 2 to n + 1 with the right sum of squares: no gap, none twice
    files = aligned.groupBy("member", F.floor(F.col("src_line_no") / FILE_LINES).alias("file")).agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"),
        F.sum((place * place).cast("decimal(38,0)")).alias("squares"))
    m = (F.col("n") + 1).cast("decimal(20,0)")
    squares = (m * (m + 1) * (2 * m + 1) / 6 - 1).cast("decimal(38,0)")
    right = (F.col("first") == 2) & (F.col("last") == F.col("n") + 1) & (F.col("squares") == squares)
    return files.groupBy("member").agg(F.min(right).alias("numbers_without_gaps"))


def _digest(values: Column) -> list[Column]:
    """How many rows and an order-free hash of their values (NULL as empty)."""
    h = F.xxhash64(F.transform(values, lambda v: F.coalesce(v, F.lit("")))).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")]


def content_digests(aligned: DataFrame) -> DataFrame:
    """(member, n, h) of records read from a feed."""
    return aligned.groupBy("member").agg(*_digest(F.col("values")))


def member_digests(members: dict[str, DataFrame]) -> DataFrame:
    """(member, n, h) of staged members; equal to ``content_digests`` of the same contents."""
    rows = [df.select(F.lit(m).alias("member"), F.array(*[
        F.col(c) if c in df.columns else F.lit(None).cast("string") for c in MEMBER_COLUMNS[m]]).alias("values"))
        for m, df in members.items()]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionAll(r)
    return both.groupBy("member").agg(*_digest(F.col("values")))
