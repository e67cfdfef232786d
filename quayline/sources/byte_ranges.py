"""Files of any size as byte ranges: CSV lines with their state, and zip members.

Spark's text reader cuts a file into byte ranges at a separator byte and hands out
every byte in between, valid text or not. Two readers build on it:

* ``plain_lines``: the lines of CSV files. Whether a line begins inside a quoted field
  depends on all bytes before it, so a range is scanned for both start states at once:
  for either one, the state before and after each line and the number of records that
  end before it. ``range_starts`` then runs through the ranges of a file (one row
  each) and says in which state a range really begins and how many records lie before.
* ``zip_lines``: the lines of the members of zip archives. The ranges of an archive are
  packed into pieces of bounded size with their offsets; the end of the archive gives
  its directory, the directory the pieces of each member, and each member is inflated
  by one task as a stream, so neither an archive nor a member is ever held as a whole.

Both give the same rows (``LINE_SCHEMA``), which are written once: what follows reads
the written lines, so ranges are cut only once, however the cluster changes meanwhile.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.shipping import ship_package

LINE_SCHEMA = ("path string, entry string, range_start long, line_no long, line binary, ended_0 long, ended_1 long, "
               "before_0 boolean, before_1 boolean, after_0 boolean, after_1 boolean")
PIECE_BYTES = 1 << 18
BATCH_LINES, BATCH_BYTES = 20_000, 4 << 20
MEMBER_TASKS = 4096  # tasks that inflate at most; members beyond go to them in turn
TAIL_BYTES = (1 << 16) + 22 + 20 + 56  # longest archive comment, end record, zip64 locator and end record
BOM = b"\xef\xbb\xbf"


class DamagedArchiveError(ValueError):
    pass


# ----------------------------------------------------------------- the state of a CSV line
def inside_after(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that began inside one, or at a field's start.

    A quote opens a field only where the field starts; elsewhere it is a character.
    """
    at, n = 0, len(line)
    while True:
        if not inside:
            while at < n and line[at] != 0x22:  # not a quote: on to the next field
                comma = line.find(b",", at)
                if comma < 0:
                    return False
                at = comma + 1
            if at >= n:
                return False
            at += 1
        quote = line.find(b'"', at)
        while quote >= 0 and line[quote + 1 : quote + 2] == b'"':
            quote = line.find(b'"', quote + 2)
        if quote < 0:
            return True
        comma = line.find(b",", quote)
        if comma < 0:
            return False
        at, inside = comma + 1, False


class LineScanner:
    """States and record counts of the lines of one range, in order, for both start states."""

    def __init__(self):
        self.state = [False, True]
        self.ended = [0, 0]
        self.lines = 0

    def scan(self, lines: list[bytes]) -> list[np.ndarray]:
        """Line numbers; then for each start state the records ended before, the state before and after."""
        n = len(lines)
        quoted = [i for i, line in enumerate(lines) if b'"' in line]
        out = [np.arange(self.lines, self.lines + n)]
        ended, before, after = [], [], []
        for s in (0, 1):
            state = np.empty(n + 1, bool)
            at = 0
            for i in quoted:
                state[at : i + 1] = self.state[s]
                self.state[s] = inside_after(lines[i], self.state[s])
                at = i + 1
            state[at:] = self.state[s]
            ends = np.cumsum(~state[1:])
            ended.append(self.ended[s] + np.concatenate(([0], ends[:-1])) if n else ends)
            self.ended[s] += int(ends[-1]) if n else 0
            before.append(state[:-1])
            after.append(state[1:])
        self.lines += n
        return out + ended + before + after


def _batch(path: str, entry: str | None, start: int, lines: list[bytes], scanner: LineScanner):
    import pyarrow as pa

    if start == 0 and scanner.lines == 0 and lines and lines[0].startswith(BOM):
        lines = [lines[0][len(BOM) :], *lines[1:]]
    n = len(lines)
    no, *states = scanner.scan(lines)
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * n, pa.string()), pa.array([entry] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(no, pa.int64()),
         pa.array(lines, pa.binary()), *(pa.array(x, pa.int64()) for x in states[:2]), *(pa.array(x) for x in states[2:])],
        names=[c.split()[0] for c in LINE_SCHEMA.split(", ")])


# ----------------------------------------------------------------- plain files
def _raw(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The bytes between line feeds: (path, range_start, value), in file order within a range."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range_start"),
        F.col("value").cast("binary").alias("value"))


def _runs(batch):
    """The rows of a batch as (path, range start, values), cut where either changes."""
    paths, starts = batch.column("path").to_pylist(), batch.column("range_start").to_pylist()
    values, at = batch.column("value").to_pylist(), 0
    for i in range(1, len(values) + 1):
        if i == len(values) or starts[i] != starts[at] or paths[i] != paths[at]:
            yield paths[at], starts[at], values[at:i]
            at = i


def plain_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of CSV files, ranges of one file in as many tasks as Spark cuts it into."""
    def scan(batches):
        key, scanner = None, None
        for batch in batches:
            for path, start, lines in _runs(batch):
                if (path, start) != key:
                    key, scanner = (path, start), LineScanner()
                yield _batch(path, None, start, lines, scanner)

    ship_package(spark)
    return _raw(spark, paths).mapInArrow(scan, LINE_SCHEMA)


def range_starts(lines: DataFrame) -> DataFrame:
    """(path, entry, range_start, inside, records_before) of every range, from what its lines say of it.

    A range changes the state in one of four ways (keep, swap, set, clear); a file's
    ranges, one row each, are run through in order.
    """
    last = F.max_by(F.struct("after_0", "after_1"), "line_no")
    ranges = lines.groupBy("path", F.coalesce("entry", F.lit("")).alias("entry"), "range_start").agg(
        F.sum((~F.col("after_0")).cast("long")).alias("records_0"), F.sum((~F.col("after_1")).cast("long")).alias("records_1"),
        last["after_0"].alias("end_0"), last["after_1"].alias("end_1"))

    def run(of_file: pd.DataFrame) -> pd.DataFrame:
        of_file = of_file.sort_values("range_start")
        inside, records, states, counts = False, 0, [], []
        for r in of_file.itertuples():
            states.append(inside)
            counts.append(records)
            records += int(r.records_1 if inside else r.records_0)
            inside = bool(r.end_1 if inside else r.end_0)
        return of_file[["path", "entry", "range_start"]].assign(inside=states, records_before=counts)

    return ranges.groupBy("path", "entry").applyInPandas(
        run, "path string, entry string, range_start long, inside boolean, records_before long")


# ----------------------------------------------------------------- zip archives
def archive_pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, range_start, piece, skip, data): the bytes of files in pieces of bounded size.

    ``skip`` is the place of a piece in its range; see ``with_offsets``.
    """
    import pyarrow as pa

    def pack(batches):
        key, held, size, skip, piece = None, [], 0, 0, 0

        def flush():
            nonlocal held, size, skip, piece
            data = b"\n".join(held) + b"\n"
            out = pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([piece], pa.int64()), pa.array([skip], pa.int64()),
                 pa.array([data], pa.binary())], names=["path", "range_start", "piece", "skip", "data"])
            held, size, skip, piece = [], 0, skip + len(data), piece + 1
            return out

        for batch in batches:
            for path, start, values in _runs(batch):
                if (path, start) != key:
                    if held:
                        yield flush()
                    key, skip, piece = (path, start), 0, 0
                for value in values:
                    held.append(value)
                    size += len(value) + 1
                    if size >= PIECE_BYTES:
                        yield flush()
        if held:
            yield flush()

    return _raw(spark, paths).mapInArrow(pack, "path string, range_start long, piece long, skip long, data binary")


def with_offsets(pieces: DataFrame) -> DataFrame:
    """(path, offset, data): a range begins where the bytes of the ranges before it end."""
    from pyspark.sql import Window

    size = F.octet_length("data").cast("long")
    ranges = pieces.groupBy("path", "range_start").agg(F.sum(size).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("range_start")) - F.col("n")
    ranges = ranges.select("path", "range_start", before.alias("before"))
    return pieces.join(ranges, ["path", "range_start"]).select(
        "path", (F.col("before") + F.col("skip")).cast("long").alias("offset"), "data")


def directory_place(path: str, tail: bytes, tail_at: int) -> tuple[int, int]:
    """(offset, size) of an archive's central directory, from its last bytes."""
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise DamagedArchiveError(f"no end of a zip archive in {path}")
    size, offset = struct.unpack_from("<LL", tail, end + 12)
    if size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        locator = tail.rfind(b"PK\x06\x07", 0, end)
        place = struct.unpack_from("<Q", tail, locator + 8)[0] - tail_at if locator >= 0 else -1
        if place < 0 or tail[place : place + 4] != b"PK\x06\x06":
            raise DamagedArchiveError(f"no zip64 end record in the tail of {path}")
        size, offset = struct.unpack_from("<QQ", tail, place + 40)
    return offset, size


def directory_entries(directory: bytes):
    """(name, method, compressed size, offset of the local header) of every member."""
    at = 0
    while directory[at : at + 4] == b"PK\x01\x02":
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<LLHHH", directory, at + 20)
        offset = struct.unpack_from("<L", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, end = at + 46 + n_name, at + 46 + n_name + n_extra
        while extra + 4 <= end:  # zip64: only the fields that did not fit, in this order
            kind, n = struct.unpack_from("<HH", directory, extra)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", directory, extra + 4))
                if full == 0xFFFFFFFF and wide:
                    full = wide.pop(0)
                if packed == 0xFFFFFFFF and wide:
                    packed = wide.pop(0)
                if offset == 0xFFFFFFFF and wide:
                    offset = wide.pop(0)
            extra += 4 + n
        if flags & 1:
            raise DamagedArchiveError(f"member {name} is encrypted")
        yield name, method, packed, offset
        at = end + n_note


def _joined(chunk: pd.DataFrame) -> tuple[int, bytes]:
    chunk = chunk.sort_values("offset")
    return int(chunk["offset"].iloc[0]), b"".join(bytes(x) for x in chunk["data"])


def archive_directory(pieces: DataFrame) -> DataFrame:
    """(path, entry, method, packed, header_at, nth) of every ``.txt`` member of the archives.

    ``pieces`` are written (path, offset, data). Only the tail of an archive is read
    for the place of its directory, and only the directory for its entries.
    """
    size = pieces.groupBy("path").agg(F.max(F.col("offset") + F.octet_length("data")).alias("n"))
    # the last piece may carry one byte that the file does not have (its last line feed)
    tails = pieces.join(size, "path").filter(F.col("offset") + F.octet_length("data") >= F.col("n") - TAIL_BYTES - 1)

    def place(tail: pd.DataFrame) -> pd.DataFrame:
        at, data = _joined(tail)
        path = tail["path"].iloc[0]
        offset, size = directory_place(path, data, at)
        return pd.DataFrame({"path": [path], "from": [offset], "to": [offset + size]})

    places = tails.select("path", "offset", "data").groupBy("path").applyInPandas(place, "path string, `from` long, `to` long")
    overlap = (F.col("offset") < F.col("to")) & (F.col("offset") + F.octet_length("data") > F.col("from"))
    parts = pieces.join(places, "path").filter(overlap)

    def entries(chunk: pd.DataFrame) -> pd.DataFrame:
        at, data = _joined(chunk)
        path, begin = chunk["path"].iloc[0], int(chunk["from"].iloc[0])
        rows = [(path, *e) for e in directory_entries(data[begin - at :]) if e[0].lower().endswith(".txt")]
        return pd.DataFrame(rows, columns=["path", "entry", "method", "packed", "header_at"]).assign(nth=range(len(rows)))

    return parts.groupBy("path").applyInPandas(
        entries, "path string, entry string, method int, packed long, header_at long, nth int")


class MemberReader:
    """Inflates one member from the pieces that hold it, fed in order."""

    def __init__(self, entry: str, method: int, packed: int, header_at: int):
        if method not in (0, 8):
            raise DamagedArchiveError(f"member {entry} is compressed by method {method}")
        self.entry, self.at, self.left = entry, header_at, packed
        self.head, self.inflate = b"", zlib.decompressobj(-15) if method == 8 else None

    def feed(self, offset: int, data: bytes):
        """Yield what the piece at ``offset`` holds of the member, inflated, in parts of bounded size."""
        data = data[max(0, self.at - offset) :]
        self.at = max(self.at, offset) + len(data)
        if self.head is not None:  # still in the local header
            self.head += data
            if len(self.head) < 30:
                return
            n_name, n_extra = struct.unpack_from("<HH", self.head, 26)
            if len(self.head) < 30 + n_name + n_extra:
                return
            if self.head[:4] != b"PK\x03\x04":
                raise DamagedArchiveError(f"member {self.entry} does not begin where the directory says")
            data, self.head = self.head[30 + n_name + n_extra :], None
        data = data[: self.left]
        self.left -= len(data)
        if self.inflate is None:
            yield data
            return
        while data:
            yield self.inflate.decompress(data, BATCH_BYTES)
            data = self.inflate.unconsumed_tail


def zip_lines(spark: SparkSession, paths: list[str], stage_dir: str) -> DataFrame:
    """The lines of the ``.txt`` members of zip archives, one member after the other in each task."""
    ship_package(spark)
    archive_pieces(spark, paths).write.mode("overwrite").parquet(f"{stage_dir}/_ranges")
    with_offsets(spark.read.parquet(f"{stage_dir}/_ranges")).write.mode("overwrite").parquet(f"{stage_dir}/_pieces")
    pieces = spark.read.parquet(f"{stage_dir}/_pieces")
    archive_directory(pieces).write.mode("overwrite").parquet(f"{stage_dir}/_members")
    members = spark.read.parquet(f"{stage_dir}/_members")

    most = F.col("header_at") + 30 + 2 * 65535 + F.col("packed")  # a local header names at most so much
    of_member = pieces.join(members, "path").filter(
        (F.col("offset") < most) & (F.col("offset") + F.octet_length("data") > F.col("header_at")))
    # members of one archive go to tasks in turn, archives begin at any task
    n = max(1, min(MEMBER_TASKS, members.count()))
    dealt = of_member.repartitionById(n, F.pmod(F.pmod(F.xxhash64("path"), F.lit(n)) + F.col("nth"), F.lit(n)).cast("int"))
    dealt = dealt.sortWithinPartitions("path", "header_at", "offset")

    def inflate(batches):
        key, reader, scanner, rest = None, None, None, b""

        def finish():
            if reader is not None and (reader.left or reader.head is not None):
                raise DamagedArchiveError(f"{key[0]}: member {reader.entry} is cut off")
            if rest:
                yield _batch(key[0], reader.entry, 0, [rest], scanner)

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("path", "entry", "method", "packed", "header_at", "offset")]
            for path, entry, method, packed, header_at, offset, data in zip(*cols, batch.column("data")):
                if (path, header_at) != key:
                    yield from finish()
                    key, scanner, rest = (path, header_at), LineScanner(), b""
                    reader = MemberReader(entry, method, packed, header_at)
                for part in reader.feed(offset, data.as_py()):
                    lines = (rest + part).split(b"\n")
                    rest = lines.pop()
                    for i in range(0, len(lines), BATCH_LINES):
                        yield _batch(path, entry, 0, lines[i : i + BATCH_LINES], scanner)
        yield from finish()

    return dealt.mapInArrow(inflate, LINE_SCHEMA)
