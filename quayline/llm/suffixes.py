"""Suffix-array dedup with a logarithmic family of indexes.

A suffix array here is sparse: of every ``LENGTH``-byte window of a text the suffix
that begins at the window's anchor is kept, the ``PREFIX``-byte stretch with the
least hash (the leftmost, if several). Equal windows have equal anchors, so any
match of LENGTH bytes meets in the array, at one suffix for about 80 bytes. An
entry is sorted by the hash of the suffix's first PREFIX bytes and carries the hash
of the whole stretch of windows that share the anchor, the document (its id and a
64-bit hash of its text, as ids may be null or repeat) and the place.

New batches get such an array and are merge-scanned against the levels there are:
levels are tables bucketed and sorted by the key, so the scan is a sort-merge join
without a shuffle, and it yields the keys that occur twice. Then levels of equal
size merge like the digits of a binary counter, again without a shuffle, so n
batches cost n log n.

Keys that occur twice are resolved exactly. Where a whole stretch occurs twice, all
its windows do. Stretches that share a key and differ (the ends of a copied
passage) are compared, one document per distinct stretch, by blocks of STEP windows
and, where blocks overlap in part, window by window. Windows
that occur twice make the runs of bytes to remove, judged on the input. Texts with
an exact copy leave whole. A text is read again only if it has something to
resolve, found by a Bloom filter of fixed size.

Hashes are two independent 64-bit ones for each comparison. Defined results: a null
text is empty; texts of fewer than LENGTH bytes lose nothing; rows that repeat an
id and text are copies of each other and leave whole; a null id is kept and treated
like any other; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.llm.common import as_bytes, bloom_filter, discard, mixed, prepare, row_id, signed, written

LENGTH = 200
PREFIX = 48
BATCHES = 4
STEP = 32
PIECE = 1 << 21  # bytes hashed together
_PLACE = (1 << 24) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, made once per worker."""
    size = max(PIECE * 2, 1 << int(n).bit_length())
    if size not in _POWERS:
        both = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS.clear()
        _POWERS[size] = tuple(both)
    return _POWERS[size]


class Hashes:
    """Hashes of any stretches of a byte array, by prefix sums modulo 2^64."""

    def __init__(self, raw: np.ndarray):
        self.up, self.down = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_CODES[raw] * self.up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows, from running minima within blocks of that width."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchored_runs(raw: np.ndarray, ends: np.ndarray, length: int, prefix: int):
    """Runs of windows that share an anchor: (text, first, last, anchor, key, span) as arrays.

    ``raw`` holds texts one after the other (text i ends at ends[i + 1]); windows
    do not cross texts. Places are in ``raw``.
    """
    empty = np.zeros(0, np.int64)
    if len(raw) < length:
        return (empty,) * 4 + (empty.astype(np.uint64),) * 2
    hashes = Hashes(raw)
    keys = hashes.all(prefix)
    places = np.arange(len(keys), dtype=np.uint64)
    least = sliding_minimum((keys & ~np.uint64(_PLACE)) | places, length - prefix + 1)
    anchor = (least & np.uint64(_PLACE)).astype(np.int64)
    inside = np.zeros(len(raw) + 1, np.int32)
    sizes = np.diff(ends)
    some = sizes >= length
    np.add.at(inside, ends[:-1][some], 1)
    np.add.at(inside, ends[1:][some] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[: len(anchor)]) > 0)
    if not len(window):
        return (empty,) * 4 + (empty.astype(np.uint64),) * 2
    anchor = anchor[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(new)
    first, last, anchor = window[at], window[np.append(at[1:], len(window)) - 1], anchor[at]
    span = mixed(hashes.of(first, last + length) + (((last - first) << 8) + (anchor - first)).astype(np.uint64))
    return np.searchsorted(ends, first, "right") - 1, first, last, anchor, keys[anchor], span


def _pieces(raw: np.ndarray, ends: np.ndarray, length: int):
    """Cut texts into pieces of bounded size: (bytes, ends, text numbers, places of the texts' starts)."""
    lo = 0
    while lo < len(ends) - 1:
        if ends[lo + 1] - ends[lo] > PIECE:  # a long text alone, in pieces that share length - 1 bytes
            for a in range(int(ends[lo]), int(ends[lo + 1]) - length + 1, PIECE):
                b = min(int(ends[lo + 1]), a + PIECE + length - 1)
                yield raw[a:b], np.array([0, b - a]), np.array([lo]), np.array([a - int(ends[lo])])
            lo += 1
            continue
        hi = int(np.searchsorted(ends, ends[lo] + PIECE, "right")) - 1
        hi = max(lo + 1, hi)
        over = np.flatnonzero(np.diff(ends[lo : hi + 1]) > PIECE)
        hi = lo + int(over[0]) if len(over) else hi
        yield raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo], np.arange(lo, hi), np.zeros(hi - lo, np.int64)
        lo = hi


def _entries(batches, length: int, prefix: int):
    """Per run of windows: key, span, doc_id, mark, and place | back | width in one number."""
    import pyarrow as pa

    seen: set[bytes] = set()
    for batch in batches:
        raw, ends = as_bytes(batch.column(2))
        doc_ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        digests = [hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(ends[:-1], ends[1:])]
        if len(seen) > 1 << 18:
            seen.clear()
        fresh = []  # later copies in this task add nothing: copies leave whole, and one stands for all
        for d in digests:
            fresh.append(d not in seen)
            seen.add(d)
        fresh = np.array(fresh, bool)
        for part, cuts, numbers, moved in _pieces(raw, ends, length):
            text, first, last, anchor, key, span = anchored_runs(part, cuts, length, prefix)
            keep = fresh[numbers[text]] if len(text) else np.zeros(0, bool)
            text, first, last, anchor, key, span = (x[keep] for x in (text, first, last, anchor, key, span))
            at = anchor - cuts[text] + moved[text]
            packed = (at << 16) | ((anchor - first) << 8) | (last - first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(key)), pa.array(signed(span)), pa.array(doc_ids[numbers[text]]), pa.array(marks[numbers[text]]),
                 pa.array(packed)],
                names=["key", "span", "doc", "mark", "packed"])


def identified(docs: DataFrame) -> DataFrame:
    """(doc, mark, text): a row's id and 64-bit hash of its text, which tell rows apart that share an id."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(row_id(F.col("doc_id")).alias("doc"), F.xxhash64(text).alias("mark"),
                       text.alias("text"))


class IndexFamily:
    """Levels of suffix arrays; the level of rank r holds 2^r batches."""

    def __init__(self, spark: SparkSession, length: int = LENGTH, prefix: int = PREFIX, buckets: int | None = None):
        prepare(spark)
        self.spark, self.length, self.prefix = spark, length, prefix
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, str] = {}
        self.repeated: list[str] = []
        self._name = f"quayline_suffixes_{uuid.uuid4().hex[:12]}"
        self._n = 0

    def _save(self, df: DataFrame, *order: str) -> str:
        self._n += 1
        name = f"{self._name}_{self._n}"
        df.write.bucketBy(self.buckets, "key").sortBy(*order).format("parquet").saveAsTable(name)
        return name

    def add(self, docs: DataFrame) -> None:
        """Index a batch, scan it against all levels, and merge levels of equal size."""
        length, prefix = self.length, self.prefix
        rows = identified(docs).mapInArrow(lambda it: _entries(it, length, prefix), "key long, span long, doc long, mark long, packed long")
        batch = self._save(rows.repartition(self.buckets, "key"), "key", "span")
        keys = self.spark.table(batch).select("key")
        twice = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
        for level in self.levels.values():
            twice = twice.unionAll(keys.join(self.spark.table(level).select("key"), "key", "left_semi"))
        self.repeated.append(self._save(twice.distinct(), "key"))
        rank, merging = 0, [batch]
        while rank in self.levels:
            merging.append(self.levels.pop(rank))
            rank += 1
        if rank:
            union = self.spark.table(merging[0])
            for name in merging[1:]:
                union = union.unionAll(self.spark.table(name))
            batch = self._save(union.distinct(), "key", "span")
            self._drop(merging)
        self.levels[rank] = batch

    def entries(self) -> DataFrame:
        """Entries of all levels whose key occurs twice."""
        every, twice = (None, None)
        for name in self.levels.values():
            every = self.spark.table(name) if every is None else every.unionAll(self.spark.table(name))
        for name in self.repeated:
            twice = self.spark.table(name) if twice is None else twice.unionAll(self.spark.table(name))
        return every.join(twice.distinct(), "key", "left_semi")

    def _drop(self, names) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Drop all tables of the family; closing it again does nothing."""
        self._drop([*self.levels.values(), *self.repeated])
        self.levels, self.repeated = {}, []


def _unpacked(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "at": F.shiftright("packed", 16), "back": F.shiftright("packed", 8) % 256, "width": F.col("packed") % 256})


def _stretches(text: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the stretches of ``size`` bytes that begin at ``start`` (ascending), piece by piece."""
    out = np.zeros(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        a = int(start[lo])
        hi = int(np.searchsorted(start, a + PIECE, "left"))
        h = Hashes(text[a : int(start[hi - 1]) + size])
        out[lo:hi] = h.of(start[lo:hi] - a, start[lo:hi] - a + size)
        lo = hi
    return out


def _listed(batch):
    """(text, its runs as arrays, doc, mark) of each document of a batch: a run is a key, its
    anchor's place and the offsets (anchor less start) of its windows, from lo to hi."""
    raw, ends = as_bytes(batch.column(2))
    for i, runs in enumerate(batch.column(3).to_pylist()):
        arrays = [np.array([r[x] for r in runs], np.int64) for x in ("key", "at", "lo", "hi")]
        alone = np.array([r["alone"] for r in runs], bool)
        yield raw[ends[i] : ends[i + 1]], *arrays, alone, batch.column(0)[i].as_py(), batch.column(1)[i].as_py()


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the run, first + 0, 1, 2 ...) for each of ``count`` items of every run."""
    run = np.repeat(np.arange(len(count)), count)
    return run, first[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)


def _blocks(batches, length: int, step: int):
    """Blocks of up to ``step`` neighbouring windows of each run, with the hash of the bytes that
    all windows of a whole block share, and that of all bytes of the block's own windows."""
    import pyarrow as pa

    for batch in batches:
        for text, key, at, lo, hi, alone, doc, mark in _listed(batch):
            run, off = _spread(lo // step, hi // step - lo // step + 1)
            off = off * step
            order = np.argsort(at[run] - off, kind="stable")
            run, off = run[order], off[order]
            low, high = np.maximum(lo[run], off), np.minimum(hi[run], off + step - 1)
            hashes = _stretches(text, at[run] - off, length - step + 1)
            union = np.zeros(len(run), np.uint64)
            for size in np.unique(high - low):  # windows from high to low, each a byte further
                same = np.flatnonzero(high - low == size)
                same = same[np.argsort((at[run] - high)[same], kind="stable")]
                union[same] = _stretches(text, (at[run] - high)[same], length + int(size))
            k = len(run)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[run]), pa.array(off), pa.array(signed(hashes)),
                 pa.array(signed(mixed(union + (low * 1024 + high).astype(np.uint64)))), pa.array(np.full(k, doc)),
                 pa.array(np.full(k, mark)), pa.array(at[run]), pa.array(low), pa.array(high), pa.array(alone[run])],
                names=["key", "off", "hash", "whole", "doc", "mark", "at", "lo", "hi", "alone"])


def _windows(batches, length: int):
    """Each window of the listed runs: key, hash, and where it begins."""
    import pyarrow as pa

    for batch in batches:
        for text, key, at, lo, hi, alone, doc, mark in _listed(batch):
            run, off = _spread(lo, hi - lo + 1)
            start = at[run] - off
            order = np.argsort(start, kind="stable")
            run, start = run[order], start[order]
            k = len(run)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[run]), pa.array(signed(_stretches(text, start, length))), pa.array(np.full(k, doc)),
                 pa.array(np.full(k, mark)), pa.array(start.astype(np.int32)), pa.array(alone[run])],
                names=["key", "hash", "doc", "mark", "start", "alone"])


_BLOCKS = "key long, off long, hash long, whole long, doc long, mark long, at long, lo long, hi long, alone boolean"


def _read_again(docs: DataFrame, runs: DataFrame, tag: str, function, schema: str) -> DataFrame:
    """``function`` over the texts of the documents that have ``runs``, written down."""
    lists = runs.groupBy("doc", "mark").agg(F.collect_list(F.struct("key", "at", "lo", "hi", "alone")).alias("runs"))
    lists = written(lists, f"{tag}-runs")
    out = written(_with_text(docs, lists).mapInArrow(function, schema), tag)
    discard(lists)
    return out


def _shared_windows(docs: DataFrame, edge: DataFrame, length: int, scratch: list[DataFrame]) -> DataFrame:
    """(doc, mark, a, b): the windows of the ``edge`` runs that another stretch of their key has, too.

    Blocks that occur twice as a whole give all their windows; of blocks that share
    what their windows have in common and differ, one of each kind is compared
    window by window; blocks that share less have no window in common."""
    blocks = _read_again(docs, edge, "suffix-blocks", lambda it: _blocks(it, length, STEP), _BLOCKS)
    near = ["key", "off", "hash"]
    # a run that is not alone stands for a stretch that occurs twice and is removed already
    kinds = blocks.groupBy(*near, "whole").agg(
        ((F.count("*") > 1) | F.bool_or(~F.col("alone"))).alias("twice"),
        F.min(F.struct("doc", "mark", "at", "lo", "hi")).alias("one"))
    kinds = written(kinds, "suffix-kinds")
    whole = blocks.filter("alone").join(kinds.filter("twice").select(*near, "whole"), [*near, "whole"], "left_semi").select(
        "doc", "mark", (F.col("at") - F.col("hi")).alias("a"), (F.col("at") - F.col("lo") + length).alias("b"))
    differ = kinds.groupBy(*near).agg(F.count("*").alias("c")).filter("c > 1").select(*near)
    runs = kinds.join(differ, near, "left_semi").select("key", "one.*", (~F.col("twice")).alias("alone"))
    windows = _read_again(docs, runs, "suffix-windows", lambda it: _windows(it, length),
                          "key long, hash long, doc long, mark long, start int, alone boolean")
    scratch += [blocks, kinds, windows]
    twice = windows.groupBy("key", "hash").agg(F.count("*").alias("c")).filter("c > 1").select("key", "hash")
    same = windows.filter("alone").join(twice, ["key", "hash"], "left_semi")
    return whole.unionAll(same.select(
        "doc", "mark", F.col("start").cast("long").alias("a"), (F.col("start") + length).cast("long").alias("b")))


def _cut(batches, length: int):
    """Per document with removed bytes: how many, in how many runs, and the digest of the rest."""
    import pyarrow as pa

    for batch in batches:
        raw, ends = as_bytes(batch.column(2))
        out = []
        for i, found in enumerate(batch.column(3).to_pylist()):
            text = raw[ends[i] : ends[i + 1]]
            edges = np.zeros(len(text) + 1, np.int32)
            np.add.at(edges, [r["a"] for r in found], 1)
            np.add.at(edges, [r["b"] for r in found], -1)
            gone = np.cumsum(edges[:-1]) > 0
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), int(gone.sum()), runs,
                        hashlib.sha256(text[~gone].tobytes()).hexdigest()))
        cols = list(zip(*out)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                         names=["d", "m", "n_removed", "n_spans", "kept_sha256"])


def repeats(family: IndexFamily, docs: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """(doc, mark, a, b): stretches of bytes whose every window occurs elsewhere, too.

    The family is closed as soon as its entries are read for the last time; the tables
    that the result still reads are added to ``scratch``."""
    length = family.length
    spans = family.entries().groupBy("key", "span").agg(
        F.count("*").alias("n"), F.min(F.struct("doc", "mark", "packed")).alias("one"))
    spans = written(spans, "suffix-spans")  # one row for each distinct stretch of a repeated key
    full = spans.filter("n > 1").select("key", "span")
    whole = _unpacked(family.entries().join(full, ["key", "span"], "left_semi")).select(
        "doc", "mark", (F.col("at") - F.col("back")).alias("a"),
        (F.col("at") - F.col("back") + F.col("width") + length).alias("b"))
    whole = written(whole, "suffix-whole")
    family.close()
    scratch += [spans, whole]

    differ = spans.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("key").alias("k"))
    edge = _unpacked(spans.join(differ, F.col("key") == F.col("k"), "left_semi").select(
        "key", F.col("one.doc").alias("doc"), F.col("one.mark").alias("mark"),
        F.col("one.packed").alias("packed"), (F.col("n") == 1).alias("alone")))
    edge = edge.select("key", "doc", "mark", "at", (F.col("back") - F.col("width")).alias("lo"), F.col("back").alias("hi"), "alone")
    return whole.unionAll(_shared_windows(docs, edge, length, scratch))


def _with_text(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """(doc, mark, text, list) of the documents that have a list; other texts are not shuffled."""
    maybe = bloom_filter(lists.select("doc"))
    some = identified(docs).filter(maybe(F.col("doc")))
    named = lists.toDF("d", "m", "list")
    return some.join(named, (F.col("doc") == F.col("d")) & (F.col("mark") == F.col("m"))).select("doc", "mark", "text", "list")


def deduplicated(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.coalesce("text", F.lit(""))
    rows = written(docs.select(
        F.col("doc_id"), row_id(F.col("doc_id")).alias("doc"), F.xxhash64(text).alias("mark"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")), "suffix-base")
    copied = rows.filter(F.col("n_bytes") >= length).groupBy("sha").agg(F.count("*").alias("c")).filter("c > 1").select(
        F.col("sha").alias("s"), F.lit(True).alias("copied"))
    base = written(rows.join(copied, F.col("sha") == F.col("s"), "left").drop("s"), "suffix-copies")
    discard(rows)
    # copies leave whole: nothing of them is left to cut
    kept = base.filter(F.col("copied").isNull()).select(F.col("doc").alias("d"), F.col("mark").alias("m"))

    family, scratch = IndexFamily(docs.sparkSession, length), []
    try:
        for b in range(batches):
            family.add(docs.filter(F.pmod(F.xxhash64(row_id(F.col("doc_id"))), F.lit(batches)) == b))
        found = repeats(family, docs, scratch)
    finally:
        family.close()
    found = found.join(kept, (F.col("doc") == F.col("d")) & (F.col("mark") == F.col("m")), "left_semi")
    lists = written(found.groupBy("doc", "mark").agg(F.collect_list(F.struct("a", "b")).alias("found")), "suffix-found")
    discard(*scratch)
    cut = _with_text(docs, lists).mapInArrow(
        lambda it: _cut(it, length), "d long, m long, n_removed long, n_spans long, kept_sha256 string")
    cut = written(cut, "suffix-cut")
    discard(lists)
    nothing = hashlib.sha256(b"").hexdigest()
    return base.join(cut, (F.col("doc") == F.col("d")) & (F.col("mark") == F.col("m")), "left").select(
        "doc_id", "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copied"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copied"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
