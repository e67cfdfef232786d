"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every word 3-gram of a test item is a seed, however many documents hold it: any
stretch of three unchanged words joins an edited copy to its item, beside any number
of other copies. What common grams join is kept cheap by bounds that lose no pair:
an alignment scores at most two for each word of the item that it matches, so an
item is passed over where a document holds too few of its words at all, and a
passage where no stretch as long as such an alignment can be holds enough of them.

Hits of an item near one diagonal make a passage, which is aligned with the whole
item by Smith-Waterman over words (match 2, mismatch -1, gap -1). The score is the
best local alignment over what the item scores with itself, so edited copies lose in
proportion to their edits; a pair counts from ``LEAST_SCORE``. A copy with every
third word changed has no unchanged three words and is not joined.

The documents never move: items are broadcast in blocks whose texts hold at most
``BLOCK_BYTES``, and every block reads the documents once.

Defined results: null and empty texts and items without words match nothing; an
item of one or two words is its own seed; items with equal texts are each
reported; an item id that repeats with other texts is aligned with each and takes
the best score; repeated document rows give repeated result rows; items with a
null id are left out. Documents are removed by id (a null id is one) and text, so rows
that share an id stay or go by their own texts. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.llm.common import gram_hashes, prepare, texts, word_hashes, written

N = 3
LEAST_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 4 << 20
_KEEP = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(_KEEP).split()


def alignment(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score of two word sequences and where it lies in ``a`` (start, end).

    Rows go along the shorter ``b``. A gap along the row is a running maximum of
    H + GAP * distance, so each row is a few vector operations.
    """
    m = len(a)
    ramp = -GAP * np.arange(m + 1)
    above = np.zeros(m + 1, np.int64)
    came = np.arange(m + 1)  # where the alignment that ends in a cell begins
    best, where = 0, (0, 0)
    for w in b:
        diagonal = above[:-1] + np.where(a == w, MATCH, MISMATCH)
        row = np.zeros(m + 1, np.int64)
        row[1:] = np.maximum(np.maximum(diagonal, above[1:] + GAP), 0)
        begun = np.arange(m + 1)
        begun[1:] = np.where(row[1:] == 0, begun[1:], np.where(row[1:] == diagonal, came[:-1], came[1:]))
        lifted = np.maximum.accumulate(row + ramp)
        gapped = lifted - ramp
        source = np.maximum.accumulate(np.where(row + ramp == lifted, np.arange(m + 1), 0))
        begun = np.where(gapped > row, begun[source], begun)
        above, came = gapped, begun
        end = int(above.argmax())
        if above[end] > best:
            best, where = int(above[end]), (int(came[end]), end)
    return best, *where


class Items:
    """A block of test items: their words and, as seeds, their grams in ascending order."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words, grams, owner, place = [], [], [], [], []
        for item_id, text in rows:
            h = word_hashes(words(text.encode("utf-8", "replace")))
            if len(h):
                g = gram_hashes(h, N)
                grams.append(g)
                owner.append(np.full(len(g), len(self.ids)))
                place.append(np.arange(len(g)))
                self.ids.append(item_id)
                self.words.append(h)
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.grams = every[order]
        self.owner = (np.concatenate(owner) if owner else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.sizes = sorted({min(N, len(w)) for w in self.words})
        self.known, self.coded = np.unique(np.concatenate(self.words) if self.words else every, return_inverse=True)

    def within_reach(self, h: np.ndarray, items: np.ndarray, least: float) -> np.ndarray:
        """Which of ``items`` have so many of their words in a document that they can reach ``least``."""
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        present = np.zeros(len(self.known), bool)
        present[at[self.known[at] == h]] = True
        sizes = self.lengths[items]
        begin = np.cumsum(sizes) - sizes
        word = np.arange(sizes.sum()) + np.repeat(self.starts[items] - begin, sizes)
        return np.add.reduceat(present[self.coded[word]].astype(np.int64), begin) / sizes >= least


def _doc_grams(h: np.ndarray, sizes: list[int]):
    """The grams of a document for each gram length that the items have."""
    for n in sizes:
        if len(h) >= n:
            yield gram_hashes(h, n)


def passages(h: np.ndarray, items: Items, least: float):
    """Yield (item, first word, last word + 1, seeds) of the passages of a document that seeds join
    and that can reach ``least``."""
    hits = []
    for g in _doc_grams(h, items.sizes):
        lo = np.searchsorted(items.grams, g, "left")
        count = np.searchsorted(items.grams, g, "right") - lo
        at = np.flatnonzero(count)
        if len(at):
            entry = np.repeat(lo[at], count[at]) + np.arange(count[at].sum()) - np.repeat(np.cumsum(count[at]) - count[at], count[at])
            hits.append(np.stack([items.owner[entry], np.repeat(at, count[at]) - items.place[entry]]))
    if not hits:
        return
    owner, begin = np.concatenate(hits, axis=1)
    named, which = np.unique(owner, return_inverse=True)
    some = items.within_reach(h, named, least)[which]
    owner, begin = owner[some], begin[some]
    if not len(owner):
        return
    order = np.lexsort((begin, owner))
    owner, begin = owner[order], begin[order]
    size = items.lengths[owner]
    # hits whose diagonals lie within an item's length of each other share a passage
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (begin[1:] - begin[:-1] > size[1:])
    starts = np.flatnonzero(new)
    for lo, hi in zip(starts, [*starts[1:], len(owner)]):
        slack = size[lo] // 2 + N
        first, last = max(0, begin[lo] - slack), min(len(h), begin[hi - 1] + size[lo] + slack)
        if _dense(h[first:last], items.words[owner[lo]], least):
            yield int(owner[lo]), int(first), int(last), int(hi - lo)


def _dense(passage: np.ndarray, item: np.ndarray, least: float) -> bool:
    """Whether some stretch of the passage, as long as an alignment of that score can be, holds enough
    of the item's words: at most every word matches, and what that scores beyond ``least`` pays for gaps."""
    longest = int(np.ceil(len(item) * (1 + MATCH * max(0.0, 1 - least)))) + 1
    upto = np.concatenate(([0], np.cumsum(np.isin(passage, item))))
    return bool((upto[np.minimum(np.arange(len(upto)) + longest, len(passage))] - upto).max() / len(item) >= least)


def aligned_pieces(h: np.ndarray, item: np.ndarray, first: int, last: int):
    """The best alignment of a passage with an item, in overlapping pieces if the passage is long."""
    step = 4 * len(item) + 64
    best = (0, first, first)
    for lo in range(first, max(first + 1, last), step):
        score, a, b = alignment(h[lo : min(last, lo + step + 2 * len(item) + 8)], item)
        if score > best[0]:
            best = (score, lo + a, lo + b)
    return best


def _align(batches, items: Items, least: float):
    import pyarrow as pa

    for batch in batches:
        out = []
        for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
            h = word_hashes(words(text))
            best: dict[int, tuple] = {}
            for k, first, last, n in passages(h, items, least):
                score, a, b = aligned_pieces(h, items.words[k], first, last)
                share = score / (MATCH * len(items.words[k]))
                if share >= least and share > best.get(items.ids[k], (0.0,))[0]:
                    best[items.ids[k]] = (share, n, a, b)
            out += [(doc_id, mark, item, *x) for item, x in sorted(best.items())]
        cols = list(zip(*out)) if out else [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                         names=["doc_id", "mark", "item_id", "score", "n_seeds", "first_word", "end_word"])


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Yield the items in blocks of bounded size, one block in the driver at a time."""
    rows = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    held, size = [], 0
    for item_id, text in rows.orderBy("item_id", "text").toLocalIterator():
        held.append((item_id, text))
        size += len(text)
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _found(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame:
    """The rows of ``matches`` with mark, the hash of the document's text."""
    spark = docs.sparkSession
    prepare(spark)
    schema = "doc_id long, mark long, item_id long, score double, n_seeds long, first_word long, end_word long"
    found = None
    for rows in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Items(rows))
        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(
            lambda it, s=shared: _align(it, s.value, least), schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, first_word, end_word) of each contaminated pair."""
    return _found(docs, benchmark, least).drop("mark")


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents that hold no test item, as they are."""
    gone = _found(docs, benchmark, least).select(F.col("doc_id").alias("__gone_id"), F.col("mark").alias("__gone_mark"))
    gone = written(gone.distinct(), "leaks")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__gone_id")) & (F.xxhash64(docs["text"]) == F.col("__gone_mark"))
    return docs.join(gone, same, "left_anti")
