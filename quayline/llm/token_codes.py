"""Token ids as directly addressable codes: chunk levels, continuation bitmaps, ranks.

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of
every id; a bitmap says which ids go on, and their next chunks follow each other
in level 1, and so on. The place of an id's next chunk is the number of bits set
before it, which the rank directory gives for every 512th bit, so any id is read
by one look-up per level without decoding a block.

Shards hold whole documents in ascending doc_id order. Documents are dealt by
range and encoded where they are written; each shard is one row of bytes that
Spark's text writer puts in a file of its own and commits, so a lost executor
leaves no half shard. The file is (little-endian) the magic, a header of eight
64-bit numbers (part, sequence, documents, tokens, levels, 0, 0, 0), the
documents' ids, null marks and ends, then per level its length, chunks, bitmap
and directory, and a closing CRC-32.

Encoding: a byte-level BPE never joins text across a space that begins or ends a
run of white space, nor across the words its pattern cuts, so the tokenizers library
encodes each word once and a bounded cache holds the ids of words and pieces;
whole texts and pieces give the same ids.

Defined results: a null text is empty and has the end id alone; a null doc_id
sorts first; rows that repeat an id are kept, ordered by text; an empty table
writes no shard. Other columns are not looked at.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayline.llm.common import prepare, shared_path, written

MAGIC = b"QLDAC001"
RANK_BITS = 512
SHARD_TOKENS = 4 << 20
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
CACHED_PIECES = 1_000_000
CACHED_BYTES = 32 << 20  # of the known pieces; their ids take about as much
PIECES_PER_LINE = 256
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
SPACE_IN_A_RUN = r" (?:[\s\p{Z}\x0b\x1c-\x1f\x{85}]|$)"
SEPARATOR = "\x00"
_RUN_BEGINS_OR_ENDS = re.compile(r"(?<!\s) | (?=\S)")


# ---- the code -------------------------------------------------------------

def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap bytes, rank directory) of each level of ``ids`` (32-bit unsigned)."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(_POPCOUNT[bitmap], np.arange(0, len(bitmap), RANK_BITS // 8), dtype=np.int64) if len(bitmap) else []
        ranks = np.cumsum(blocks, dtype=np.int64) - blocks
        levels.append(((rest & 0xFF).astype(np.uint8), bitmap, ranks.astype(np.uint32)))
        if not more.any():
            return levels
        rest = rest[more] >> np.uint32(8)


class Shard:
    """A shard's bytes, opened for whole or single reads."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.part, self.sequence, n_docs, self.n_tokens, n_levels, *_ = struct.unpack_from("<8q", data, 8)
        at = 72
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.null_ids = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
        self.ends = np.frombuffer(data, "<i8", n_docs, at + 9 * n_docs)
        at += 17 * n_docs
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<q", data, at)
            n_bytes, n_ranks = -(-n // 8), -(-n // RANK_BITS)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bitmap = np.frombuffer(data, np.uint8, n_bytes, at + 8 + n)
            ranks = np.frombuffer(data, "<u4", n_ranks, at + 8 + n + n_bytes)
            self.levels.append((chunks, bitmap, ranks))
            at += 8 + n + n_bytes + 4 * n_ranks
        (crc,) = struct.unpack_from("<I", data, at)
        if crc != zlib.crc32(memoryview(data)[:at]):
            raise ValueError("damaged token shard")

    def token(self, i: int) -> int:
        """The i-th id of the shard, by one look-up per level."""
        value, shift = 0, 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            start = block * RANK_BITS >> 3
            below = int(_POPCOUNT[bitmap[start : i >> 3]].sum()) + bin(int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)).count("1")
            i, shift = int(ranks[block]) + below, shift + 8
        raise ValueError("a chunk goes on beyond the last level")

    def document(self, k: int) -> np.ndarray:
        start = int(self.ends[k - 1]) if k else 0
        return np.array([self.token(i) for i in range(start, int(self.ends[k]))], np.uint32)

    def all_tokens(self) -> np.ndarray:
        value = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            out = chunks.astype(np.uint32)
            if len(value):
                rest = np.zeros(len(chunks), np.uint32)
                rest[np.unpackbits(bitmap, count=len(chunks), bitorder="little").view(bool)] = value << np.uint32(8)
                out |= rest
            value = out
        return value


def shard_bytes(part: int, sequence: int, doc_ids: list, documents: list[np.ndarray]) -> bytes:
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    levels = encode_levels(ids)
    out = [MAGIC, struct.pack("<8q", part, sequence, len(documents), len(ids), len(levels), 0, 0, 0)]
    out.append(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    out.append(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.append(np.cumsum([len(d) for d in documents], dtype=np.int64).astype("<i8").tobytes())
    for chunks, bitmap, ranks in levels:
        out += [struct.pack("<q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), ranks.astype("<u4").tobytes()]
    crc = 0
    for x in out:
        crc = zlib.crc32(x, crc)
    return b"".join([*out, struct.pack("<I", crc)])


# ---- the tokenizer --------------------------------------------------------

class Encoder:
    """Ids of whole texts, many at a time.

    Texts are cut at spaces and their pieces numbered by Arrow, so each distinct
    piece is looked up once per call among those known, which Arrow holds too: no
    piece becomes a Python object. Unknown pieces are encoded by the tokenizers
    library many as one text, with a separator that it removes before the
    tokenizer's own pattern applies, and told apart by their lengths in bytes.
    Pieces that hold the separator are encoded one by one."""

    def __init__(self, name: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.path = public_tokenizers.path(name)
        self.joined = Tokenizer.from_file(self.path)
        self.joined.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(SEPARATOR, "removed"), self.joined.pre_tokenizer])
        vocabulary = self.joined.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # one character of a token stands for one byte
            self.bytes_of[i] = len(token)
        for i, token in self.joined.get_added_tokens_decoder().items():  # stands for its literal
            self.bytes_of[i] = len(token.content.encode())
        self._forget()

    def _forget(self) -> None:
        import pyarrow as pa

        self.known = pa.array([], pa.string())
        self.pool = np.zeros(0, "<u4")  # ids of a space and the piece, one piece after the other
        self.ends = np.zeros(1, np.int64)  # piece i has pool[ends[i] : ends[i + 1]]

    @cached_property
    def tokenizer(self):
        """The tokenizer as it is; rarely needed, and as large as the other."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _encode(self, pieces, before: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array of pieces, each after ``before``, one after the other, and how many each has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = pc.match_substring(pieces, SEPARATOR).to_numpy(zero_copy_only=False)
        some = pieces.filter(pa.array(~odd))
        found, sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if len(some):
            cuts = pa.array([*range(0, len(some), PIECES_PER_LINE), len(some)], pa.int32())
            lines = pc.binary_join(pa.ListArray.from_arrays(cuts, some), SEPARATOR + before).to_pylist()
            found = np.concatenate([np.array(
                self.joined.encode_batch_fast([before + x], add_special_tokens=False)[0].ids, "<u4") for x in lines])
            upto = np.cumsum(pc.binary_length(some).to_numpy().astype(np.int64) + len(before))
            sizes = np.diff(np.searchsorted(np.cumsum(self.bytes_of[found]), upto, "right"), prepend=0)
        if not odd.any():
            return found, sizes
        ids = np.split(found, np.cumsum(sizes)[:-1]) if len(some) else []
        alone = self.tokenizer.encode_batch_fast([before + x for x in pieces.filter(pa.array(odd)).to_pylist()], add_special_tokens=False)
        each = iter(ids), (np.array(e.ids, "<u4") for e in alone)
        ids = [next(each[int(x)]) for x in odd]
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def _numbers(self, pieces) -> np.ndarray:
        """Each piece's number; unknown pieces are learned."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known) > CACHED_PIECES or self.known.nbytes > CACHED_BYTES:
            self._forget()
        found = pc.index_in(pieces, value_set=self.known)
        new = found.is_null()
        numbers = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        some = pieces.filter(new)
        if len(some):
            ids, sizes = self._encode(some, " ")
            numbers[numbers < 0] = np.arange(len(self.known), len(self.known) + len(some))
            self.known = pa.concat_arrays([self.known, some])
            self.pool = np.concatenate((self.pool, ids))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        return numbers

    def batch(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array of texts one after the other, and where each text ends."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(texts) == 0:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        # a space within a run of white space may not be cut at
        runs = pc.match_substring_regex(texts, SPACE_IN_A_RUN).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts, " ")
        if runs.any():
            cut = lists.to_pylist()
            for i in np.flatnonzero(runs):
                cut[i] = _RUN_BEGINS_OR_ENDS.split(texts[int(i)].as_py())
            lists = pa.array(cut, pa.list_(pa.string()))
        pieces = lists.flatten()
        coded = pieces.dictionary_encode()
        begins = np.asarray(lists.offsets, np.int64)[:-1] - lists.offsets[0].as_py()
        begun, begun_sizes = self._encode(pieces.take(pa.array(begins)), "")  # no space stands before these
        which = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        pool = np.concatenate((self.pool, begun))
        start, size = self.ends[which], self.ends[which + 1] - self.ends[which]
        size[begins] = begun_sizes
        start[begins] = len(self.pool) + np.cumsum(begun_sizes) - begun_sizes
        upto = np.cumsum(size)
        at = np.repeat((start - upto + size).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        return pool[at], np.append(upto[begins[1:] - 1], upto[-1])


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder per Python worker, kept between its tasks."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


# ---- Spark ----------------------------------------------------------------

def _gathered(batches, least: int = 4 << 20):
    """(ids, texts) of some batches together, so that fewer pieces are distinct."""
    import pyarrow as pa

    ids, held, size = [], [], 0
    for batch in batches:
        ids += batch.column(0).to_pylist()
        held.append(batch.column(1).fill_null(""))
        size += held[-1].nbytes
        if size >= least:
            yield ids, pa.concat_arrays(held)
            ids, held, size = [], [], 0
    if ids:
        yield ids, pa.concat_arrays(held)


def write_shards(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                 shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode and write all documents as shards under ``path``, ascending by doc_id."""
    import pyarrow as pa

    prepare(docs.sparkSession)

    def build(batches):
        from pyspark import TaskContext

        part, sequence, ids, held, n = TaskContext.get().partitionId(), 0, [], [], 0
        encode = encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        for doc_ids, some in _gathered(batches):
            found, ends = encode.batch(some)
            for doc_id, a, b in zip(doc_ids, (0, *ends[:-1].tolist()), ends.tolist()):
                held.append(np.concatenate((found[a:b], end)))
                ids.append(doc_id)
                n += len(held[-1])
                if n >= shard_tokens:
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard_bytes(part, sequence, ids, held)], pa.binary())})
                    sequence, ids, held, n = sequence + 1, [], [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard_bytes(part, sequence, ids, held)], pa.binary())})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    shards = ordered.sortWithinPartitions("doc_id", "text").mapInArrow(build, "shard binary")
    # the text writer puts the bytes down as they are and one line end after them
    shards.select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens, ids_crc32, and where it lies."""
    import pyarrow as pa

    prepare(spark)

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(content.as_buffer().to_pybytes())
                ids = shard.all_tokens().astype("<u4", copy=False)
                ends = shard.ends
                starts = np.concatenate((np.zeros(1, np.int64), ends))[:-1]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                k = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64(), mask=shard.null_ids.astype(bool)), pa.array(np.full(k, shard.part)),
                     pa.array(np.full(k, shard.sequence)), pa.array(np.arange(k)), pa.array(starts),
                     pa.array(np.asarray(ends - starts)), pa.array(crc, pa.int64()), pa.array([name] * k)],
                    names=["doc_id", "part", "sequence", "nth", "start", "n_tokens", "ids_crc32", "file"])

    schema = "doc_id long, part long, sequence long, nth long, start long, n_tokens long, ids_crc32 long, file string"
    local = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, schema)
    local = written(local, "token-index")
    # one row per shard, so the running sum is over shards, not documents
    along = Window.orderBy("p", "s").rowsBetween(Window.unboundedPreceding, -1)
    bases = local.groupBy(F.col("part").alias("p"), F.col("sequence").alias("s")).agg(F.sum("n_tokens").alias("n"))
    bases = bases.select("p", "s", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("base"))
    return local.join(bases, (F.col("part") == F.col("p")) & (F.col("sequence") == F.col("s"))).select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "file", "nth")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write all documents as shards and read them back: one row per document."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    write_shards(docs, path)
    return read_shards(spark, path)
