import glob
import random
import zlib

import numpy as np
import pytest

from quayline.llm import token_codes as codes
from quayline.llm.common import shared_path
from tests.llm.data import awkward_rows, docs_frame, rows_of

COLUMNS = ("doc_id", "start", "n_tokens", "ids_crc32")


@pytest.fixture(scope="module")
def encoder():
    return codes.Encoder(codes.TOKENIZER)


def direct(encoder, text):
    return [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, codes.END_ID]


def brute(encoder, rows):
    out, start = [], 0
    for i, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = direct(encoder, text)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_codes_round_trip_and_random_access():
    rng = random.Random(0)
    for size in (0, 1, 511, 512, 513, 5000):
        ids = np.array([rng.choice([0, 7, 255, 256, 300, 65535, 65536, 2**24, 2**32 - 1]) for _ in range(size)], np.uint32)
        shard = codes.Shard(codes.shard_bytes(3, 4, [1, None, 9], [ids[:2], ids[2:2], ids[2:]]))
        assert (shard.part, shard.sequence, shard.n_tokens) == (3, 4, size)
        assert (shard.all_tokens() == ids).all()
        assert [shard.token(i) for i in range(size)] == ids.tolist()
        assert (shard.document(2) == ids[2:]).all() and shard.null_ids.tolist() == [0, 1, 0]


def test_damage_is_noticed():
    data = bytearray(codes.shard_bytes(0, 0, [1], [np.arange(1000, dtype=np.uint32)]))
    data[200] ^= 1
    with pytest.raises(ValueError):
        codes.Shard(bytes(data))


def test_pieces_give_the_ids_of_whole_texts(encoder):
    rng = random.Random(1)
    import pyarrow as pa

    texts = ["", "  ", "a  b", " a \n b\n\n c", "don't  can't 've", "x<|endoftext|>y", "日本 語   z  q", "é\xa0\xa0 \xa0‍ ", "7\t\t8 \x85   x"]
    texts += ["".join(rng.choice("ab 1'.,\n\t é日\xa0 s t\r　_²") for _ in range(rng.randrange(60))) for _ in range(5000)]
    texts += ["a\x00b c\x00 \x00", "\x00", " \x00x", "　 x 　", "a \x1c b", "q \x85 r"]
    for lo in range(0, len(texts), 500):
        ids, ends = encoder.batch(pa.array(texts[lo : lo + 500]))
        for text, a, b in zip(texts[lo:], (0, *ends[:-1].tolist()), ends.tolist()):
            assert ids[a:b].tolist() == direct(encoder, text)[:-1], repr(text)


def test_files_match_direct_encoding(spark, encoder):
    rng = random.Random(2)
    rows = [(rng.randrange(10**6), " ".join(rng.choice(["alpha", "Beta,", "γδ", "12", "\n"]) for _ in range(rng.randrange(300)))) for _ in range(200)]
    got = codes.encode_documents(docs_frame(spark, rows, 5))
    assert rows_of(got, *COLUMNS) == brute(encoder, rows)


def test_small_shards_keep_order_and_random_access(spark, encoder):
    rows = [(i, f"text number {i} " * (i % 17)) for i in range(120)]
    path = shared_path(spark, "test-tokens")
    codes.write_shards(docs_frame(spark, rows, 4), path, shard_tokens=200)
    files = glob.glob(path.removeprefix("file:") + "/part-*")
    assert len(files) > 10
    got = codes.read_shards(spark, path)
    assert rows_of(got, *COLUMNS) == brute(encoder, rows)
    some = got.filter("doc_id = 50").first()
    with open(some.file.removeprefix("file:").replace("//", "/"), "rb") as f:
        shard = codes.Shard(f.read())
    assert shard.document(some.nth).tolist() == direct(encoder, dict(rows)[50])


def test_awkward_rows(spark, encoder):
    rows = awkward_rows()
    docs = docs_frame(spark, rows)
    assert rows_of(codes.encode_documents(docs), *COLUMNS) == brute(encoder, rows)
    assert codes.encode_documents(docs.limit(0)).count() == 0


def test_special_literals_have_the_ids_of_the_tokenizer_as_it_is(spark):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path(codes.TOKENIZER))
    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "x", "y.", "é", "\n", "\x00", "'s", "7"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(2000)]
    rows += [(9000, "x<|endoftext|>y"), (9001, "<|endoftext|>" * 3), (9002, "a <|endoftext|> b"), (9003, "a  <|endoftext|>  b ")]
    want = {i: fresh.encode(t, add_special_tokens=False).ids for i, t in rows}
    assert want[9000] == [87, 50256, 88]
    ids, ends = codes.Encoder(codes.TOKENIZER).batch(pa.array([t for _, t in rows]))
    for (i, t), a, b in zip(rows, (0, *ends[:-1].tolist()), ends.tolist()):
        assert ids[a:b].tolist() == want[i], repr(t)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in codes.encode_documents(docs_frame(spark, rows)).collect()}
    assert got == {i: (len(x) + 1, zlib.crc32(np.array([*x, codes.END_ID], "<u4").tobytes())) for i, x in want.items()}


def test_known_pieces_take_little_memory(monkeypatch):
    import pyarrow as pa

    encoder = codes.Encoder(codes.TOKENIZER)
    texts = [" ".join(f"w{i * 50 + k}é" for k in range(50)) for i in range(400)]
    ids, _ = encoder.batch(pa.array(texts))
    assert "tokenizer" not in vars(encoder)  # the second one is loaded only for texts with the separator
    assert len(encoder.known) >= 19_000 and encoder.known.nbytes + encoder.pool.nbytes + encoder.ends.nbytes < 60 * len(encoder.known)
    held = encoder.known.nbytes
    monkeypatch.setattr(codes, "CACHED_BYTES", 1000)
    again, _ = encoder.batch(pa.array(texts[:40]))
    assert encoder.known.nbytes < held and again.tolist() == ids[: len(again)].tolist()
    assert again.tolist() == [i for x in texts[:40] for i in direct(encoder, x)[:-1]]
