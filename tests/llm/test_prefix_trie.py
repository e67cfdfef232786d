import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from quayline.llm import prefix_trie
from quayline.llm.parentheses import Parentheses
from tests.llm.data import HAVE_DATA, SF, duck, oracle_rows, rows_of

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
# extra columns carry names that the operator uses itself
TURNS = T.StructType([T.StructField(n, t) for n, t in (
    ("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()),
    ("mark", T.StringType()), ("depth", T.StringType()), ("pos", T.IntegerType()), ("k1", T.StringType()))])


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "m", "d", 1, "k") for r in rows], TURNS).repartition(parts)


def brute(rows):
    """The trie from the definition: prefixes as tuples in dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, mark, role, text))
    own = {c: [x[3:] for x in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:])
    members, ends, kids = {}, {}, {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        own_part = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own_part + sum(saved[k] for k in below)
        leaves[node] = sum(leaves[k] for k in below) or 1
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest())
                   for n, m in members.items()), key=repr)


def awkward():
    rows = [(c, t, r, x) for c in (0, 1, 2, 3, 4) for t, r, x in
            ((0, "user", "héllo"), (1, None, "a b"), (2, "assistant", None), (3, "user", ""))]
    rows += [(7, None, "user", "héllo"), (7, 1, None, "a b"), (7, 1, None, "a b"), (7, 1, "user", "tie"), (9, 0, None, None)]
    rows += [(-3, 0, "user", "neg"), (-5, 0, "user", "neg"), (-5, 1, "u", "x" * 5000), (None, 0, "user", "no conversation")]
    rows += [(100 + c, t, "user", f"turn {t}") for c in range(60) for t in range(3)]  # copies
    rows += [(5000, t, "user", f"{t % 7}") for t in range(9500)] + [(5003, t, "user", f"{t % 7}") for t in range(9400)]
    rows += [(2**40 + c, 0, "user", f"only {c % 3}") for c in range(50)]
    return rows


def random_rows(seed, convs=80):
    rng = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = rng.randrange(-60, 200)
        rows += [(c, t, rng.choice(["u", "a", None]), rng.choice(["x", "yy", "", "é"])) for t in range(rng.randrange(1, 11))]
    return rows


def test_findclose_agrees_with_a_stack():
    rng = random.Random(5)
    for n, bias in ((1, 0.5), (40, 0.9), (200, 0.5), (3000, 0.55), (3000, 0.98)):
        bits, depth, left, stack, close = [1], 1, n - 1, [], {}
        while depth or left:
            if left and (not depth or rng.random() < bias):
                bits.append(1)
                depth, left = depth + 1, left - 1
            else:
                bits.append(0)
                depth -= 1
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        trie = Parentheses(np.array(bits))
        at = np.flatnonzero(trie.opens)
        assert trie.findclose(at).tolist() == [close[i] for i in at.tolist()]


def test_shards_agree_with_the_whole():
    """Paths cut into shards at every place: merged spines give the sums of one shard."""
    rows = [(1, [1, 1], [6, 3], [5, 2], False), (2, [1, 1, 2], [6, 3, 2], [5, 2, 7], False), (3, [1, 1, 2, 3], [6, 3, 2, 1], [5, 2, 7, 0], True),
            (4, [1, 4], [6, 1], [5, 0], True), (8, [8], [2], [9], False), (9, [8, 9], [2, 1], [9, 0], True)]
    root = (1, 8, 4)

    def sums(parts):
        out = {}
        for part in parts:
            for rep, size, parent, leaves, saved, spine in zip(*prefix_trie.encode_shard(iter(part), root)):
                old = out.get((rep, size))
                assert old is None or (spine and old[3])
                out[rep, size] = (parent, leaves + (old[1] if old else 0), saved + (old[2] if old else 0), spine)
        return {k: v[:3] for k, v in out.items()}

    whole = sums([rows])
    assert whole[1, 8] == (None, 3, 4 + 5 + 2 + 7 + 9) and whole[1, 6] == (1, 2, 14) and whole[8, 2] == (1, 1, 9)
    for i in range(1, len(rows)):
        for j in range(i, len(rows)):
            assert sums([p for p in (rows[:i], rows[i:j], rows[j:]) if p]) == whole


@pytest.mark.parametrize("rows", [awkward(), random_rows(1), random_rows(2), [(1, 0, "u", "a")], [(3, 0, "u", "a")],
                                  [(c, 0, "u", "same") for c in range(0, 500, 5)], []])
def test_matches_brute_force(spark, rows):
    assert rows_of(prefix_trie.prefix_trie(frame(spark, rows)), *COLUMNS) == brute(rows)


def test_sql_matches_brute_force(spark):
    rows = [r for r in awkward() if r[0] is None or not 5000 <= r[0] < 6000] + random_rows(3)
    con = duck(conversations=frame(spark, rows).select("conv_id", "turn", "role", "text"))
    assert oracle_rows(con, prefix_trie.oracle_sql(), *COLUMNS) == brute(rows)


def test_long_ends_are_hashed_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 3)
    rows = [(c, t, "u", f"{t}") for c in range(0, 300) for t in range(20)]
    assert rows_of(prefix_trie.prefix_trie(frame(spark, rows)), *COLUMNS) == brute(rows)


@pytest.mark.skipif(not HAVE_DATA, reason="driver tables absent")
def test_driver_table(spark):
    got = rows_of(prefix_trie.prefix_trie(spark.read.parquet(f"{SF}/conversations.parquet")), *COLUMNS)
    con = duck(conversations=f"{SF}/conversations.parquet")
    assert got == oracle_rows(con, prefix_trie.oracle_sql(), *COLUMNS)
