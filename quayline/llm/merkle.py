"""Merkle manifest of documents: subroots per language, one root, a proof per document.

Leaves of a language in ascending doc_id are paired up to its subroot, subroots in
order of the language up to the root. A superblock is 2^12 consecutive leaves.

1. Places come from a range sort (``ranks``): a language with a third of all rows
   lies in many partitions, and no task holds more than a superblock of it.
2. Each superblock is reduced to its node; these nodes are reduced in superblocks
   again until every language has its subroot, and the subroots likewise.
3. On the way back the siblings outside a superblock (its outer nodes) go down from
   tree to tree, and leaves and outer nodes are cogrouped by superblock: one task
   pairs the leaves, joins inner and outer siblings to each leaf's proof and folds the
   leaf, or its tampered form, back to a root.

Defined results: a null field is ``-``, an empty one ``0:``; a null language comes
first, and so does a null doc_id, which is never tampered with; rows that repeat a
doc_id are ordered by their leaf, whole repeats are leaves of their own; the proof of
a lone leaf is the hash of the empty text; an empty table has no rows. Other columns
are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayline.llm.common import prepare, written
from quayline.llm.ranks import ranked

BLOCK_BITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7
# an outer sibling is written with the side it stands on; a run of one has none
LEFT, RIGHT, ALONE = "<", ">", "-"


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(_field(columns[f]) for f in FIELDS)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, tampered): the hash of each row, and of its tampered form where that differs."""
    as_is = {f: docs[f] for f in FIELDS}
    picked = (F.crc32(docs["doc_id"].cast("string").cast("binary")) % TAMPER_EVERY == 0) & docs["n_chars"].isNotNull()
    changed = as_is | {"n_chars": docs["n_chars"].cast("decimal(38,0)") + 1}
    return docs.select(
        docs["lang"].cast("string").alias("lang"), docs["doc_id"].cast("long").alias("doc_id"),
        leaf_hash(as_is).alias("leaf"), F.when(picked, leaf_hash(changed)).alias("tampered"))


def joined_hash(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    return max(0, n - 1).bit_length()


def levels_within(nodes: list[str], steps: int) -> list[list[str]]:
    """The nodes and the ``steps`` levels above them; a run of one is hashed alone."""
    out = [nodes]
    for _ in range(steps):
        below = out[-1]
        out.append([joined_hash(below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """The sibling of node ``at`` and of each node above it, but not of the last level."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append(ALONE if other >= len(level) else (LEFT if other < at else RIGHT) + level[other])
        at >>= 1
    return out


def folded(leaf: str, path: list[str]) -> str:
    for s in path:
        leaf = joined_hash((leaf,) if s == ALONE else (s[1:], leaf) if s[0] == LEFT else (leaf, s[1:]))
    return leaf


def proof_hash(path: list[str]) -> str:
    return joined_hash(s[1:] for s in path)


def _sorted(block: pd.DataFrame, bits: int) -> tuple[pd.DataFrame, int]:
    """The block by place, and the levels to climb within it."""
    block = block.sort_values("pos")
    return block, min(bits, height(int(block["n"].iloc[0])))


def _blocks(nodes: DataFrame, bits: int):
    return nodes.withColumn("block", F.shiftright("pos", bits)).groupBy("tree", "block")


def reduced(nodes: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(tree, pos, node, n) one superblock up; ``n`` is the number of nodes of the tree."""
    def reduce(block: pd.DataFrame) -> pd.DataFrame:
        block, steps = _sorted(block, bits)
        top = levels_within(block["node"].tolist(), steps)[-1][0]
        first = block.iloc[0]
        return pd.DataFrame({"tree": [first["tree"]], "pos": [int(first["pos"]) >> bits], "node": [top],
                             "n": [((int(first["n"]) - 1) >> bits) + 1]})

    return _blocks(nodes, bits).applyInPandas(reduce, "tree string, pos long, node string, n long")


def outer_paths(nodes: DataFrame, bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """Of every node the siblings on its way to the root of its tree, and (tree, root).

    ``nodes`` is a written table (tree, pos, node, n). Each call is a superblock
    higher, so there are log(n) / 12 of them.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        none = F.array().cast("array<string>")
        return nodes.select("tree", "pos", none.alias("path")), nodes.select("tree", F.col("node").alias("root"))
    above, roots = outer_paths(written(reduced(nodes, bits), "merkle-nodes"), bits)

    def descend(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block, steps = _sorted(block, bits)
        levels = levels_within(block["node"].tolist(), steps)
        rest = list(outer["path"].iloc[0])
        return pd.DataFrame({"tree": block["tree"].tolist(), "pos": block["pos"].tolist(),
                             "path": [siblings(levels, i) + rest for i in range(len(block))]})

    paths = _blocks(nodes, bits).cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(
        descend, "tree string, pos long, path array<string>")
    return written(paths, "merkle-paths"), roots


def tree_name() -> Column:
    """The language as a key that is never null, for cogroups and joins."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null"))


def manifest(docs: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """One row per document: leaf, subroot, root, proof, and whether its tampered form still folds to the root."""
    spark = docs.sparkSession
    prepare(spark)
    placed = ranked(leaves(docs), "lang", ["doc_id", "leaf"], "merkle-leaves").withColumn("tree", tree_name())
    sizes = placed.groupBy("tree").agg((F.max("pos") + 1).alias("n"))
    placed = written(placed.join(sizes, "tree").drop("lang"), "merkle-placed")
    blocks = written(reduced(placed.withColumnRenamed("leaf", "node").select("tree", "pos", "node", "n"), bits), "merkle-blocks")
    paths, subroots = outer_paths(blocks, bits)

    # the subroots are the nodes of one more tree, in order of their language
    subroots = subroots.withColumn("lang", F.when(F.col("tree") != "null", F.substring("tree", 2, 1 << 30)))
    tops = ranked(subroots.withColumn("all", F.lit("")), "all", ["lang"], "merkle-subroots")
    count = F.lit(tops.count()).cast("long")
    tops = written(tops.select(F.lit("").alias("tree"), "pos", F.col("root").alias("node"), count.alias("n"),
                               F.col("tree").alias("of")), "merkle-tops")
    over, whole = outer_paths(tops.drop("of"), bits)
    found = whole.first()  # one row, none for an empty table
    root = found["root"] if found else None
    per_tree = tops.select("pos", F.col("of").alias("tree"), F.col("node").alias("subroot")).join(
        over.select("pos", F.col("path").alias("over")), "pos").drop("pos")
    outer = paths.join(per_tree, "tree").select(
        "tree", F.col("pos").alias("block"), F.concat("path", "over").alias("path"), "subroot")

    def prove(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block, steps = _sorted(block, bits)
        leaf = block["leaf"].tolist()
        levels = levels_within(leaf, steps)
        rest, subroot = list(outer["path"].iloc[0]), outer["subroot"].iloc[0]
        paths = [siblings(levels, i) + rest for i in range(len(leaf))]
        back = [folded(bad or good, path) for good, bad, path in zip(leaf, block["tampered"].tolist(), paths)]
        return pd.DataFrame({
            "doc_id": block["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "leaf": leaf, "subroot": subroot, "root": root,
            "proof_sha256": [proof_hash(p) for p in paths], "folded_root": back, "verified": np.array(back, object) == root})

    return _blocks(placed, bits).cogroup(outer.groupBy("tree", "block")).applyInPandas(
        prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def oracle_sql() -> str:
    crc = ("list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
           "lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda z: z::BIGINT)), "
           "lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))")

    def leaf(n_chars: str) -> str:
        fields = [n_chars if f == "n_chars" else f for f in FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"

    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT lang, doc_id, {leaf("n_chars")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND xor({crc}, 4294967295::BIGINT) % {TAMPER_EVERY} = 0 THEN {leaf("(n_chars + 1)")} END AS tampered
  FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
low AS (SELECT lang, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM p
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 1) // 2)
  FROM low WHERE n > 1 GROUP BY lang, level, pos // 2),
s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot FROM low WHERE n = 1),
high AS (SELECT 0 AS level, spot AS pos, node, (SELECT count(*) FROM s) AS n FROM s
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 1) // 2)
  FROM high WHERE n > 1 GROUP BY level, pos // 2),
steps AS (
  SELECT p.lang, p.doc_id, p.leaf, p.tampered, p.pos AS id, l.level, l.pos AS spot, o.node AS other
  FROM p JOIN low l ON l.lang IS NOT DISTINCT FROM p.lang AND l.n > 1 AND l.pos = p.pos >> l.level
  LEFT JOIN low o ON o.lang IS NOT DISTINCT FROM l.lang AND o.level = l.level AND o.pos = xor(l.pos, 1)
  UNION ALL
  SELECT p.lang, p.doc_id, p.leaf, p.tampered, p.pos, 1000 + h.level, h.pos, o.node
  FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN high h ON h.n > 1 AND h.pos = s.spot >> h.level
  LEFT JOIN high o ON o.level = h.level AND o.pos = xor(h.pos, 1)),
paths AS (SELECT lang, id, sha256(coalesce(string_agg(other, '' ORDER BY level), '')) AS proof_sha256,
                 list({{'left': spot % 2 = 1, 'other': coalesce(other, '')}} ORDER BY level) AS path FROM steps GROUP BY lang, id),
back AS (SELECT p.lang, p.pos, p.doc_id, p.leaf, coalesce(q.proof_sha256, sha256('')) AS proof_sha256,
  list_reduce(list_prepend({{'left': false, 'other': coalesce(p.tampered, p.leaf)}}, coalesce(q.path, [])),
    lambda a, b: {{'left': false, 'other': sha256(CASE WHEN b.left THEN b.other || a.other ELSE a.other || b.other END)}}).other AS folded_root
  FROM p LEFT JOIN paths q ON q.lang IS NOT DISTINCT FROM p.lang AND q.id = p.pos)
SELECT b.doc_id, b.leaf, s.node AS subroot, h.node AS root, b.proof_sha256, b.folded_root, b.folded_root = h.node AS verified
FROM back b JOIN s ON s.lang IS NOT DISTINCT FROM b.lang CROSS JOIN (SELECT node FROM high WHERE n = 1) h"""
