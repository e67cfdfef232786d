"""The prefix trie of rebuilt conversations: what shared beginnings save, per node.

A conversation c is rebuilt from the first h turns of conversation c - c % 5 and
its own turns after its first h, h = crc32(c as text) % 9. The nodes of the trie
are the distinct sequences of first turns; the root is the empty one.

1. Turns become 128-bit marks; their places come from a range sort (``ranks``), so
   a conversation with a third of all turns lies in many partitions. A prefix is
   known by two 64-bit XORs over hash(mark, place), which run in blocks of 4,096
   turns that are carried over, so no window holds a long conversation.
2. Equal prefixes are counted by partial aggregation. Nodes in a row that the same
   conversations pass form a chain, known by (smallest member, number of members);
   only chains go on.
3. The distinct sequences, as lists of the chains they pass, are range-partitioned
   in the order of the trie. Each shard writes its part as balanced parentheses
   (``parentheses``): findclose delimits a subtree, the rank of "()" counts its
   leaves, running sums over the openings give what it saves. A chain that two
   shards share lies on the first or last path of both; these spines are merged.
   A list holds the places where a sequence meets others, at most the square root
   of twice the number of turns.
4. Ids that end at a node are sorted, joined in pieces of 4,096 and run through
   SHA-256 piece by piece, so a node where a third of all conversations end is a
   stream of pieces.

Defined results: a null role or text is empty; a null turn comes first; rows of one
conversation with the same turn are ordered by the MD5 of role and text, and rows
that repeat wholly are turns of their own; rows without a conv_id belong to no
conversation; an empty table has no nodes. Other columns are not looked at.
Sequences are compared by their 128-bit hashes, shown turns by MD5.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayline.llm.common import prepare, written
from quayline.llm.parentheses import Parentheses
from quayline.llm.ranks import ranked

FAMILY = 5  # conversations that share a beginning
MOST_HEAD = 9  # h is below this
BLOCK_BITS = 12  # turns of a block, ids of a piece: 4,096
KEY = ["depth", "k1", "k2"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, mark, n_bytes, pos): every turn with its place from 0, without its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    body = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(body.cast("binary"))).alias("mark"), F.octet_length(text).cast("long").alias("n_bytes"))
    return written(ranked(rows, "conv_id", ["turn", "mark"], "trie-turns"), "trie-numbered")


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % MOST_HEAD


def rebuild_plan(turns: DataFrame) -> DataFrame:
    """One row per conversation: its base, h, how many turns the base gives, how many it has when rebuilt."""
    lengths = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "trie-lengths")
    base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = lengths.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(base, "base", "left")
    plan = plan.withColumn("h", head_length(F.col("conv_id")))
    plan = plan.withColumn("given", F.least("h", F.coalesce("base_n", F.lit(0))))
    total = F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return written(plan.select("conv_id", "base", "h", "given", total.alias("total")), "trie-plan")


def rebuilt_turns(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, depth from 1, mark, n_bytes, total) of all rebuilt conversations."""
    own = turns.join(plan, "conv_id").filter(F.col("pos") >= F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("given") + 1).alias("depth"), "mark", "n_bytes", "total")
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < MOST_HEAD)).select(
        F.col("conv_id").alias("base"), "pos", "mark", "n_bytes")
    given = heads.join(plan, "base").filter(F.col("pos") < F.col("given")).select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "mark", "n_bytes", "total")
    return own.unionByName(given)


def prefixes(rebuilt: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per conversation and depth, the root too: the key of the prefix, of its last turn, bytes so far."""
    marks = [F.xxhash64(F.lit(i), "mark", "depth").alias(f"x{i}") for i in (1, 2)]
    rows = written(rebuilt.select("conv_id", "depth", "n_bytes", "total", *marks,
                                  F.shiftright("depth", BLOCK_BITS).alias("block")), "trie-rebuilt")
    along = Window.partitionBy("conv_id", "block").orderBy("depth")
    inside = rows.select(
        "conv_id", "block", "depth", "x1", "x2", "n_bytes", (F.col("depth") == F.col("total")).alias("ends"),
        F.bit_xor("x1").over(along).alias("k1"), F.bit_xor("x2").over(along).alias("k2"), F.sum("n_bytes").over(along).alias("cum"))
    past = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.filter(F.col("total") >= 1 << BLOCK_BITS).groupBy("conv_id", "block")
        .agg(F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2"), F.sum("n_bytes").alias("cum"))
        .select("conv_id", "block", *(f(c).over(past).alias(f"c_{c}") for f, c in ((F.bit_xor, "k1"), (F.bit_xor, "k2"), (F.sum, "cum"))))
    )
    inside = inside.join(carry, ["conv_id", "block"], "left")
    before = {c: F.coalesce(f"c_{c}", F.lit(0)) for c in ("k1", "k2", "cum")}
    inside = inside.select(
        "conv_id", "depth", F.col("k1").bitwiseXOR(before["k1"]).alias("k1"), F.col("k2").bitwiseXOR(before["k2"]).alias("k2"),
        "x1", "x2", "n_bytes", (F.col("cum") + before["cum"]).alias("cum"), "ends")
    none = F.lit(0).cast("long")
    roots = plan.select("conv_id", none.alias("depth"), *(none.alias(c) for c in ("k1", "k2", "x1", "x2", "n_bytes", "cum")),
                        (F.col("total") == 0).alias("ends"))
    return written(inside.unionByName(roots), "trie-prefixes")


def trie_nodes(paths: DataFrame) -> DataFrame:
    """One row per distinct prefix: its key, n_convs, smallest member, bytes, number of children."""
    nodes = paths.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("x1").alias("x1"), F.first("x2").alias("x2"),
        F.max("n_bytes").alias("n_bytes"), F.max("cum").alias("cum"))
    up = [(F.col("depth") - 1).alias("depth"), *(F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"k{i}") for i in (1, 2))]
    kids = nodes.filter(F.col("depth") > 0).select(*up).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    joined = nodes.drop("x1", "x2").join(kids, KEY, "left")
    return written(joined.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")


def unary_chains(nodes: DataFrame) -> DataFrame:
    """One row per chain (conv_id, n_convs): top depth and key, what its own nodes save, bytes at its end."""
    grouped = nodes.groupBy("conv_id", "n_convs").agg(
        F.min("depth").alias("top"), F.min_by(F.struct("k1", "k2"), "depth").alias("key"),
        ((F.col("n_convs") - 1) * F.sum("n_bytes")).alias("weight"), F.max("cum").alias("cum_end"),
        F.max_by("n_children", "depth").alias("end_children"))
    return written(grouped, "trie-chains")


def chain_paths(paths: DataFrame, chains: DataFrame) -> DataFrame:
    """(conv_id, reps, sizes, weights, leaf): per distinct sequence the chains it passes below the root's."""
    tops = chains.filter((F.col("n_convs") > 1) & (F.col("top") > 0)).select(
        F.col("top").alias("depth"), "key.k1", "key.k2", F.col("conv_id").alias("rep"), "n_convs", "weight")
    tail = F.max(F.when((F.col("n_convs") == 1) & (F.col("top") > 0), F.lit(1)).otherwise(F.lit(0)))
    reps = chains.groupBy("conv_id").agg(tail.alias("tail"), (F.max_by("end_children", "top") == 0).alias("leaf"))
    met = paths.filter(F.col("depth") > 0).select("conv_id", *KEY).join(tops, KEY).join(reps.select("conv_id"), "conv_id", "left_semi")
    met = met.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "rep", "n_convs", "weight"))).alias("met"))
    rows = reps.join(met, "conv_id", "left")

    def listed(field: str, own: Column) -> Column:
        none = F.array().cast("array<long>")
        return F.concat(F.coalesce(F.col(f"met.{field}"), none), F.when(F.col("tail") == 1, F.array(own)).otherwise(none))

    return rows.select("conv_id", listed("rep", F.col("conv_id")).alias("reps"),
                       listed("n_convs", F.lit(1).cast("long")).alias("sizes"),
                       listed("weight", F.lit(0).cast("long")).alias("weights"), "leaf")


def encode_shard(rows, root: tuple[int, int, int]):
    """Balanced parentheses of the sorted paths of one shard.

    ``rows`` yields (conv_id, reps, sizes, weights, leaf); ``root`` is the root's chain
    (rep, size, weight). Returns the columns rep, size, parent, leaves, saved, spine.
    """
    rep, size, parent = [root[0]], [root[1]], [None]
    owned, own = [0], [root[2]]  # an own weight counts in the shard that has the representative's path
    bits, stack, spine, before, leaf = [1], [0], {0}, [], False
    first = True
    for conv, reps, sizes, weights, leaf in rows:
        shared = 0
        for a, b in zip(before, reps):
            if a != b:
                break
            shared += 1
        bits.extend([0] * (len(before) - shared))
        del stack[shared + 1 :]
        for i in range(shared, len(reps)):
            bits.append(1)
            parent.append(rep[stack[-1]])
            stack.append(len(rep))
            rep.append(reps[i])
            size.append(sizes[i])
            own.append(weights[i])
            owned.append(0)
        for node in reversed(stack):
            if rep[node] != conv:
                break
            owned[node] = own[node]
        if first:
            spine.update(stack)
            first = False
        before = reps
    if first:
        return None
    spine.update(stack)
    bits.extend([0] * len(stack))
    trie = Parentheses(np.array(bits, np.uint8))
    at = np.flatnonzero(trie.opens)
    close = trie.findclose(at)
    sums = np.concatenate(([0], np.cumsum(np.array(owned, np.int64))))
    saved = sums[trie.rank[close + 1]] - sums[trie.rank[at]]
    leaves = trie.leaf_rank[close] - trie.leaf_rank[at]
    if not leaf:  # the last path ends above nodes of the next shard
        leaves[stack] -= 1
    on_spine = np.zeros(len(rep), bool)
    on_spine[list(spine)] = True
    return rep, size, parent, leaves, saved, on_spine


def subtree_sums(lists: DataFrame, chains: DataFrame) -> DataFrame:
    """(conv_id, n_convs, parent, leaves, saved) per chain, from the shards."""
    import pyarrow as pa

    spark = lists.sparkSession
    prepare(spark)
    top = chains.filter(F.col("top") == 0).select("conv_id", "n_convs", "weight").first()
    names = ["conv_id", "n_convs", "parent", "leaves", "saved", "spine"]
    kinds = [pa.int64()] * 5 + [pa.bool_()]

    def encode(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "reps", "sizes", "weights", "leaf"))))
        found = encode_shard(rows, tuple(top))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds)], names=names)

    shards = lists.repartitionByRange("reps").sortWithinPartitions("reps").mapInArrow(
        encode, "conv_id long, n_convs long, parent long, leaves long, saved long, spine boolean")
    shards = written(shards, "trie-shards")
    spines = shards.filter("spine").groupBy("conv_id", "n_convs").agg(
        F.max("parent").alias("parent"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return shards.filter("NOT spine").drop("spine").unionByName(spines)


def end_digests(paths: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 of the ids that end at a node, ascending, comma-joined."""
    import pyarrow as pa

    prepare(paths.sparkSession)
    by = ["k1", "k2", "depth", "conv_id"]
    ends = paths.filter("ends").select(*by).repartitionByRange(*by).sortWithinPartitions(*by)
    ends = written(ends.withColumn("piece", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "trie-ends")
    ids = F.sort_array(F.collect_list("conv_id"))
    pieces = written(ends.groupBy(*KEY, "piece").agg(
        F.min("conv_id").alias("least"), F.array_join(ids.cast("array<string>"), ",").alias("body")), "trie-pieces")
    groups = pieces.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("body").alias("body"))
    groups = groups.withColumn("ends_sha256", F.sha2(F.col("body").cast("binary"), 256)).drop("body")

    def digest(batches):
        key, state, done = None, None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*KEY, "body"))):
                if row[:3] != key:
                    if state:
                        done.append((*key, state.hexdigest()))
                    key, state = row[:3], hashlib.sha256(row[3].encode())
                else:
                    state.update(b"," + row[3].encode())
            if len(done) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*KEY, "ends_sha256"])
                done = []
        if state:
            done.append((*key, state.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*KEY, "ends_sha256"])

    many = pieces.join(groups.filter("n > 1").select(*KEY), KEY, "left_semi")
    many = many.repartition(*KEY).sortWithinPartitions(*KEY, "least").select(*KEY, "body")
    long = many.mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")
    return groups.filter("n = 1").select(*KEY, "ends_sha256").unionByName(long)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    turns = numbered_turns(conversations)
    plan = rebuild_plan(turns)
    paths = prefixes(rebuilt_turns(turns, plan), plan)
    nodes = trie_nodes(paths)
    chains = unary_chains(nodes)
    if chains.isEmpty():
        return conversations.sparkSession.createDataFrame([], ", ".join(
            f"{c} long" for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
        ) + ", ends_sha256 string")
    sums = subtree_sums(chain_paths(paths, chains), chains)
    sums = sums.join(chains.select("conv_id", "n_convs", "top", "weight", "cum_end"), ["conv_id", "n_convs"])
    rows = nodes.join(sums, ["conv_id", "n_convs"]).join(end_digests(paths), KEY, "left")
    own = (F.col("n_convs") - 1) * (F.col("cum_end") - F.col("cum") + F.col("n_bytes"))  # this node and those below it in its chain
    parent = F.when(F.col("depth") > F.col("top"), F.col("conv_id")).when(F.col("depth") > 0, F.col("parent"))
    return rows.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("saved") - F.col("weight") + own).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def oracle_sql() -> str:
    crc = ("list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(h.conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
           "lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda z: z::BIGINT)), "
           "lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))")
    return f"""
WITH t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST,
              md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, xor({crc}, 4294967295::BIGINT) % {MOST_HEAD} AS h FROM t h),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS path
      FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % {FAMILY}),
p AS (SELECT conv_id, unnest(range(len(path) + 1)) AS depth, path FROM r),
q AS (SELECT conv_id, depth, path[1:depth] AS pre, depth = len(path) AS ends FROM p),
n AS (SELECT pre, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
      FROM q GROUP BY pre, depth),
k AS (SELECT pre[1:depth - 1] AS pre, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children,
             CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(n.pre[depth].t) ELSE 0 END AS saves
      FROM n LEFT JOIN k ON k.pre = n.pre),
up AS (SELECT pre[1:d] AS pre, sum(saves) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
       FROM (SELECT *, unnest(range(depth + 1)) AS d FROM m) GROUP BY 1)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, CAST(m.n_convs AS BIGINT) AS n_convs,
       CAST(m.n_children AS BIGINT) AS n_children, CAST(up.leaves AS BIGINT) AS n_leaves,
       CAST(up.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN up ON up.pre = m.pre LEFT JOIN m a ON m.depth > 0 AND a.pre = m.pre[1:m.depth - 1]"""
