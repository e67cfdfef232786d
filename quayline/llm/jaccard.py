"""N-gram Jaccard join by PartEnum signatures.

A document's set are its distinct shingles of W words (3 by default). Documents link
when 100 * intersection >= T * union (T is 90 by default), which bounds the Hamming distance of sets of at most R shingles by
k = floor(2 R (100 - T) / (100 + T)). Sizes are cut into
bands that grow by half; a set is signed for its own band and, if a partner could
be larger than that band's R, for the next one, so any linked pair meets in the
larger set's band.

For a band the shingle domain is cut into n1 = ceil((k + 1) / 2) partitions, each
into three parts. If at most k shingles differ, some partition has at most one of
them, and two of its three parts are equal: the signatures are the three pairs of
parts of every partition, each hashed with its band and place. So linked sets
share a signature, whatever their size, and candidates are verified exactly.

Equal sets are one node. Within a signature, nodes are compared with a pivot, first
by size and by a 512-bit parity sketch, which linked sets cannot fail, then exactly;
members already in one component need no comparison, and while a signature still
spans components more pivots follow, until every pair that could add a link
between components was compared. So no group is expanded into all its pairs, and no
link between components is missed. The sets of candidates are computed again where
their texts are, found by a Bloom filter of fixed size, so texts never move.

Defined results: a text without words, or null, has an empty set, links with nothing
and is its own component; fewer than W words are one shingle; rows that repeat
an id are documents of their own with that id, and equal rows link; a null id never
names a component unless all its ids are null; an empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayline.llm.common import (
    NO_ID, Scratch, bloom_filter, bloom_hits, bloom_places, bloom_table, gram_hashes, mixed, prepare, row_id, signed, texts, word_hashes, written)
from quayline.llm.graph import components

SHINGLE = 3
LEAST = 90  # per cent
GROWTH = 1.5
SEEN_NODES = 1 << 18
SKETCH_BITS = 512
_EDGES = [0, 1]
while _EDGES[-1] < 1 << 40:
    _EDGES.append(max(_EDGES[-1] + 1, int(_EDGES[-1] * GROWTH)))
EDGES = np.array(_EDGES)
PAIRS = ((0, 1), (0, 2), (1, 2))


def shingles(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """The distinct hashed shingles of ``words`` words of a text, ascending."""
    return np.unique(gram_hashes(word_hashes(text.lower().split()), words))


def node_of(sets: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash for each set: a mixed sum over its shingles and its size."""
    sums = np.add.reduceat(mixed(sets ^ np.uint64(0x5851F42D4C957F2D)), starts) if len(starts) else np.zeros(0, np.uint64)
    return mixed(sums + sizes.astype(np.uint64))


def partitions(band: int, least: int = LEAST) -> int:
    """The first-level partitions of a band; 0 where only equal sets can link."""
    k = 2 * int(EDGES[band + 1]) * (100 - least) // (100 + least)
    return -(-(k + 1) // 2) if k else 0


def signatures(sets: np.ndarray, sizes: np.ndarray, bands: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, set number of each) of concatenated sets, each for its band."""
    n1 = np.array([partitions(int(b), least) for b in bands], np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    parts = 3 * n1
    first = np.cumsum(parts) - parts
    some = parts[owner] > 0
    owner, sets = owner[some], sets[some]
    salt = mixed(bands.astype(np.uint64) + np.uint64(1))
    h = mixed(sets ^ salt[owner])
    place = first[owner] + ((h >> np.uint64(20)) % np.maximum(parts[owner], 1).astype(np.uint64)).astype(np.int64)
    sums = np.zeros(int(parts.sum()), np.uint64)
    np.add.at(sums, place, mixed(h))
    sums = mixed(sums).reshape(-1, 3)  # one row for each first-level partition
    who = np.repeat(np.arange(len(sizes)), n1)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(n1) - n1, n1)
    tag = salt[who] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = [mixed(sums[:, a] * np.uint64(0xC2B2AE3D27D4EB4F) + mixed(sums[:, b] + np.uint64(3 * a + b)) + tag) for a, b in PAIRS]
    return np.concatenate(out), np.tile(who, 3)


def sketches(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each set, the parity of its shingles in SKETCH_BITS places, as 64-bit words: two sets'
    sketches differ in at most as many bits as the sets differ in shingles."""
    place = (mixed(sets ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.int64) % SKETCH_BITS
    owner = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(owner * SKETCH_BITS + place, minlength=len(sizes) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sizes), SKETCH_BITS // 64)


def _concatenated(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in found], np.int64)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.cumsum(sizes) - sizes, sizes


def _signed_documents(batches, least: int, words: int):
    """Per document: its set's size and node, and the signatures where a task meets the node first."""
    import pyarrow as pa

    seen: set[int] = set()
    for batch in batches:
        every = [shingles(t, words) for t in texts(batch.column(1))]
        n = np.array([len(x) for x in every], np.int64)
        full = np.flatnonzero(n)
        sets, starts, sizes = _concatenated([every[i] for i in full])
        nodes = np.zeros(len(every), np.uint64)
        nodes[full] = node_of(sets, starts, sizes)
        if len(seen) > SEEN_NODES:  # what is forgotten is signed again and meets its copy later
            seen.clear()
        new = []
        for i in full.tolist():
            if (node := int(nodes[i])) not in seen:
                seen.add(node)
                new.append(i)
        sets, _, sizes = _concatenated([every[i] for i in new])
        sketch: list = [None] * len(every)
        for i, bits in zip(new, sketches(sets, sizes).tolist()):
            sketch[i] = bits
        band = np.searchsorted(EDGES, sizes, "left") - 1
        sigs, who = signatures(sets, sizes, band, least)
        # a partner of 100 / least times the size may lie in the next band
        wide = np.flatnonzero(sizes * 100 // least > EDGES[band + 1]) if len(sizes) else np.zeros(0, np.int64)
        sets, _, sizes = _concatenated([every[new[i]] for i in wide])
        more, whose = signatures(sets, sizes, band[wide] + 1, least)
        sigs, who = np.concatenate((sigs, more)), np.array(new, np.int64)[np.concatenate((who, wide[whose]))]
        order = np.argsort(who, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(every)))))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(n), pa.array(signed(nodes), mask=n == 0),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(sigs[order]))),
             pa.array(sketch, pa.list_(pa.int64()))],
            names=["doc_id", "mark", "n_shingles", "node", "signatures", "sketch"])


def signed_documents(docs: DataFrame, least: int = LEAST, words: int = SHINGLE) -> DataFrame:
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    return rows.mapInArrow(lambda it: _signed_documents(it, least, words),
                           "doc_id long, mark long, n_shingles long, node long, signatures array<long>, sketch array<long>")


def _groups(sets: DataFrame) -> DataFrame:
    """(signature, pivot, node) of every node that shares a signature with a smaller one, its pivot.

    All frames run along the order, so a signature that many nodes share streams by.
    """
    rows = sets.select("node", F.explode("signatures").alias("signature"))
    along = Window.partitionBy("signature").orderBy("node")
    return (
        rows.withColumn("pivot", F.first("node").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.lag("node").over(along))
        .filter((F.col("node") != F.col("pivot")) & (F.col("node") != F.col("before")))
        .select("signature", "pivot", "node")
    )


def _candidate_sets(docs: DataFrame, wanted: DataFrame, words: int, made: Scratch) -> DataFrame:
    """(node, shingles) of the ``wanted`` nodes, from the text of the document (owner) of each."""
    import pyarrow as pa

    shared = bloom_table(wanted.select("owner"))

    def build(batches):
        for batch in batches:
            hit = bloom_hits(shared.value, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            batch = batch.filter(pa.array(hit))
            for lo in range(0, batch.num_rows, 32):
                part = batch.slice(lo, 32)
                found = [shingles(t, words) for t in texts(part.column(1))]
                full = [i for i, x in enumerate(found) if len(x)]
                sets, starts, sizes = _concatenated([found[i] for i in full])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(node_of(sets, starts, sizes))),
                     pa.ListArray.from_arrays(pa.array(np.append(starts, len(sets)), pa.int32()), pa.array(signed(sets)))],
                    names=["node", "shingles"])

    # the test runs where the sets are made: a second Python step would double the workers of a task
    doc_id = row_id(F.col("doc_id"))
    rows = docs.select(doc_id.alias("doc_id"), "text", *(p.alias(f"p{i}") for i, p in enumerate(bloom_places(doc_id))))
    sets = rows.mapInArrow(build, "node long, shingles array<long>")
    # by node alone, which is also what is told apart below: the sets are shuffled once
    kept = sets.join(wanted.select("node"), "node", "left_semi")
    return made.written(kept.dropDuplicates(["node"]), "jaccard-sets")


def _links(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (u, v) whose sets reach the threshold, exactly.

    A Bloom filter of the nodes on each side keeps all other sets where they are."""
    left, right = (sets.filter(bloom_filter(pairs.select(x))(F.col("node"))).select(
        F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "uv")
    shared, both = F.size(F.array_intersect("su", "sv")), F.size("su") + F.size("sv")
    return pairs.select("u", "v").join(right, "v").join(left, "u").withColumn("shared", shared).filter(
        100 * F.col("shared") >= least * (both - F.col("shared"))).select("u", "v")


def _fits(least: int):
    """What linked sets must satisfy, by their sizes and sketches alone; few other candidates do."""
    differ = F.expr("aggregate(zip_with(bu, bv, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    return (100 * F.least("nu", "nv") >= least * F.greatest("nu", "nv")) & (
        (100 + least) * differ <= (100 - least) * (F.col("nu") + F.col("nv")))


def _linked(groups: DataFrame, nodes: DataFrame, docs: DataFrame, least: int, words: int) -> DataFrame:
    """(node, root) of all linked nodes, as a written table; no other table of the search stays."""
    made, roots = Scratch(), None
    try:
        roots = _searched(groups, nodes, docs, least, words, made)
        return roots
    finally:
        made.close(*([] if roots is None else [roots]))


def _searched(groups: DataFrame, nodes: DataFrame, docs: DataFrame, least: int, words: int, made: Scratch) -> DataFrame:
    named = groups.select("node").unionAll(groups.select("pivot")).distinct()
    wanted = made.written(nodes.join(named, "node", "left_semi").select("node", "owner", "n_shingles", "sketch"), "jaccard-wanted")
    members = _candidate_sets(docs, wanted, words, made)
    n = lambda x: wanted.select(
        F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"b{x}"))

    # Every node and its pivots, fitting in size and sketch; tried are some more pivots of each node from round to round,
    # and only while node and pivot lie in different components: a group of copies is linked by its first pivot.
    pairs = groups.select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    pairs = made.written(pairs.join(n("u"), "u").join(n("v"), "v").filter(_fits(least)).select("u", "v"), "jaccard-pairs")
    by_node = Window.partitionBy("v").orderBy("u")
    links, roots, left = None, None, pairs
    for most in (1, 8, None):
        if roots is not None:
            left = _apart(left, roots)
        ranked = left.withColumn("nth", F.row_number().over(by_node))
        ranked = made.written(ranked, "jaccard-ranked") if most else left
        now = ranked.filter(F.col("nth") <= most) if most else ranked
        found = made.written(_links(now, members, least), "jaccard-links")
        links = found if links is None else links.unionAll(found)
        roots = made.written(components(links), "jaccard-roots")
        if not most:
            break
        left = ranked.filter(F.col("nth") > most).select("u", "v")

    # signatures of three and more nodes: pivots follow while members lie in several components
    along = Window.partitionBy("signature").orderBy("node")
    of = groups.select("signature", "node").withColumn("nth", F.row_number().over(along))
    of = of.join(n("v"), F.col("node") == F.col("v")).drop("v")
    lo, hi, tried = 1, 2, pairs
    while True:
        rooted = of.join(roots.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select(
            "signature", "node", "nth", "nv", "bv", F.coalesce("root", "node").alias("root"))
        # only what no pivot before has been compared with
        rooted = rooted.filter(F.col("nth") >= lo)
        open_ = rooted.groupBy("signature").agg(
            F.min("root").alias("least"), F.max("root").alias("most")).filter(F.col("least") != F.col("most"))
        of = made.written(rooted.join(open_.select("signature"), "signature", "left_semi"), "jaccard-open")
        if not of.take(1):
            return roots
        pivots = of.filter(F.col("nth") < hi).select(
            F.col("signature").alias("s"), F.col("node").alias("u"), F.col("nth").alias("k"), F.col("root").alias("r"),
            F.col("nv").alias("nu"), F.col("bv").alias("bu"))
        apart = (F.col("signature") == F.col("s")) & (F.col("nth") > F.col("k")) & (F.col("root") != F.col("r"))
        more = of.join(pivots, apart & _fits(least)).select("u", F.col("node").alias("v")).distinct()
        more = made.written(more.join(tried, ["u", "v"], "left_anti"), "jaccard-pairs")
        found = made.written(_links(more, members, least), "jaccard-links")
        tried = tried.unionAll(more)
        if found.take(1):
            links = links.unionAll(found)
            roots = made.written(components(links), "jaccard-roots")
        of = of.drop("root")
        lo, hi = hi, hi + 16 * (hi - lo)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v) that no chain of links joins yet."""
    at = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    joined = pairs.join(at("u"), "u", "left").join(at("v"), "v", "left")
    return joined.filter(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")


def _rooted(docs: DataFrame, least: int, words: int) -> DataFrame:
    """One row per document: doc_id, mark (its text's hash), n_shingles, component_id, root (a node; none if empty)."""
    made = Scratch()
    signed_ = made.written(signed_documents(docs, least, words), "jaccard-signed")
    sets = written(signed_.select("doc_id", "mark", "n_shingles", "node"), "jaccard-documents")
    nodes = signed_.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("owner"),
        F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch"))
    nodes = written(nodes, "jaccard-nodes")
    groups = made.written(_groups(signed_), "jaccard-groups")
    made.discard(signed_)
    roots = _linked(groups, nodes, docs, least, words)
    made.close()
    named = nodes.join(roots.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select(
        "node", nodes["doc_id"], F.coalesce("root", "node").alias("root"))
    first = named.groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("component_id"))
    named = named.join(first, F.col("root") == F.col("r")).select(F.col("node").alias("k"), "component_id", "root")
    return sets.join(named, F.col("node") == F.col("k"), "left").select(
        "doc_id", "mark", "n_shingles", "root",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def classes(docs: DataFrame, least: int = LEAST, words: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return _rooted(docs, least, words).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, least: int = LEAST, words: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without words, and of each component the row with the smallest id, as they are."""
    rows = _rooted(docs, least, words).filter(F.col("root").isNotNull()).select(row_id(F.col("doc_id")).alias("id"), "mark", "root")
    rows = written(rows, "jaccard-rows")
    first = rows.groupBy(F.col("root").alias("r")).agg(F.min(F.struct("id", "mark")).alias("first"))
    gone = rows.join(first, F.col("root") == F.col("r")).filter(F.struct("id", "mark") != F.col("first"))
    gone = written(gone.select(F.col("id").alias("__gone_id"), F.col("mark").alias("__gone_mark")).distinct(), "jaccard-gone")
    again = rows.groupBy("id", "mark").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.col("id").alias("__gone_id"), F.col("mark").alias("__gone_mark"))
    again = written(again, "jaccard-again")
    # only rows that a Bloom filter of these keys lets through are shuffled; the other texts stay where they are
    key, mark = row_id(docs["doc_id"]), F.xxhash64(docs["text"])
    same = (key == F.col("__gone_id")) & (mark == F.col("__gone_mark"))
    asked = bloom_filter(gone.unionAll(again).select(F.xxhash64("__gone_id", "__gone_mark")))(F.xxhash64(key, mark))
    kept = docs.filter(asked).join(gone, same, "left_anti")
    if again.take(1):
        # rows that repeat an id with its text: one of them stays
        repeated = kept.join(again, same, "left_semi").withColumn("__id", key).dropDuplicates(["__id", "text"])
        kept = kept.join(again, same, "left_anti").unionByName(repeated.drop("__id"))
    return docs.filter(~asked).unionByName(kept)
