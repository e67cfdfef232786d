"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Every source has a size (words of all its texts) and a weight. The mix has as
many words as the corpus and gives each source its share by weight, but a source
is read at most ``max_epochs`` times: what exceeds that is shared again by weight
among the others until none is above. In the order of ``cap / weight`` the
clamped sources are a prefix, so the repeated re-sharing is two running sums.

A source's rate is target / size. Each of its documents is taken floor(rate)
times, and the rest of the target is filled by one more repetition of documents
in the order of a seeded hash of their id and text, up to the document whose middle passes
the rest. The order is cut by hash buckets: sums of buckets place the cut, and
only the bucket that holds it is put in order, so no source is sorted as a whole.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; the order goes by id and text together, so rows without an id, or with
the same id, are told apart by their texts, and only rows that repeat both share one
decision; a null id hashes as the text "null"; a source of size 0 has target 0 and takes nothing;
an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayline.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 17
HASH_BITS = 60  # 15 hexadecimal digits of an MD5
BUCKET_BITS = 10


def order_hash(doc_id: Column, text: Column, seed: int) -> Column:
    """The seeded place of a document: the first 60 bits of MD5("seed:doc_id:MD5(text)")."""
    body = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), body)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size in words, place in the seeded order."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order_hash(F.col("doc_id"), F.col("text"), seed).alias("place"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target. Windows run over the source totals only."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("total", F.sum("source_size").over(everywhere).cast("double"))
        .withColumn("caps_before", F.sum("cap").over(filled) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(everywhere) - F.sum("weight").over(filled) + F.col("weight"))
    )
    clamped = (F.col("total") - F.col("caps_before")) * F.col("weight") > F.col("cap") * F.col("weight_left")
    per = per.withColumn("clamped", clamped)
    shared = F.col("total") - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0.0)).over(everywhere)
    left = F.sum(F.when(F.col("clamped"), 0.0).otherwise(F.col("weight"))).over(everywhere)
    return per.select(
        "source", "source_size",
        F.when(F.col("clamped"), F.col("cap")).otherwise(shared * F.col("weight") / left).alias("target"),
    )


def rates(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """One row per source: its target, whole repetitions, and the last place that gets one more.

    ``sized`` and ``goals`` are written tables; each is read more than once here.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = goals.withColumn("whole", whole.cast("long"))
    goals = goals.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    bucket = F.shiftright("place", HASH_BITS - BUCKET_BITS)
    along = Window.partitionBy("source").orderBy("bucket")
    cuts = (
        sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        .withColumn("upto", F.sum("n").over(along))
        .select(F.col("source").alias("s"), "bucket", (F.col("upto") - F.col("n")).alias("before"), "upto")
        .join(goals, F.col("s").eqNullSafe(F.col("source")))
    )
    # buckets wholly taken lie before the cut; the first that is not holds it
    cut = (
        cuts.filter(F.col("upto") > F.col("rest"))
        .groupBy("s").agg(F.min(F.struct("bucket", "before")).alias("cut"))
        .select("s", F.col("cut.bucket").alias("cut_bucket"), F.col("cut.before").alias("before"))
    )
    goals = goals.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    goals = written(goals, "mix-goals")
    ordered = Window.partitionBy("source").orderBy("place")
    inside = (
        sized.join(goals.select(F.col("source").alias("s"), "cut_bucket", "before", "rest"),
                  F.col("source").eqNullSafe(F.col("s")) & (bucket == F.col("cut_bucket")))
        .groupBy("source", "place", "before", "rest").agg(F.sum("size").alias("n"))
        .withColumn("upto", F.sum("n").over(ordered) + F.col("before"))
        .filter(F.col("upto") - F.col("n") / 2 <= F.col("rest"))
        .groupBy("source").agg(F.max("place").alias("last"))
        .select(F.col("source").alias("s"), "last")
    )
    first_of_cut = F.shiftleft("cut_bucket", HASH_BITS - BUCKET_BITS) - 1
    return goals.join(inside, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "whole",
        # no cut: the rest is the whole source or more; no place inside the cut: all before it
        F.when(F.col("cut_bucket").isNull(), F.lit((1 << HASH_BITS) - 1))
        .otherwise(F.coalesce("last", first_of_cut)).alias("last"),
    )


def repetitions(whole: Column, place: Column, last: Column, size: Column) -> Column:
    return F.when(size > 0, whole + (place <= last).cast("long")).otherwise(F.lit(0).cast("long"))


def plan(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The written sizes of all documents, and the written rates of all sources."""
    sized = written(sizes(docs, seed), "mix-sizes")
    goals = written(targets(sized, weights, max_epochs), "mix-targets")
    return sized, written(rates(sized, goals), "mix-rates")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    sized, per = plan(docs, weights, max_epochs, seed)
    per = per.withColumnRenamed("source", "s")
    times = repetitions(F.col("whole"), F.col("place"), F.col("last"), F.col("size"))
    return sized.join(per, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; documents without words are not taken."""
    _, per = plan(docs, weights, max_epochs, seed)
    per = per.select(*(F.col(c).alias(f"__mix_{c}") for c in ("source", "whole", "last")))
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0))
    times = repetitions(F.col("__mix_whole"), order_hash(docs["doc_id"], docs["text"], seed), F.col("__mix_last"), size)
    joined = docs.join(per, docs["source"].eqNullSafe(F.col("__mix_source")))
    return joined.withColumn("__mix_n", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*docs.columns)


def oracle_sql(seed: int = SEED) -> str:
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS place
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight,
             source_size * 3.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM per),
f AS (SELECT *, sum(cap) OVER o - cap AS caps_before, sum(weight) OVER () - sum(weight) OVER o + weight AS weight_left
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
g AS (SELECT *, (total - caps_before) * weight > cap * weight_left AS clamped FROM f),
t AS (SELECT source, source_size, CASE WHEN clamped THEN cap ELSE
        (total - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER ()) * weight
        / sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER () END AS target FROM g),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT s.doc_id, s.size, s.source, s.place, r.source_size, r.target, r.whole,
             r.target - r.whole * r.source_size AS rest,
             sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place RANGE UNBOUNDED PRECEDING) AS upto,
             sum(s.size) OVER (PARTITION BY s.source, s.place) AS peers
      FROM sized s JOIN r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN upto - peers / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c"""
