"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penstock.llm.common import staged, table

#: Weights of the sources in code point order, null last, repeating. Fixed values.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, target, rate, offset: one row per source of (source, size).

    All sizes together are shared by weight. No target exceeds `most` times its
    source's size; what is over goes to the others by weight, until none is above.
    Sources fill up in the order of cap over weight, so the level at which the rest
    share is found with running sums over the sources. Those windows see one row
    per source, never documents. `offset` is a number in [0, 1) drawn from the name.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * most)
    filling = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    upto = filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0)) + F.col("cap")
    others = F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")
    per = per.withColumn("level", left / others)
    open_ = F.col("cap") > F.col("level") * F.col("weight")
    per = per.withColumn("shared", F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), "source", "level"))).over(everything))
    level = F.col("shared.level")
    target = F.when(level.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), level * F.col("weight")))
    name = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("source"), F.lit("\x00"))))
    return per.select(
        "source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
        (F.conv(F.substring(name, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)).alias("offset"),
    )


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, tag (a hash of the text), source, size in words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"), F.xxhash64(text).alias("tag"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """doc_id, tag, source, size, source_size, target, copies, taken: one row per document.

    Every document of a source is expected `rate` = target / source size times. The
    documents of a source stand in the order of size (largest first), id and text hash; the
    prefix sum of expected copies is rate times rank, and a document is emitted
    once per integer between the sums before and after it, moved by the source's
    offset. As sizes fall along the order, taken words miss the target by no more
    than the largest document. `rate` is at most `most`, so no document is
    taken more often than `most` times when that is an integer.

    Ranks come from a range partitioning on (source, size, id): each slice ranks
    its own rows, and counts per slice and source, one row each, give the ranks
    before a slice. No window sees more than one slice, however large a source is.

    Null texts and empty ones have size 0 and are taken like others, for 0 words;
    null sources form one source; null ids rank first; repeated rows are documents
    of their own. Other columns are ignored. An empty table gives an empty result.
    """
    slim = staged(sized(docs), "mix-sizes")
    slices = max(docs.sparkSession.sparkContext.defaultParallelism, slim.rdd.getNumPartitions())
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id").asc_nulls_first(), F.col("tag")]
    dealt = staged(slim.repartitionByRange(slices, *order).withColumn("slice", F.spark_partition_id()), "mix-slices")
    targets = source_targets(dealt.select("source", "size"), weights, most)
    counts = dealt.groupBy("source", "slice").agg(F.count("*").alias("here"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("here").over(earlier), F.lit(0))).drop("here")
    facts = staged(
        counts.join(targets, counts.source.eqNullSafe(targets.source)).select(
            counts.source.alias("of"), F.col("slice").alias("at"), "before", "source_size", "target", "rate", "offset"
        ),
        "mix-facts",
    )
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("slice", "source").orderBy(*order)))
    joined = ranked.join(facts, (ranked.slice == facts["at"]) & ranked.source.eqNullSafe(facts["of"]))
    upper = F.floor((F.col("before") + F.col("rank")) * F.col("rate") + F.col("offset"))
    lower = F.floor((F.col("before") + F.col("rank") - 1) * F.col("rate") + F.col("offset"))
    return joined.withColumn("copies", upper - lower).select(
        "doc_id", "tag", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH RECURSIVE s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s GROUP BY source),
w AS (SELECT source, source_size, 3 * source_size AS cap, ([5, 2, 1])[((k - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM p),
f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT first(level ORDER BY cap / weight, source NULLS LAST) FILTER (cap > level * weight) AS level FROM f),
t AS (
  SELECT source, source_size, CASE WHEN l.level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, l.level * weight) END AS target,
         ('0x' || substr(md5('mix:' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM f, l),
r AS (
  SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY size DESC, doc_id NULLS FIRST) AS rank
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rank * rate + u) - floor((rank - 1) * rate + u)) * size)::BIGINT AS taken FROM r
"""
