"""Joins and ordered look-backs that hold when one key owns a third of all rows.

A hot key is one with at least `hot_rows` rows. There can be no more than
(all rows / hot_rows) of them, which is what makes broadcasting their list safe
at any data size. Everything else about a hot key is spread over many tasks;
nothing is sampled, capped or dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstock.session import staged

HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with at least `hot_rows` rows and the number of parts to cut each into."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return splits_of(counted, keys, hot_rows)


def splits_of(
    counted: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, also: Sequence[str] = ()
) -> DataFrame:
    """As `hot_keys`, from a frame that already has one row per key and its count `_n`.

    `also` names measures of that frame that are never null. Asking for them here
    keeps them in the aggregate, which makes its shuffle the same as that of the join
    that needs the measures, so Spark runs it once.
    """
    hot = F.col("_n") >= hot_rows
    for measure in also:
        hot = hot & F.col(measure).isNotNull()
    return counted.filter(hot).select(*keys, parts(hot_rows).alias("_splits"))


def parts(hot_rows: int) -> Column:
    """Number of parts for a key of `_n` rows."""
    return F.when(F.col("_n") >= hot_rows, F.floor(F.col("_n") / hot_rows) + 1).otherwise(1).cast("int")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread: Sequence[str],
    hot: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Shuffle join in which the left rows of a hot key are cut into parts.

    `right` repeats its rows of a hot key once per part, and only those rows; it may
    bring the number of parts along as `_splits`.
    `spread` names left columns that tell rows of one key apart; their hash picks
    the part, so a recomputed task picks the same one. `how` is inner, left,
    left_semi or left_anti.
    """
    on = list(on)
    hot = F.broadcast(hot if hot is not None else hot_keys(left, on, hot_rows))
    any_null = F.lit(False)
    for key in on:
        any_null = any_null | F.col(key).isNull()
    part = F.when(any_null, F.pmod(F.xxhash64(*spread), F.lit(4096)).cast("int")).otherwise(
        F.pmod(F.xxhash64(*spread), F.coalesce("_splits", F.lit(1))).cast("int")
    )
    cut = left.join(hot, on, "left").withColumn("_part", part).drop("_splits")
    sized = right if "_splits" in right.columns else right.join(hot, on, "left")
    copies = sized.withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1))
    ).drop("_splits")
    return cut.join(copies, [*on, "_part"], how).drop("_part")


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    slice_of: Column,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add `name`: the last non-null `value` strictly before each row within its key.

    A hot key is cut into slices by `slice_of`, a BIGINT that rises with the order;
    all other keys are one slice. Each window task sees one slice. The last value of
    every slice is carried to the later ones over a frame with one row per slice of
    a hot key, which is empty, and skipped at run time, when no key is hot.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(df, keys, hot_rows))
    marked = df.withColumn("_value", value)
    sliced = marked.join(hot, keys, "left").withColumn(
        "_slice", F.when(F.col("_splits").isNotNull(), slice_of)
    ).drop("_splits")
    inside = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = sliced.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    per_slice = (
        marked.join(hot, keys, "inner")
        .withColumn("_slice", slice_of)
        .groupBy(*keys, "_slice")
        .agg(
            F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_last")
        )
    )
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(
        *keys, "_slice", F.last("_last", ignorenulls=True).over(across).alias("_carried")
    )
    return (
        local.join(carried, [*keys, "_slice"], "left")
        .withColumn(name, F.coalesce("_local", "_carried"))
        .drop("_value", "_local", "_carried", "_slice")
    )


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str = "slices") -> DataFrame:
    """The rows as a staged table, cut in the order of keys and `order` into slices of about equal size.

    `_slice` rises with that order. A key with all rows in one instant is cut like any other, as
    long as `order` tells its rows apart.
    """
    columns = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return staged(ranged.withColumn("_slice", F.spark_partition_id().cast("bigint")), label)


def spanning_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of the first and the last row of each slice: no other key has rows in two slices.

    There are two per slice, whatever the number of keys or rows.
    """
    ends = rows.groupBy("_slice").agg(F.min(F.struct(*keys)).alias("_a"), F.max(F.struct(*keys)).alias("_b"))
    return ends.select(F.explode(F.array("_a", "_b")).alias("_k")).select("_k.*").distinct()


def on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join with a small `right` (two rows per slice at most) in which null keys meet; its key columns are left out."""
    named = F.broadcast(right.select(*[F.col(c).alias(f"_of_{c}") if c in keys else F.col(c) for c in right.columns]))
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    return left.join(named, same, how).drop(*[f"_of_{key}" for key in keys])


def previous_in_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Add `name`: the last non-null `value` strictly before each row within its key.

    One scan of `df` sorts it into slices; each window sees one key in one slice. The last
    values of the keys that span slices, a table of two rows per slice, are carried on.
    """
    keys = list(keys)
    rows = sliced(df.withColumn("_value", value), keys, order)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    last = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_last")
    per_slice = on_keys(rows, spanning_keys(rows, keys), keys, "inner").groupBy(*keys, "_slice").agg(last)
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(*keys, "_slice", F.last("_last", ignorenulls=True).over(across).alias("_carried"))
    return (
        on_keys(local, carried, [*keys, "_slice"], "left")
        .withColumn(name, F.coalesce("_local", "_carried"))
        .drop("_value", "_local", "_carried", "_slice")
    )
