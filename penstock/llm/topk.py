"""Exact top-k search with a vector-approximation file.

Components are integers, floor(256 * x). The approximation file keeps each
component's cell, the integer without its low bits. For a query, the cells alone
bound the inner product from both sides: within a cell a component moves by at most
2**CELL_BITS - 1. The scan of the file keeps, per query, the vectors whose upper
bound reaches the kth best lower bound seen. Then exact vectors are read in the
order of their bounds: first the k most promising ones, whose exact scores set the
bar, then all others whose bound still reaches it. After that the kth is certain.

Queries go in blocks of bounded size, each against the whole file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penstock.llm.common import dropped, staged, table

CELL_BITS = 2
#: Queries sent to the executors at a time, and vectors compared with them at a time.
BLOCK, ROWS = 2048, 1024


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """vec, tag, v: rows with an id and a vector without null or non-finite components, in integers."""
    sound = F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(F.col("vec").isNotNull() & F.col("x").isNotNull()).where(sound)
    v = F.transform("x", lambda c: F.floor(c * F.lit(float(scale))))
    return rows.select("vec", v.alias("v")).select("vec", F.xxhash64("v").alias("tag"), "v")


def _scan(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, cell_bits: int):
    """Vectors that may be among the k best of a query. queries: by dimension, ids and integer vectors."""
    slack = (1 << cell_bits) - 1
    ready = {
        size: (ids, (q.astype(np.float64) * (1 << cell_bits)).T.copy(), slack * np.minimum(q, 0).sum(1), slack * np.maximum(q, 0).sum(1))
        for size, (ids, q) in queries.items()
    }

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {size: np.full((k, len(x[0])), -np.inf) for size, x in ready.items()}
        for batch in batches:
            lists = batch.column("cells")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            vecs, tags = batch.column("vec").to_numpy(), batch.column("tag").to_numpy()
            for size in ready.keys() & set(sizes.tolist()):
                ids, turned, down, up = ready[size]
                of_size = np.flatnonzero(sizes == size)
                for some in (of_size[i : i + ROWS] for i in range(0, len(of_size), ROWS)):
                    cells = flat[offsets[some][:, None] + np.arange(size)].astype(np.float64)
                    base = cells @ turned
                    base[vecs[some][:, None] == ids[None, :]] = -np.inf
                    low = base + down
                    both = np.concatenate([best[size], low])
                    best[size] = np.partition(both, len(both) - k, axis=0)[len(both) - k :]
                    bar = best[size].min(axis=0)
                    r, q = np.nonzero((base + up >= bar) & np.isfinite(base))
                    if len(r):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[q]), pa.array(vecs[some][r]), pa.array(tags[some][r]), pa.array(low[r, q].astype(np.int64)),
                             pa.array((base[r, q] + up[q]).astype(np.int64))],
                            ["query", "vec", "tag", "low", "high"],
                        )

    return of


def _best(rows: DataFrame, k: int, by: str) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col(by).desc(), "vec", "tag")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _read(wanted: DataFrame, exact: DataFrame, queries: DataFrame) -> DataFrame:
    """query, vec, tag, score from the exact vectors."""
    q = queries.select(F.col("vec").alias("query"), F.col("v").alias("qv")).dropDuplicates(["query"])
    read = wanted.select("query", "vec", "tag").distinct().join(exact, ["vec", "tag"]).dropDuplicates(["query", "vec", "tag"]).join(q, "query")
    product = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return read.select("query", "vec", "tag", product.alias("score"))


def exact_top_k(
    vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", cell_bits: int = CELL_BITS
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products.

    Queries are the rows for which the column `is_query` (over `vec`) holds; candidates are all rows with
    another id. Ties go to the smaller id. Only vectors of the query's dimension
    are compared. Rows without id, without vector or with a null or non-finite
    component take no part; rows that repeat an id and a vector count once, and of
    a query id with several vectors one is taken. Fewer than k candidates give
    fewer rows, and an empty table none. Components must stay below 2**24 / 256 for
    the bounds to be exact.
    """
    spark = vectors.sparkSession
    exact = staged(integer_vectors(vectors, id_col, vector_col), "vectors")
    cells = staged(exact.select("vec", "tag", F.transform("v", lambda c: F.shiftright(c, cell_bits).cast("int")).alias("cells")), "cells")
    queries = exact.where(is_query)
    parts = []
    block: dict[int, np.ndarray] = {}

    def search(block: dict[int, np.ndarray]) -> DataFrame:
        by_size: dict[int, list[int]] = {}
        for key, v in block.items():
            by_size.setdefault(len(v), []).append(key)
        held = {n: (np.array(ids), np.array([block[i] for i in ids], np.int64).reshape(len(ids), n)) for n, ids in by_size.items()}
        own = queries.where(F.col("vec").between(min(block), max(block)))
        kept = staged(cells.mapInArrow(_scan(held, k, cell_bits), "query long, vec long, tag long, low long, high long"), "bounded")
        bar = _best(kept, k, "low").groupBy("query").agg(F.min("low").alias("bar"), F.count("*").alias("n"))
        bar = bar.select("query", F.when(F.col("n") == k, F.col("bar")).alias("bar"))
        kept2 = staged(kept.join(bar, "query").where("bar is null or high >= bar").drop("bar", "low"), "candidates")
        first = staged(_read(_best(kept2, k, "high"), exact, own), "first-read")
        bar = first.groupBy("query").agg(F.min("score").alias("bar"))
        rest = kept2.join(bar, "query").where("high >= bar").join(first.select("query", "vec", "tag"), ["query", "vec", "tag"], "left_anti")
        result = staged(_best(first.unionByName(_read(rest, exact, own)), k, "score").drop("tag"), "top-k")
        dropped(kept, kept2, first)
        return result

    for row in queries.orderBy("vec", "tag").toLocalIterator():
        if row.vec not in block and len(block) == BLOCK:
            parts.append(search(block))
            block = {}
        block.setdefault(row.vec, np.array(row.v, np.int64))
    if block:
        parts.append(search(block))
    out = parts[0] if parts else spark.createDataFrame([], "query long, vec long, score long, rank int")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("query").alias("query_id"), "rank", F.col("vec").alias("vec_id"), "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec") % 50 == 0)


OP9_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
