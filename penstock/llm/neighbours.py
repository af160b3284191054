"""Embedding near-dedup with collision-counting projections.

Unit vectors are projected onto many random lines. Along a line a vector matters only
where it lies far out: each keeps the lines on which its projection is largest, a fixed
number of them, so the sorted lists hold their ends and windows there are thin. A window of
fixed width is centred on each kept value; two vectors collide on a line when each lies
in the other's window. Pairs that collide often enough are verified by their cosine.

How often is enough comes from a simulation of two vectors that are exactly `least` alike:
the highest count that at least a share `recall` of such pairs reaches. Projections on
random lines depend on nothing but the angle, so the share holds for any data.

A pair is counted where it first collides, from the lines both carry with them, so pairs are
never written out or shuffled. Lists of one line and label that grow beyond a block are cut into
blocks, and each two of these meet in a task of their own. What leaves a task is a
count per vector and a spanning set of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm.common import dropped, staged, table
from penstock.llm.simhash import components

LEAST = 0.93
#: Lines, lines that a vector keeps, and the share of pairs at the least cosine to be found.
LINES, KEPT, RECALL = 4096, 24, 0.995
#: Vectors of one list that are compared at a time, and pairs that are counted at a time.
BLOCK, PAIRS = 1024, 20_000
SEED = 13
#: What the vectors of one list, or of two blocks of it, have in common.
GROUP = ["g", "end", "i", "j"]


def directions(size: int, lines: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, lines))


def window(least: float) -> float:
    """Half the width of a window: 2.5 deviations of the difference at the least cosine, and its drift at the ends."""
    return 2.5 * (2 - 2 * least) ** 0.5 + 4 * (1 - least)


def enough(least: float, lines: int, kept: int, recall: float) -> int:
    """The number of collisions that a share `recall` of pairs reaches whose cosine is `least`; one at least."""
    draw = np.random.default_rng(SEED)
    counts = []
    for _ in range(4000):
        x = draw.standard_normal(lines)
        y = least * x + (1 - least * least) ** 0.5 * draw.standard_normal(lines)
        both = np.intersect1d(np.argpartition(-np.abs(x), kept)[:kept], np.argpartition(-np.abs(y), kept)[:kept])
        counts.append(int((np.abs(x[both] - y[both]) <= window(least)).sum()))
    return max(1, int(np.sort(counts)[int((1 - recall) * len(counts))]))


def _ends(lines: int, kept: int):
    """The lines that each vector keeps, rising, and its values on them. A line has two ends: 2 * i and 2 * i + 1."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column("x")
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            ends, values = np.zeros((batch.num_rows, kept), np.int32), np.zeros((batch.num_rows, kept), np.float32)
            for size in np.unique(sizes):
                if size not in known:
                    known[size] = directions(int(size), lines)
                rows = np.flatnonzero(sizes == size)
                for some in (rows[i : i + 1024] for i in range(0, len(rows), 1024)):
                    x = flat[offsets[some][:, None] + np.arange(size)].astype(np.float64)
                    p = _unit(x) @ known[size]
                    at = np.sort(np.argpartition(-np.abs(p), kept - 1, axis=1)[:, :kept], axis=1)
                    p = np.take_along_axis(p, at, axis=1)
                    ends[some], values[some] = 2 * at + (p < 0), np.abs(p)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), kept) for a in (ends, values)]
            lists = [a.cast(pa.list_(a.type.value_type)) for a in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "ends", "values"])

    return of


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, without overflow or underflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Vectors:
    """Some rows of one batch as arrays."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        self.group = np.column_stack([batch.column(c).to_numpy() for c in GROUP])
        self.end, self.own = batch.column("end").to_numpy(), batch.column("block").to_numpy()
        self.node, self.weight = batch.column("node").to_numpy(), batch.column("n").to_numpy()
        self.ends, self.values = (self._matrix(batch.column(c)) for c in ("ends", "values"))
        self.x = batch.column("x")

    @staticmethod
    def _matrix(column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        taken = self.x.take(pa.array(rows))
        return _unit(self._matrix(taken).astype(np.float64))


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within groups of consecutive rows, PAIRS or so at a time."""
    n = int(sizes.sum())
    stops = np.repeat(starts + sizes, sizes)
    after = stops - np.arange(starts[0], starts[0] + n) - 1  # rows of the group that follow each row
    upto = np.cumsum(after)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        some = after[at:to]
        a = np.repeat(np.arange(at, to), some)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(some) - some, some)
        if len(a):
            yield a + starts[0], b + starts[0]
        at = to


def _bits(ends: np.ndarray, lines: int) -> np.ndarray:
    """Per row a bit for each end that it keeps."""
    out = np.zeros((len(ends), -(-2 * lines // 64)), np.uint64)
    for at in range(0, len(ends), 2048):
        some = ends[at : at + 2048]
        flags = np.zeros((len(some), out.shape[1] * 64), bool)
        np.put_along_axis(flags, some.astype(np.int64), True, axis=1)
        out[at : at + len(some)] = np.packbits(flags, axis=1).view(np.uint64)
    return out


def _links(least: float, wide: float, count: int, lines: int):
    """(node, n, root): per group and vector, the copies of other vectors it links to, and the least node of its links there."""

    def linked(v: _Vectors) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        change = np.flatnonzero(np.any(v.group[1:] != v.group[:-1], axis=1)) + 1
        starts = np.concatenate([[0], change])
        sizes = np.diff(np.concatenate([starts, [len(v.group)]]))
        bits = _bits(v.ends, lines)
        for a, b in _pairs(starts, sizes):
            apart = (v.group[a, 2] == v.group[a, 3]) | (v.own[a] != v.own[b])  # two blocks meet each other, not themselves
            # no more windows can hold a pair than it has ends in common
            apart &= np.bitwise_count(bits[a] & bits[b]).sum(axis=1) >= count
            a, b = a[apart], b[apart]
            if not len(a):
                continue
            same = v.ends[a][:, :, None] == v.ends[b][:, None, :]
            p, i, j = np.nonzero(same)
            near = np.abs(v.values[a[p], i] - v.values[b[p], j]) <= wide
            p, i = p[near], i[near]
            n = np.bincount(p, minlength=len(a))
            first = np.full(len(a), np.iinfo(np.int32).max, np.int32)
            np.minimum.at(first, p, v.ends[a[p], i])
            often = np.flatnonzero((n >= count) & (first == v.end[a]))
            if len(often):
                a, b = a[often], b[often]
                cosine = np.einsum("ij,ij->i", v.vectors(a), v.vectors(b))
                yield a[cosine >= least], b[cosine >= least]

    def of_whole_groups(batch: pa.Table) -> pa.RecordBatch | None:
        v = _Vectors(batch)
        found = [ab for ab in linked(v) if len(ab[0])]
        if not found:
            return None
        a, b = (np.concatenate(side) for side in zip(*found, strict=True))
        n = np.bincount(a, v.weight[b], len(v.node)) + np.bincount(b, v.weight[a], len(v.node))
        root = np.arange(len(v.node))
        while True:  # the first row of the links around each row
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        rows = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(v.node[rows]), pa.array(n[rows].astype(np.int64)), pa.array(v.node[root[rows]])], ["node", "n", "root"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in GROUP]
            last = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0  # where the last group of the batch begins
            if held and not cut and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in GROUP):
                held.append(batch)
                continue
            if (out := of_whole_groups(pa.Table.from_batches([*held, batch.slice(0, cut)]))) is not None:
                yield out
            held = [batch.slice(cut)]
        if held and (out := of_whole_groups(pa.Table.from_batches(held))) is not None:
            yield out

    return of


def near_neighbours(
    vectors: DataFrame, least: float = LEAST, lines: int = LINES, kept: int = KEPT, recall: float = RECALL, block: int = BLOCK,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec, n_links, component: one row per row of `vectors`; pairs of one label and length link at a cosine of `least`.

    Null, empty and zero vectors and such with null or non-finite components link with nothing, and
    neither do rows without a label or an id. Equal vectors of a label are one node and link with each
    other; ties do not arise, and rows that repeat an id are links of each other only if
    their vectors link. Rows of one id are one member of a component. An empty table
    gives an empty result. Of pairs at the least cosine a share of `recall` is found, of closer ones more, and none
    below it. For a label of far over 10**6 vectors raise `lines`: lists shrink as it grows, at the same `kept`.
    """
    ok = F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c)) & F.exists("x", lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    usable = F.coalesce(ok & F.col("vec").isNotNull() & F.col("label").isNotNull(), F.lit(False))
    # vectors of one node are equal in 128 bits of their label and components
    plain = F.transform("x", lambda c: c + 0.0)  # one zero
    key = F.concat_ws(" ", F.xxhash64("label", plain), F.xxhash64(F.lit("second"), plain, "label"))
    known = staged(rows.select("vec", F.when(usable, key).alias("key"), F.when(usable, F.col("label")).alias("label"), F.when(usable, F.col("x")).alias("x")), "vectors")
    nodes = known.where("key is not null").groupBy("key").agg(F.min("vec").alias("vec"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("x").alias("x"))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("g", F.xxhash64("label", F.size("x")))
    shape = "key string, vec long, n long, label string, x array<double>, node long, g long, ends array<int>, values array<float>"
    nodes = staged(nodes.mapInArrow(_ends(lines, kept), shape), "ends")

    # lists of one label and end that hold more than one node, and the blocks they need
    posts = nodes.select("node", "g", F.explode("ends").alias("end"))
    lists = posts.groupBy("g", "end").agg(F.count("*").alias("m")).where("m > 1")
    met = posts.join(lists.withColumn("blocks", F.ceil(F.col("m") / block)), ["g", "end"]).withColumn("block", F.pmod(F.xxhash64("node", "end"), F.col("blocks")))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    met = met.withColumn("other", F.explode(others)).select(
        "node", "g", "end", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    met = met.join(nodes.select("node", "n", "x", "ends", "values"), "node")
    met = met.select(*GROUP, "block", "node", "n", "x", "ends", "values").repartition(*GROUP).sortWithinPartitions(*GROUP, "node")
    found = staged(met.mapInArrow(_links(least, window(least), enough(least, lines, kept, recall), lines), "node long, n long, root long"), "links")

    counts = found.groupBy("node").agg(F.sum("n").alias("links"))
    ids = nodes.select("node", "vec")
    edges = found.where("node != root").select("node", "root").distinct()
    edges = edges.join(ids.select("node", F.col("vec").alias("a")), "node").join(ids.select(F.col("node").alias("root"), F.col("vec").alias("b")), "root").select("a", "b")
    # an id with several vectors ties their nodes together
    tied = known.where("key is not null").join(nodes.select("key", F.col("vec").alias("b")), "key").where("vec != b").select(F.col("vec").alias("a"), "b").distinct()
    several = known.where("key is not null").groupBy("vec").agg(F.count_distinct("key").alias("m")).where("m > 1").select(F.col("vec").alias("a"))
    roots = components(edges.unionByName(tied.join(several, "a", "left_semi")))
    per = nodes.join(counts, "node", "left").join(roots.withColumnRenamed("node", "vec"), "vec", "left")
    per = staged(per.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "vec").alias("component")), "node-links")
    out = known.select("vec", "key").join(per, "key", "left").select("vec", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec").alias("component"))
    out = staged(out, "neighbours")
    dropped(known, nodes, found, per)
    return out


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_neighbours(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("vec").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec") == F.col("component"), F.lit(False)).alias("kept"))
