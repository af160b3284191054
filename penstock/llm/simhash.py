"""SimHash near-dedup with pigeonring filtering.

Fingerprints of equal value are one node. The 64 bits form a ring of 16 segments.
Two fingerprints that differ in at most `max_diff` bits have a segment from which
the differences along the ring never exceed their share: over l segments at most
l * max_diff / 16. For l up to 7 (and 2 bits) that share is below one, so the chain
of 7 segments is equal and serves as the join key; the longer chains are checked on
the joined pair before the full Hamming check. Keys that occur once are pruned
before anything is joined.

A key held by many fingerprints (a large group of near copies) isn't joined with
itself. Its members meet at common values instead: two fingerprints differ in at
most two bits exactly when both come to one value by flipping at most one bit each.
That costs 65 rows per member, links all of them through one of each value's, and
loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm.common import NO_ID, dropped, keyed, shown_id, staged, table

BITS, SEGMENTS = 64, 16
#: Node ids from here on stand for fingerprints of rows without an id.
NAMELESS = 2**62
#: Fingerprints of one key from which they meet at flipped values, not in pairs.
DENSE = 32
#: Of so many documents one is counted to find common shingles, and the number of those, at most. Both decide on an order only.
SAMPLED, COMMON = 8, 500_000


def _fingerprints(shingle: int, seed: int):
    digest = xxhash.xxh64_intdigest

    def bits(text: bytes) -> int:
        words = text.lower().split()
        if not words:
            return 0
        line = b" ".join(words)
        stops = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *stops[: max(0, len(words) - shingle)]]
        hashes = [digest(line[a : b - 1], seed) for a, b in zip(starts, stops[min(shingle, len(words)) - 1 :], strict=True)]
        ones = np.zeros(BITS, np.int64)
        for k in range(0, len(hashes), 65_536):
            some = np.array(hashes[k : k + 65_536], ">u8")
            ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            values = [bits(texts[i].as_buffer().to_pybytes()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("tag"), pa.array(values, pa.int64())], ["doc", "tag", "print"]
            )

    return of


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc, tag, print (a signed long) for keyed rows: the majority of the XXH64 bits of all shingles."""
    return docs.mapInArrow(_fingerprints(shingle, seed), "doc long, tag long, print long")


def _turned(by: int) -> Column:
    value = F.col("print")
    return value if by == 0 else F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, BITS - by))


def _on_ring(max_diff: int) -> Column:
    """Whether every chain of the difference x from segment s on stays within its share; the last is the Hamming check."""
    wide = BITS // SEGMENTS
    turned = F.expr(f"shiftleft(x, int(s * {wide})) | if(s = 0, 0L, shiftrightunsigned(x, int({BITS} - s * {wide})))")
    holds = F.lit(True)
    for chain in range(1, SEGMENTS + 1):
        inside = F.bit_count(F.shiftrightunsigned(turned, BITS - chain * wide))
        holds = holds & (inside <= chain * max_diff // SEGMENTS)
    return holds


def near_links(nodes: DataFrame, max_diff: int = 2) -> DataFrame:
    """a, b: node ids that connect all fingerprints (`print`, `node`, each print once) at `max_diff` bits or fewer."""
    if max_diff not in (1, 2):
        raise ValueError("max_diff is 1 or 2")
    wide = BITS // SEGMENTS
    equal = max(l for l in range(1, SEGMENTS) if l * max_diff // SEGMENTS == 0)  # noqa: E741
    keep = BITS - equal * wide
    keys = F.array(*[F.struct(F.lit(s).alias("s"), F.shiftrightunsigned(_turned(s * wide), keep).alias("key")) for s in range(SEGMENTS)])
    probes = nodes.select("print", "node", F.explode(keys).alias("k")).select("k.s", "k.key", "print", "node")
    held = staged(probes.groupBy("s", "key").agg(F.count("*").alias("n")).where("n > 1"), "ring-keys")
    busy = staged(probes.join(held, ["s", "key"]), "ring-busy")

    few = busy.where(F.col("n") < DENSE)
    left = few.select("s", "key", F.col("print").alias("p"), F.col("node").alias("a"))
    right = few.select("s", "key", F.col("print").alias("q"), F.col("node").alias("b"))
    pairs = left.join(right, ["s", "key"]).where("p < q").withColumn("x", F.col("p").bitwiseXOR(F.col("q")))
    pairs = pairs.where(_on_ring(max_diff)).select("a", "b")

    dense = busy.where(F.col("n") >= DENSE).select("print", "node").distinct()
    flips = [F.lit(0).cast("long"), *[F.lit(int(np.int64(np.uint64(1 << b)) if b < 63 else -(2**63))) for b in range(BITS)]]
    if max_diff == 2:
        met = dense.select("node", F.explode(F.transform(F.array(*flips), lambda f: F.col("print").bitwiseXOR(f))).alias("value"))
    else:  # at one bit: equal once that bit is taken out
        masks = F.transform(F.array(*flips[1:]), lambda f: F.struct(f.alias("bit"), F.col("print").bitwiseAND(F.bitwise_not(f)).alias("rest")))
        met = dense.select("node", F.explode(masks).alias("value"))
    met = staged(met, "ring-met")
    middle = staged(met.groupBy("value").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"), "ring-middle")
    stars = met.join(middle, "value").where("node != b").select(F.col("node").alias("a"), "b")
    out = staged(pairs.unionByName(stars).distinct(), "near-links")
    dropped(held, busy, met, middle)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each linked node reaches.

    Rounds of large and small stars: every node hands its larger neighbours, then
    its smaller ones, to the smallest. The number of rounds grows with the logarithm
    of the longest path. Minima come pre-aggregated, and a hot node's links are split
    at the join.
    """
    now = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    before = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = staged(both.groupBy("u").agg(F.min("v").alias("low")), "star-low")
        large = staged(
            both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.least("u", "low").alias("b")).where("a != b").distinct(), "large-star"
        )
        dropped(low)
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = staged(down.groupBy("u").agg(F.min("v").alias("low")), "star-low")
        handed = down.join(low, "u").select(F.col("v").alias("a"), F.col("low").alias("b"))
        kept = low.select(F.col("u").alias("a"), F.col("low").alias("b"))
        small = staged(handed.unionByName(kept).where("a != b").distinct(), "small-star")
        total = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(low, large, now)
        now = small
        if total == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = total


def near_duplicates(docs: DataFrame, shingle: int = 3, max_diff: int = 2, seed: int = 42) -> DataFrame:
    """doc, tag, print, component for keyed rows; component is the smallest id reachable over links.

    Rows of one id are one document: what either links to, the other reaches. Texts
    without words have fingerprint zero and link like others. Rows with a null id
    link as well but name no component; one that reaches no id gets a component of
    at least NAMELESS. Ids are below that. An empty table gives an empty result.
    """
    prints = staged(fingerprints(docs, shingle, seed), "fingerprints")
    named = F.when(F.col("doc") != NO_ID, F.col("doc"))
    nameless = F.lit(NAMELESS).bitwiseOR(F.shiftrightunsigned("print", 2))
    nodes = staged(prints.groupBy("print").agg(F.min(named).alias("node")).select("print", F.coalesce("node", nameless).alias("node")), "nodes")
    links = near_links(nodes, max_diff)
    ids = prints.where(F.col("doc") != NO_ID).join(nodes, "print").where("doc != node").select(F.col("doc").alias("a"), F.col("node").alias("b"))
    several = prints.where(F.col("doc") != NO_ID).groupBy("doc").agg(F.count_distinct("print").alias("n")).where("n > 1").select("doc")
    twice = ids.join(several, F.col("a") == F.col("doc"), "left_semi").distinct()  # ids of several texts tie their fingerprints
    roots = components(links.unionByName(twice))
    labels = staged(nodes.join(roots, "node", "left").select("print", F.coalesce("root", "node").alias("component")), "components")
    dropped(nodes, links)
    return prints.join(labels, "print")


def _views(shingle: int, per_view: int, views: int):
    """(doc, view): fingerprints of small fixed parts of each document's set of shingles."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, out = [], []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                hashes = _shingles(text.as_buffer().to_pybytes(), shingle)
                if not len(hashes):
                    continue
                level = max(0.0, float(np.log2(len(hashes) / per_view)))
                # sets that are 0.8 alike differ in size by a third of a level at most
                for parts in {int(level + 0.17), int(level + 0.51)}:
                    of_view = hashes & np.uint64((1 << parts) - 1)
                    for view in range(min(views, 1 << parts)):
                        mine = hashes[of_view == view]
                        if len(mine):
                            docs.append(doc)
                            out.append(xxhash.xxh64_intdigest(mine.tobytes(), parts << 8 | view))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc", "view"])

    return of


def _shingles(text: bytes, shingle: int) -> np.ndarray:
    """The sorted set of a text's shingle hashes; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1))], np.uint64))


def _alike(shingle: int, similarity: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a, b = (_shingles(batch.column(c)[i].as_buffer().to_pybytes(), shingle) for c in ("text_a", "text_b"))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return of


def _sets(shingle: int):
    """(key): the shingles of each document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(_shingles(text.as_buffer().to_pybytes(), shingle).view(np.int64))], ["key"])

    return of


def _prefixes(shingle: int, similarity: float, common):
    """(doc, key, size, rest): the first shingles of each document, its number of shingles, and how many there are from this one on.

    The order is by hash, with the common ones (sorted, with their ranks) last.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = common.value
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                keys = _shingles(text.as_buffer().to_pybytes(), shingle)
                n = len(keys)
                if not n:
                    continue
                if len(known):
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    keys = keys[np.lexsort((keys, np.where(known[at] == keys, ranks[at], -1)))]
                first = n - ceil(similarity * n - 1e-6) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(first, doc)), pa.array(keys[:first].view(np.int64)), pa.array(np.full(first, n)), pa.array(n - np.arange(first))],
                    ["doc", "key", "size", "rest"],
                )

    return of


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, per_view: int = 4, views: int = 12) -> DataFrame:
    """node, root: documents whose sets of `shingle` words are `similarity` alike, by groups; all such links count.

    For keyed rows of one text per id. Two routes. The first links large groups at low cost: the set of
    shingles is dealt into parts of about `per_view` by their hashes, and within a group of equal parts each document is
    compared with one leader. Grouped documents leave, but for one, and the rest choose new leaders, until a round
    groups none. It finds most links, at no certainty.
    The second is exact: in a common order of all shingles, of two sets that are `similarity` alike each has one
    of the other's among its first n - similarity * n + 1. Documents that meet at one of these, and are not in
    one group yet, are compared over whole texts, unless their sizes or what follows rule it out.
    """
    probes = staged(docs.mapInArrow(_views(shingle, per_view, views), "doc long, view long"), "views")
    held = staged(probes.groupBy("view").agg(F.count_distinct("doc").alias("n")).where("n > 1").select("view"), "views-shared")
    alive = staged(probes.join(held, "view").select("doc", "view"), "views-alive")
    texts = staged(docs.join(alive.select("doc").distinct(), "doc", "left_semi").select("doc", "text"), "view-texts")
    dropped(probes, held)
    links, turn = [], 0
    while True:
        order = F.struct(F.xxhash64("doc", F.lit(turn)).alias("h"), "doc") if turn else F.struct("doc")
        leaders = staged(alive.groupBy("view").agg(F.min(order).alias("first")).select("view", F.col("first.doc").alias("b")), "leaders")
        pairs = staged(alive.join(leaders, "view").where("doc != b").select(F.col("doc").alias("a"), "b").distinct(), "leader-pairs")
        sides = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
        sides = sides.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
        found = staged(sides.mapInArrow(_alike(shingle, similarity), "a long, b long"), "similar")
        dropped(leaders, pairs)
        if not found.take(1):
            break
        links.append(found)
        gone = components(found).select(F.col("node").alias("doc"))
        rest = staged(alive.join(gone, "doc", "left_anti"), "views-alive")
        dropped(alive)
        alive, turn = rest, turn + 1
    every = found
    for link in links:
        every = every.unionByName(link)
    groups = staged(components(every), "leader-groups")
    exact = _exact_links(docs, groups, similarity, shingle)
    out = components(every.unionByName(exact))
    dropped(texts, alive, found, groups, exact, *links)
    return out


def _exact_links(docs: DataFrame, groups: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """a, b: all documents that are `similarity` alike and not in one of `groups` (node, root) yet."""
    spark = docs.sparkSession
    some = docs.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(SAMPLED)) == 0)
    often = some.mapInArrow(_sets(shingle), "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    often = often.orderBy(F.col("n").desc(), "key").limit(COMMON).toArrow()["key"].to_numpy().view(np.uint64)[::-1]
    by = np.argsort(often)
    common = spark.sparkContext.broadcast((often[by], by))
    probes = staged(docs.mapInArrow(_prefixes(shingle, similarity, common), "doc long, key long, size long, rest long"), "prefixes")
    shared = staged(probes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "prefixes-shared")
    roots = groups.select(F.col("node").alias("doc"), "root")
    met = staged(probes.join(shared, "key").join(roots, "doc", "left").withColumn("root", F.coalesce("root", "doc")), "prefixes-met")
    left, right = (met.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("doc", "size", "rest", "root")]) for side in "ab")
    least = F.ceil((F.col("size_a") + F.col("size_b")) * (similarity / (1 + similarity)) - 1e-6)
    # each pair once, the smaller set first; at the first shingle they share all others follow
    ordered = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("doc_a") < F.col("doc_b")))
    holds = ordered & (F.col("root_a") != F.col("root_b")) & (F.col("size_a") >= F.col("size_b") * similarity - 1e-6) & (F.least("rest_a", "rest_b") >= least)
    pairs = staged(left.join(right, "key").where(holds).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct(), "prefix-pairs")
    # of the texts, those of the pairs alone are dealt out twice
    paired = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    texts = staged(docs.join(paired, "doc", "left_semi").select("doc", "text"), "pair-texts")
    sides = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    sides = sides.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    out = staged(sides.mapInArrow(_alike(shingle, similarity), "a long, b long"), "exact-links")
    dropped(probes, shared, met, pairs, texts)
    return out


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(keyed(table(spark, sf_dir, "documents")))
    return found.select(
        shown_id().alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("component") < NAMELESS, F.col("component")).alias("component_id")
    )
