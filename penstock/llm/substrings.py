"""Substring dedup by seed and extend.

A repeated passage of `length` words shares at least one winnowed anchor (a short
gram that is the smallest in its neighbourhood) with its earlier copy, at the same
place. So:

1. Seed: anchors are counted over all documents; those that occur once are dropped.
2. Extend: the words that any window through an anchor can reach, to the left and
   to the right, are compared as one class. In a class all but the first occurrence
   repeat the whole reach. Classes meet their first member, never each other's
   members pair by pair, so thousands of copies cost as many rows.
3. The first members of different classes around one anchor may still agree in
   part. Their windows through the anchor are compared one by one, again with the
   first occurrence only.
4. Touching windows of a document make one maximal repeat.

Hashes pair two independent 64-bit values, so a false match needs 128 bits to agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm.common import (
    SpanHashes, WordHashes, dropped, hashed, keyed, mixed, shown_id, sliding, staged, table, word_chunks,
)

#: Words of a repeat, and of an anchor within it.
LENGTH, GRAM = 20, 8


class _Chunk:
    """Word positions of some documents laid end to end, and the hashes of their spans."""

    def __init__(self, lists: list[list[bytes]], cache: WordHashes):
        self.sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.n = int(self.ends[-1])
        self.spans = SpanHashes(hashed(lists, cache, self.n))
        self.row = np.repeat(np.arange(len(lists)), self.sizes)

    def whole(self, length: int) -> np.ndarray:
        """For each start of `length` words: whether they lie in one document."""
        starts = np.arange(self.n - length + 1)
        return self.ends[self.row[starts]] >= starts + length

    def grams(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all grams, and for each window the smallest gram in it (0 across documents)."""
        at = np.arange(self.n - gram + 1)
        hashes = self.spans(at, at + gram) | np.uint64(1)
        smallest = sliding(hashes, length - gram + 1, np.minimum)
        return hashes, np.where(self.whole(length), smallest, np.uint64(0))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _anchors(length: int, gram: int, keys_only: bool):
    reach, width = length - gram, length - gram + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            docs, tags = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("tag").to_numpy(zero_copy_only=False)
            for rows, lists in word_chunks(batch):
                chunk = _Chunk(lists, cache)
                if chunk.n < length:
                    continue
                hashes, smallest = chunk.grams(length, gram)
                edge = np.zeros(width - 1, np.uint64)
                at = np.flatnonzero(hashes == sliding(np.concatenate([edge, smallest, edge]), width, np.maximum))
                key = hashes[at]
                if keys_only:
                    yield pa.RecordBatch.from_arrays([_signed(key)], ["key"])
                    continue
                row = chunk.row[at]
                left, right = np.minimum(at - chunk.starts[row], reach), np.minimum(chunk.ends[row] - at, gram + reach)
                reached = chunk.spans(at - left, at + right)
                sides = (left * (length + gram) + right).astype(np.uint64)
                row_at = np.asarray(rows)[row]
                yield pa.RecordBatch.from_arrays(
                    [_signed(key), _signed(mixed(reached + sides * np.uint64(0x9E3779B97F4A7C15))), pa.array(docs[row_at]),
                     pa.array(tags[row_at]), pa.array((at - chunk.starts[row]).astype(np.int32))],
                    ["key", "reach", "doc", "tag", "pos"],
                )

    return of


def _windows(length: int, gram: int):
    """The windows through the given anchors of each document."""
    width = length - gram + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            docs, tags = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("tag").to_numpy(zero_copy_only=False)
            anchors = batch.column("anchors")
            for rows, lists in word_chunks(batch):
                chunk = _Chunk(lists, cache)
                if chunk.n < length:
                    continue
                marks = np.zeros(chunk.n + 1, np.int64)
                for k, row in enumerate(rows):
                    at = np.unique(anchors[row].values.to_numpy(zero_copy_only=False)) + chunk.starts[k]
                    first = np.maximum(at - width + 1, chunk.starts[k])
                    np.add.at(marks, first, 1)
                    np.add.at(marks, at + 1, -1)
                _, smallest = chunk.grams(length, gram)
                inside = np.cumsum(marks)[: len(smallest)] > 0
                at = np.flatnonzero(inside & (smallest > 0))
                row = chunk.row[at]
                row_at = np.asarray(rows)[row]
                yield pa.RecordBatch.from_arrays(
                    [_signed(smallest[at]), _signed(chunk.spans(at, at + length)), pa.array(docs[row_at]), pa.array(tags[row_at]),
                     pa.array((at - chunk.starts[row]).astype(np.int32))],
                    ["key", "window", "doc", "tag", "pos"],
                )

    return of


def repeat_marks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc, tag, anchors, windows: where repeats lie in each document that has any.

    `docs` are keyed rows. `windows` holds starts of windows that also start
    earlier; `anchors` holds anchors all of whose windows do.
    """
    emitted = "key long, reach long, doc long, tag long, pos int"
    repeated = staged(
        docs.mapInArrow(_anchors(length, gram, True), "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"),
        "anchors-repeated",
    )
    seeds = staged(docs.mapInArrow(_anchors(length, gram, False), emitted).join(repeated, "key", "left_semi"), "anchors-seeds")
    classes = staged(
        seeds.groupBy("key", "reach").agg(F.min(F.struct("doc", "pos", "tag")).alias("first"), F.count("*").alias("n")), "anchor-classes"
    )
    shared = classes.where("n > 1").select("key", "reach", F.col("first.doc").alias("doc0"), F.col("first.pos").alias("pos0"))
    copies = staged(
        seeds.join(shared, ["key", "reach"]).where("doc != doc0 or pos != pos0").select("doc", "tag", "pos").distinct(), "anchor-copies"
    )
    several = staged(classes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "anchors-several")
    firsts = classes.join(several, "key", "left_semi").select("first.*")
    per_doc = staged(firsts.groupBy("doc", "tag").agg(F.collect_set("pos").alias("anchors")), "anchors-by-document")
    windows = staged(
        docs.join(per_doc, ["doc", "tag"]).mapInArrow(_windows(length, gram), "key long, window long, doc long, tag long, pos int"),
        "windows",
    )
    earliest = staged(
        windows.groupBy("key", "window").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
        .select("key", "window", F.col("first.doc").alias("doc0"), F.col("first.pos").alias("pos0")),
        "windows-earliest",
    )
    partly = windows.join(earliest, ["key", "window"]).where("doc != doc0 or pos != pos0").select("doc", "tag", "pos")
    marks = copies.withColumn("whole", F.lit(True)).unionByName(partly.withColumn("whole", F.lit(False)))
    out = staged(
        marks.groupBy("doc", "tag").agg(
            F.collect_set(F.when(F.col("whole"), F.col("pos"))).alias("anchors"),
            F.collect_set(F.when(~F.col("whole"), F.col("pos"))).alias("windows"),
        ),
        "repeats",
    )
    dropped(repeated, seeds, classes, copies, several, per_doc, windows, earliest)
    return out


def _covered(n: int, anchors: np.ndarray, windows: np.ndarray, length: int, gram: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    for first, last in (
        (np.maximum(anchors - (length - gram), 0), np.minimum(anchors + length, n)),
        (windows, windows + length),
    ):
        np.add.at(steps, first, 1)
        np.add.at(steps, last, -1)
    return np.cumsum(steps[:-1]) > 0


def _cut(length: int, gram: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda x: x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32)
        for batch in batches:
            anchors, windows, texts = batch.column("anchors"), batch.column("windows"), batch.column("text")
            out = []
            for i in range(batch.num_rows):
                words = texts[i].as_buffer().to_pybytes().split()
                kept, spans = words, []
                if anchors[i].is_valid:
                    gone = _covered(len(words), numbers(anchors[i]), numbers(windows[i]), length, gram)
                    kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
                    spans = [{"first": int(a), "last": int(b) - 1} for a, b in edges]
                text = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), text, hashlib.sha256(text).hexdigest(), spans))
            n, removed, text, digest, spans = map(list, zip(*out, strict=True)) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(text, pa.binary()).cast(pa.string()),
                 pa.array(digest, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
                ["doc", "n_words", "n_removed", "kept", "kept_sha256", "repeats"],
            )

    return of


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept, kept_sha256, repeats: one row per document.

    A window is `length` consecutive words of one document; words it covers go if
    the same words also start earlier: in a document of smaller id, or in the same
    one further ahead. `kept` joins what is left by one space; `repeats` has the
    maximal repeats removed (first and last word, from 0). Windows are judged on
    the input.

    Null and empty texts have no words. A null id ranks before all others. Rows
    that repeat an id and a text get equal results; rows of one id with different
    texts are judged each on its own, none before the other. Extra columns are
    ignored; an empty table gives an empty result.
    """
    rows = keyed(docs)
    marks = repeat_marks(rows, length, gram)
    shape = "doc long, n_words long, n_removed long, kept string, kept_sha256 string, repeats array<struct<first: long, last: long>>"
    return (
        rows.join(marks, ["doc", "tag"], "left")
        .mapInArrow(_cut(length, gram), shape)
        .select(shown_id().alias("doc_id"), "n_words", "n_removed", "kept", "kept_sha256", "repeats")
    )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
