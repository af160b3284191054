"""What the operators share: row keys, word rules, staging in the shared folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.session import scratch_dir

#: Stands for a null document id in keys; ranks before every other id, as nulls do in Spark.
NO_ID = -(2**63)
#: Words handled at a time by the array code, which bounds what a Python worker holds.
CHUNK_WORDS = 150_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc (the id, NO_ID for null), tag (tells rows of one id apart by their text), text; nothing else.

    Rows of one id and different texts share a 64-bit tag with a chance of n * n / 2**65 among n
    of them: one in 37 million for a million rows without an id.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(body).alias("tag"), body.alias("text")
    )


def shown_id(doc: Column | str = "doc") -> Column:
    """Back from the key to the id."""
    column = F.col(doc) if isinstance(doc, str) else doc
    return F.when(column != NO_ID, column)


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as an empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "utf-8")), F.lit(parts))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back, so that later branches read instead of computing again.

    The shuffle files of the write are removed as soon as it is done: each stage
    then needs the disk of its own shuffles only. `dropped` removes the files
    themselves when no later stage reads them.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def dropped(*stages: DataFrame) -> None:
    """Remove staged files; only for stages whose readers have all been written."""
    for df in stages:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class WordHashes(dict):
    """word -> its 64-bit hash; forgets everything at a fixed size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def as_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def word_chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Row numbers and words of a batch's `text`, some rows at a time."""
    rows, lists, held = [], [], 0
    texts = batch.column("text")
    for i in range(batch.num_rows):
        words = (texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b"").split()
        rows.append(i)
        lists.append(words)
        held += len(words)
        if held >= CHUNK_WORDS:
            yield rows, lists
            rows, lists, held = [], [], 0
    if rows:
        yield rows, lists


def hashed(lists: Iterable[list[bytes]], cache: WordHashes, total: int) -> np.ndarray:
    get = cache.__getitem__
    return np.fromiter((get(w) for words in lists for w in words), np.uint64, total)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class SpanHashes:
    """Hashes of any span of a sequence of word hashes, from prefix sums modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        base, inverse = np.uint64(self.BASE), np.uint64(pow(self.BASE, -1, 2**64))
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
        self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, inverse, np.uint64)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[: n - 1])])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])


def sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each run of `width` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return op(out[:-rest], out[rest:]) if rest else out
