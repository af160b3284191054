"""Toxicity from two class-conditional Kneser-Ney models.

Each class has an interpolated model of four orders: a word after the one before it, the
word, its head (the first letters), and what both classes share. An order takes a
discount off each of its counts, and hands on the mass that is left over by that to the
order below, which is estimated from continuation counts and from what the discounts took off:

    P(w | h) = max(n(h, w) - D, 0) / n(h) + left(h) P(w)
    P(w)     = max(n(w) - D, 0) / n + left P(head) shared(w | head)
    P(head)  = max(r(head) - D, 0) / r + left shared(head)

The discount is what the counts of both classes together let one expect in this class, plus
some standard deviations: rare expressions, which no class can claim, pass whole to the
shared order and say nothing, while one that a class has for itself keeps the rest. A text's score
compares its two log-likelihoods per word.

Counts of words are of different contexts (the words on both sides), one per document at
most; counts of pairs are of documents. Neither repetition within a text nor copies of it inflate them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm.common import dropped, fold, keyed, shown_id, staged, table

#: Labelled rows of each class that the models learn from, at most; those of the smallest id hashes.
ROWS_PER_CLASS = 4000
HEAD = 4
#: Standard deviations in the discount, words added to a text's length.
DEVIATIONS, PADDING = 3.0, 20
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")
Pair = tuple[float, float]  # of the toxic and the plain class


@dataclass
class Model:
    """What the two models say of an expression: log-likelihood ratios; then the calibration.

    `words` and `pairs` have the expressions of which a class keeps a part, `heads` those of other words,
    `after` what the word before adds, and `other` the ratio of all else.
    """

    words: dict[str, float] = field(default_factory=dict)
    heads: dict[str, float] = field(default_factory=dict)
    other: float = 0.0
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    after: dict[str, float] = field(default_factory=dict)
    slope: float = 0.0
    bias: float = 0.0
    fitted: bool = False

    def of(self, words: list[str], known: dict[str, float] | None = None) -> float:
        """The log-likelihood ratio of a text."""
        known = _Known(self) if known is None else known
        total = sum(map(known.__getitem__, words))
        if self.after:
            for i, word in enumerate(["", *words[:-1]]) if words else ():
                if word in self.after:
                    own = self.pairs.get((word, words[i]))
                    total += self.after[word] if own is None else own - known[words[i]]
        return total


class _Known(dict):
    """word -> its ratio, from its own part or its head; forgets the other words at a fixed size."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > len(self.model.words) + 300_000:
            self.clear()
            self.update(self.model.words)
        value = self[word] = self.model.heads.get(word[:HEAD], self.model.other)
        return value


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, toxic, before, word, context): each word of a document at its first place, without `before`; each pair once, without context."""
    for batch in batches:
        rows: list[tuple] = []
        for part, toxic, text in zip(*(batch.column(c).to_pylist() for c in ("part", "toxic", "text")), strict=True):
            words = ["", *_WORD.findall(text.lower()), ""]
            first = {word: i for i, word in zip(range(len(words) - 2, 0, -1), words[-2:0:-1], strict=True)}
            rows += [(part, toxic, None, w, xxhash.xxh64_intdigest(f"{words[i - 1]} {words[i + 1]}") >> 1) for w, i in first.items()]
            rows += [(part, toxic, before, w, None) for before, w in sorted(set(zip(words[:-2], words[1:-1], strict=True)))]
            if len(rows) > 200_000:
                yield _records(rows)
                rows = []
        if rows:
            yield _records(rows)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["part", "toxic", "before", "word", "context"])


def _own(counts: dict[str, Pair], deviations: float) -> tuple[dict[str, Pair], Pair, dict[str, Pair]]:
    """What is above the discounts of each class, as probabilities; the left-over mass of each; and what the discounts took off."""
    totals = [sum(n[c] for n in counts.values()) for c in (0, 1)]
    both = sum(totals)
    own, off = {}, {}
    for word, n in counts.items():
        expected = [sum(n) / both * t for t in totals]
        discount = [e + deviations * e**0.5 + 0.5 for e in expected]
        above = [max(0.0, x - d) for x, d in zip(n, discount, strict=True)]
        if any(above):
            own[word] = tuple(x / t if t else 0.0 for x, t in zip(above, totals, strict=True))
        off[word] = tuple(x - y for x, y in zip(n, above, strict=True))
    left = tuple(1 - sum(o[c] for o in own.values()) for c in (0, 1))
    return own, left, off


class Lower:
    """P(w) of both classes, from the orders below pairs; counts are (toxic, plain) by word."""

    def __init__(self, counts: dict[str, Pair], deviations: float = DEVIATIONS):
        self.words, self.left, off = _own(counts, deviations)
        heads: dict[str, list[float]] = {}
        self.words_of: dict[str, int] = {}
        for word, n in off.items():
            held = heads.setdefault(word[:HEAD], [0.0, 0.0])
            held[0] += n[0]
            held[1] += n[1]
            self.words_of[word[:HEAD]] = self.words_of.get(word[:HEAD], 0) + 1
        self.heads, self.head_left, _ = _own(heads, deviations)
        self.of_word = {word: sum(n) for word, n in off.items()}
        self.of_head = {head: sum(n) for head, n in heads.items()}
        self.total = sum(self.of_head.values()) + 0.5 * (len(self.of_head) + 1)

    def head(self, head: str) -> Pair:
        shared = (self.of_head.get(head, 0.0) + 0.5) / self.total
        return tuple(o + left * shared for o, left in zip(self.heads.get(head, (0.0, 0.0)), self.head_left, strict=True))

    def word(self, word: str) -> Pair:
        head = word[:HEAD]
        given = (self.of_word.get(word, 0.0) + 0.5) / (self.of_head.get(head, 0.0) + 0.5 * (self.words_of.get(head, 0) + 1))
        return tuple(o + left * p * given for o, left, p in zip(self.words.get(word, (0.0, 0.0)), self.left, self.head(head), strict=True))

    def model(self, pairs: dict[tuple[str, str], Pair]) -> Model:
        """All ratios; `pairs` has P above the discounts of (word before, word), as far as a class has any."""
        kept: dict[str, list[float]] = {}
        for (before, _), own in pairs.items():
            held = kept.setdefault(before, [0.0, 0.0])
            held[0] += own[0]
            held[1] += own[1]
        rest = {before: (1 - t, 1 - p) for before, (t, p) in kept.items()}
        of_pairs = {
            (before, word): _ratio(tuple(o + left * p for o, left, p in zip(own, rest[before], self.word(word), strict=True))) for (before, word), own in pairs.items()
        }
        other = _ratio(tuple(a * b for a, b in zip(self.left, self.head_left, strict=True)))
        of_heads = {head: _ratio(tuple(a * b for a, b in zip(self.left, self.head(head), strict=True))) for head in self.heads}
        return Model({w: _ratio(self.word(w)) for w in self.words}, of_heads, other, of_pairs, {before: _ratio(left) for before, left in rest.items()})


def _ratio(of: Pair) -> float:
    return float(np.log(of[0] / of[1]))


def own_pairs(seen: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """model, before, word, own_toxic, own_plain: pairs of words of which a class keeps a part; models 0 and 1 of the parts, 2 of all."""
    pairs = seen.where("before is not null").select("part", "toxic", "before", "word")
    pairs = pairs.groupBy("part", "before", "word").agg(*[F.count_if(F.col("toxic") == c).cast("double").alias(n) for n, c in (("t", 1), ("p", 0))])
    pairs = pairs.select(F.explode(F.array("part", F.lit(2))).alias("model"), "before", "word", "t", "p").groupBy("model", "before", "word").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    pairs = staged(pairs, "toxicity-pairs")
    history = pairs.groupBy("model", "before").agg(F.sum("t").alias("all_t"), F.sum("p").alias("all_p"))
    share = (F.col("t") + F.col("p")) / (F.col("all_t") + F.col("all_p"))
    own = []
    for n in ("t", "p"):
        expected = share * F.col(f"all_{n}")
        own.append(F.greatest(F.lit(0.0), F.col(n) - expected - deviations * F.sqrt(expected) - 0.5) / F.greatest(F.lit(1.0), F.col(f"all_{n}")))
    return pairs.join(history, ["model", "before"]).select("model", "before", "word", own[0].alias("own_toxic"), own[1].alias("own_plain")).where("own_toxic > 0 or own_plain > 0")


def training_rows(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """doc, part (0 or 1), toxic, text of the rows to learn from; never the held-out third.

    Of several labels of one id the highest counts. Labels other than 0 and 1, null
    ids and labels without a document are left out; equal texts count once.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(fold("doc_id", 3) != 1).withColumn("order", F.xxhash64("doc_id"))
    some = [known.where(F.col("toxic") == c).orderBy("order", "doc_id").limit(rows_per_class) for c in (0, 1)]
    chosen = staged(some[0].unionByName(some[1]).select(F.col("doc_id").cast("long").alias("doc"), F.col("toxic").cast("int").alias("toxic")), "labelled")
    rows = keyed(docs).join(F.broadcast(chosen), "doc")  # at most 2 * rows_per_class
    once = rows.withColumn("copy", F.xxhash64("text")).dropDuplicates(["copy", "toxic"])
    return once.select("doc", F.pmod("copy", F.lit(2)).cast("int").alias("part"), "toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Models of both classes; each half of the rows is scored by models of the other half to calibrate."""
    rows = staged(training_rows(docs, labels, rows_per_class), "toxicity-rows")
    if rows.select("toxic").distinct().count() < 2:
        return Model()
    seen = staged(rows.mapInArrow(_words, "part int, toxic int, before string, word string, context long"), "toxicity-words")
    contexts = seen.where("before is null").select(F.explode(F.array("part", F.lit(2))).alias("model"), "toxic", "word", "context")
    counts = contexts.groupBy("model", "word").agg(*[F.count_distinct(F.when(F.col("toxic") == c, F.col("context"))).alias(n) for n, c in (("t", 1), ("p", 0))])
    # words, and pairs with a part of their own, of at most 2 * rows_per_class documents
    side: tuple[dict[str, Pair], dict[str, Pair], dict[str, Pair]] = ({}, {}, {})
    for batch in counts.toArrow().to_batches():
        for of, word, t, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            side[of][word] = (t, p)
    pairs: tuple[dict, dict, dict] = ({}, {}, {})
    for batch in own_pairs(seen).toArrow().to_batches():
        for of, before, word, t, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pairs[of][before, word] = (t, p)
    model = Lower(side[2]).model(pairs[2])
    if not all(any(n[c] for n in part.values()) for part in side for c in (0, 1)):
        return Model()
    halves = [Lower(side[p]).model(pairs[p]) for p in (1, 0)]

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = [_tally(half) for half in halves]
        for batch in batches:
            parts, toxic, texts = (batch.column(c).to_pylist() for c in ("part", "toxic", "text"))
            x = [tally[p](t)[0] for p, t in zip(parts, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(x, pa.float64())], ["toxic", "x"])

    measured = rows.mapInArrow(crossed, "toxic int, x double").toArrow()
    dropped(rows, seen)
    x, y = measured["x"].to_numpy(), measured["toxic"].to_numpy().astype(float)
    scale = x.std() or 1.0
    design, weights = np.stack([np.ones_like(x), x / scale], 1), np.zeros(2)
    ridge = np.diag([1e-6, 1e-2])
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)  # both classes weigh the same
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (weight * (y - p)) - ridge @ weights)
        weights += np.clip(step, -2, 2)
    return replace(model, slope=float(weights[1] / scale), bias=float(weights[0]), fitted=True)


def _tally(model: Model):
    """text -> its log-likelihood ratio per word, and its number of words."""
    known = _Known(model)

    def of(text: str) -> tuple[float, int]:
        found = _WORD.findall(text.lower())
        return model.of(found, known) / (len(found) + PADDING), len(found)

    return of


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc, tag, score, ratio, n_words for keyed rows; score is 0 for all when there was nothing to learn from."""
    slope, bias, fitted = model.slope, model.bias, model.fitted
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _tally(shared.value)
        for batch in batches:
            found = [tally(text.as_py()) for text in batch.column("text")]
            x, n = np.array([f[0] for f in found]), [f[1] for f in found]
            score = 1 / (1 + np.exp(-np.clip(slope * x + bias, -30, 30))) if fitted else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("tag"), pa.array(score, pa.float64()), pa.array(x, pa.float64()), pa.array(n, pa.int64())],
                ["doc", "tag", "score", "ratio", "n_words"],
            )

    return docs.mapInArrow(of, "doc long, tag long, score double, ratio double, n_words long")


def toxicity(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, ratio, n_words: one row per document, scored by its text alone.

    Null texts score as empty ones. Rows are scored each by itself, so repeated rows get
    equal results. Without labelled documents of both classes all scores are 0.
    """
    found = scored(keyed(docs), fit(train_docs, labels, rows_per_class))
    return found.select(
        shown_id().alias("doc_id"), (fold(shown_id(), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "ratio", "n_words",
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, docs, table(spark, sf_dir, "labels"))
