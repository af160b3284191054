"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

The documents' words are extracted once: each that is a word of the benchmark is staged
with its place, as a number. Everything after that reads these rows and no text.

A window of an item occurs in a document only if all of its words do, so its words are
ordered by their counts over all documents, and the rarest is looked for: the prefix of a
set that must be contained whole is a single element. Where it stands, the window must
fit between the document's ends (length and position), and its second rarest word must stand at its
own place. What is left is verified word by word, window by window. Equal windows of
any items are one window, so a run of one word costs a row for each place and not for each pair
of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm.common import dropped, keyed, shown_id, staged, table

WINDOW = 13
#: Rows of the benchmark side up to which it is sent to every executor; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words as written; `lowered` turns each into the form that is compared."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lowered(word: Column | str) -> Column:
    """A-Z alone in lower case. Words of ASCII characters take the cheap way."""
    word = F.col(word) if isinstance(word, str) else word
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _beside(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item, words: the different windows of each item; `window` consecutive words, or all of a shorter item."""
    words = F.transform(words_of(F.coalesce(F.col("text"), F.lit(""))), lowered)
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words.alias("all")).where(F.size("all") > 0)
    span = F.least(F.size("all"), F.lit(window))
    starts = items.select("item", "all", span.alias("span"), F.explode(F.sequence(F.lit(1), F.size("all") - span + 1)).alias("start"))
    return starts.select("item", F.slice("all", F.col("start"), F.col("span")).alias("words")).distinct()


def placed_words(docs: DataFrame, vocabulary: DataFrame, rows: int) -> DataFrame:
    """doc, tag, n, pos, wid: the words of keyed rows that `vocabulary` (word, wid) has, and one row with wid -1 at the end of each text."""
    words = F.concat(words_of(F.col("text")), F.array(F.lit("")))
    placed = docs.select("doc", "tag", words.alias("words")).select("doc", "tag", (F.size("words") - 1).alias("n"), F.posexplode("words").alias("pos", "word"))
    placed = placed.withColumn("word", lowered("word"))
    return placed.join(_beside(vocabulary, rows), "word").select("doc", "tag", "n", "pos", "wid")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, tag, n_words, n_hit, n_items, items_sha256, contaminated for keyed rows.

    A window is `window` consecutive words of an item, or all words of a shorter
    one. A document word inside any occurrence of a window is hit.

    Null texts have no words; items without words or id take no part; items that
    repeat an id count once. Repeated documents get equal results.
    """
    of_items = staged(item_windows(benchmark, window), "item-windows")
    windows = staged(of_items.select("words").distinct().withColumn("win", F.monotonically_increasing_id()), "windows")
    # numbers stand for words: equal numbers, equal words
    spelt = windows.select(F.explode("words").alias("word")).distinct().withColumn("wid", F.monotonically_increasing_id())
    vocabulary = staged(spelt.unionByName(docs.sparkSession.createDataFrame([("", -1)], "word string, wid long")), "vocabulary")
    members = staged(
        windows.select("win", F.size("words").alias("span"), F.posexplode("words").alias("at", "word")).join(vocabulary, "word").select("win", "span", "at", "wid"), "members"
    )
    placed = staged(placed_words(docs, vocabulary, vocabulary.count()), "placed-words")
    texts, hits = placed.where("wid < 0").select("doc", "tag", "n"), placed.where("wid >= 0")

    counts = hits.groupBy("wid").agg(F.count("*").alias("n"))
    by_rarity = F.sort_array(F.collect_list(F.struct("n", "wid", "at")))  # as many as a window has words
    ranked = members.join(counts, "wid").groupBy("win", "span").agg(by_rarity.alias("r"))
    # a window of which a word occurs nowhere has no occurrence either
    first, second = F.get("r", F.lit(0)), F.coalesce(F.get("r", F.lit(1)), F.get("r", F.lit(0)))
    prefixes = staged(
        ranked.where(F.size("r") == F.col("span")).select(
            "win", "span", first["wid"].alias("wid"), first["at"].alias("at"), second["wid"].alias("then"), second["at"].alias("then_at")
        ),
        "prefixes",
    )
    rows = prefixes.count()
    met = hits.join(_beside(prefixes, rows), "wid").withColumn("start", F.col("pos") - F.col("at")).where("start >= 0 and start + span <= n")
    met = met.select("doc", "tag", "win", "span", "start", "then", (F.col("start") + F.col("then_at")).alias("then_pos")).distinct()
    seconds = hits.join(_beside(prefixes.select("then").distinct(), rows), F.col("wid") == F.col("then"), "left_semi")
    seconds = seconds.select("doc", "tag", F.col("pos").alias("then_pos"), F.col("wid").alias("then"))
    likely = staged(met.join(seconds, ["doc", "tag", "then_pos", "then"], "left_semi").select("doc", "tag", "win", "span", "start"), "likely")

    # the list of documents grows with them: a shuffle at any size
    near = hits.join(likely.select("doc", "tag").distinct().hint("merge"), ["doc", "tag"], "left_semi").select("doc", "tag", "pos", "wid").distinct()
    wanted = likely.join(_beside(members.drop("span"), rows * window), "win").withColumn("pos", F.col("start") + F.col("at"))
    same = wanted.join(near, ["doc", "tag", "pos", "wid"]).groupBy("doc", "tag", "win", "span", "start").agg(F.count("*").alias("found"))
    found = staged(same.where("found = span"), "occurrences")

    inside = F.explode(F.sequence("start", F.col("start") + F.col("span") - 1)).alias("pos")
    covered = found.select("doc", "tag", inside).distinct().groupBy("doc", "tag").agg(F.count("*").alias("n_hit"))
    named = windows.join(of_items, "words").select("win", "item")
    items = found.select("doc", "tag", "win").distinct().join(named, "win").groupBy("doc", "tag").agg(F.sort_array(F.collect_set("item")).alias("items"))
    judged = staged(covered.join(items, ["doc", "tag"]), "hits")
    out = staged(texts.select("doc", "tag", F.col("n").cast("long").alias("n_words")).join(judged, ["doc", "tag"], "left"), "contamination")
    dropped(of_items, windows, vocabulary, members, placed, prefixes, likely, found, judged)
    zero = F.lit(0).cast("long")
    listed = F.array_join(F.coalesce("items", F.array().cast("array<string>")), ",")
    return out.select(
        "doc", "tag", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce(F.size("items").cast("long"), zero).alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(keyed(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select(shown_id().alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item, w, least(len(w), 13) AS span FROM b WHERE len(w) > 0),
iw AS (
  SELECT DISTINCT item, span, array_to_string(w[k:k + span - 1], ' ') AS win
  FROM (SELECT item, w, span, unnest(range(1, (len(w) - span + 2)::BIGINT)) AS k FROM i)),
dw AS (
  SELECT doc_id, span, k, array_to_string(w[k:k + span - 1], ' ') AS win
  FROM (SELECT doc_id, w, span, unnest(range(1, (len(w) - span + 2)::BIGINT)) AS k
        FROM d, (SELECT DISTINCT span FROM i) WHERE len(w) >= span)),
hit AS (SELECT doc_id, item, k, dw.span FROM dw JOIN iw USING (win, span)),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + span)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
