"""The corpus pipeline: what remains of `documents` after five operators, stage by stage.

Each stage takes the documents its predecessor kept, decides over all of them, and
returns them with the columns of `documents`; the last one returns the mix itself.
`run` writes every stage to the shared folder and reads it back, so a lost executor
costs the work of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm.common import NO_ID, keyed, staged, table
from penstock.llm.decontaminate import contamination
from penstock.llm.mixing import mix
from penstock.llm.pii import pseudonym_key, pseudonymised
from penstock.llm.simhash import NAMELESS, components, near_duplicates, similar_documents
from penstock.llm.toxicity import THRESHOLD, fit, scored


def _own_names(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """`docs` under names that nothing joined to it has, with its key (_doc, _tag); and the columns that lead back."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    own = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)],
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_tag"),
    )
    return own, [F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)]


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """`docs` but for the rows whose key (doc, tag) is in `rejected`; all columns as they are."""
    own, back = _own_names(docs)
    gone = rejected.select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).distinct()
    return own.join(gone, ["_doc", "_tag"], "left_anti").select(*back)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject.

    Null texts are scored as empty ones; copies of a row, and rows of one id and text, go or stay
    together; without labels of both classes nothing goes. An empty table stays empty, other columns pass.
    """
    found = scored(keyed(docs), fit(docs, table(spark, sf_dir, "labels")))
    return _without(docs, staged(found.where(F.col("score") >= THRESHOLD).select("doc", "tag"), "toxic"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id, once.

    Documents are linked by fingerprints, at two bits of difference, and by five-word shingles that
    are 0.8 alike; groups are what all these links connect. Of a group in which no
    row has an id, one row stays; of several texts under the id that stays, one.
    """
    found = staged(near_duplicates(keyed(docs)), "print-groups")
    # texts by their hashes, one row each: no one leaves before all links are found
    texts = staged(keyed(docs).select("tag", F.col("doc").alias("of"), F.xxhash64("text").alias("doc"), "text"), "hashed-texts")
    similar = staged(similar_documents(staged(texts.dropDuplicates(["doc"]).select("doc", "tag", "text"), "distinct-texts")), "similar-texts")
    held = texts.select(F.col("of").alias("doc"), "tag", F.col("doc").alias("node")).join(found.select("doc", "tag", "component").distinct(), ["doc", "tag"])
    held = held.select("node", "component").distinct().join(similar, "node").select("root", "component").distinct()
    roots = similar.select("root").distinct().withColumn("node", F.col("root"))
    own_roots = texts.select(F.col("of").alias("doc"), "tag", F.col("doc").alias("node")).join(roots, "node")
    own_roots = own_roots.join(found.select("doc", "tag", "component").distinct(), ["doc", "tag"]).select("root", "component").distinct()
    held = staged(held.unionByName(own_roots).distinct(), "similar-components")
    low = held.groupBy("root").agg(F.min("component").alias("b"))
    links = staged(held.join(low, "root").select(F.col("component").alias("a"), "b").where("a != b"), "component-links")
    merged = staged(components(links), "merged-components").withColumnRenamed("node", "component")
    found = found.join(merged, "component", "left").select("doc", "tag", F.coalesce("root", "component").alias("component"))
    return _first_of_groups(docs, staged(found, "near-groups"))


def _first_of_groups(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of each group; `found` has the group (component) of each key."""
    first = found.where(F.col("component") >= NAMELESS).groupBy("component").agg(F.min("tag").alias("first"))
    found = found.join(staged(first, "nameless-groups"), "component", "left")
    copies = found.where(F.when(F.col("first").isNull(), F.col("doc") != F.col("component")).otherwise(F.col("tag") != F.col("first")))
    kept = _without(docs, staged(copies.select("doc", "tag"), "near-copies"))
    # what is left of an id, or of a text without one, is one document
    own, back = _own_names(kept)
    one = ["_doc", F.when(F.col("_doc") == NO_ID, F.col("_tag")).otherwise(0).alias("_text")]
    again = staged(own.select("_tag", *one).groupBy("_doc", "_text").agg(F.count("*").alias("n"), F.min("_tag").alias("_tag")).where("n > 1"), "again")
    if not again.take(1):
        return kept
    rest = own.select("*", one[1])
    single = rest.join(again.select("_doc", "_text"), ["_doc", "_text"], "left_anti")
    several = rest.join(again.select("_doc", "_text", "_tag"), ["_doc", "_text", "_tag"]).dropDuplicates(["_doc", "_text"])
    return single.select(*back).unionByName(several.select(*back))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the rule allows.

    Null and empty texts have no words and stay, as does everything if the benchmark is
    empty; rows of one id are judged each by its text. Other columns pass.
    """
    found = contamination(keyed(docs), table(spark, sf_dir, "benchmark"))
    return _without(docs, staged(found.where("contaminated").select("doc", "tag"), "contaminated"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal values; null texts stay null, other columns and repeated rows pass."""
    return pseudonymised(docs, pseudonym_key(spark))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, numbered by `copy` from 1, with its source's target.

    Null sources are one source, null and empty texts have size 0; of rows with equal id, text and source
    all copies come from one. An empty table gives an empty mix. Columns named `copy` or `source_target` in the
    documents would be doubled, as in any select.
    """
    taken = mix(docs).groupBy("doc_id", "tag", "source").agg(F.sum("copies").alias("_copies"), F.min("target").alias("source_target"))
    taken = taken.where("_copies > 0").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_doc"), F.col("tag").alias("_tag"), F.hash("source").alias("_source"), "_copies", "source_target"
    )
    own, back = _own_names(docs)
    own = own.withColumn("_source", F.hash(F.col(f"_{docs.columns.index('source')}").cast("string"))).dropDuplicates(["_doc", "_tag", "_source"])
    copy = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("copy")
    return own.join(staged(taken, "mix-taken"), ["_doc", "_tag", "_source"]).select(*back, "source_target", copy)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixing),
]

#: SQL can express neither the models nor the fingerprints; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
