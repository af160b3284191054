"""License scan by canonical digests, in DataFrame operations only.

A text is written in one canonical way (case, punctuation, white space, copyright
lines, equivalent spellings) and digested; entire texts whose digests are known are
licences. The same is done with each line, for notices within other texts.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm.common import keyed, shown_id, staged, table
from penstock.llm.license_texts import SPELLINGS, TEXTS

#: A line that states a copyright, and what is neither letter, digit nor line break.
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright(?: [^\p{L}\n]|[^\p{L}\n]|$)|\(c\) |©|all rights reserved)[^\n]*$"
OTHER = r"[^\p{L}\p{N}\n]+"


#: Long licences by the file in license_files that has the text; a text alone doesn't say "or later", so it counts as the version only.
LONG = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2-only", "GFDL-1.3": "GFDL-1.3-only",
    "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only",
    "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
LAST = "END OF TERMS AND CONDITIONS"


def long_texts() -> list[tuple[str, str]]:
    """license, text of LONG; those with an appendix on how to apply them also without it."""
    out = []
    for name, license_id in LONG.items():
        text = (files("penstock.llm") / "license_files" / f"{name}.txt").read_text("utf-8")
        out.append((license_id, text))
        if LAST in text:
            out.append((license_id, text[: text.rindex(LAST)]))
            out.append((license_id, text[: text.rindex(LAST) + len(LAST)]))
    return out


def canonical_lines(text: Column) -> Column:
    """The text's lines in canonical writing, without empty ones."""
    plain = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    plain = F.regexp_replace(plain, OTHER, " ")
    for variant, common in SPELLINGS:
        plain = F.replace(plain, F.lit(variant), F.lit(common))
    return F.filter(F.transform(F.split(plain, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None, more: DataFrame | None = None) -> DataFrame:
    """digest, license, size (characters of the canonical text) of the catalogue: `texts`, TEXTS and LONG if none, and the table `more`."""
    rows = spark.createDataFrame(TEXTS + long_texts() if texts is None else texts, "license string, text string")
    if more is not None:
        rows = rows.unionByName(more.select("license", "text"))
    rows = rows.select("license", F.array_join(canonical_lines(F.col("text")), " ").alias("text"))
    return rows.select(F.sha2("text", 256).alias("digest"), "license", F.length("text").alias("size")).distinct()


def license_scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None, more: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license, notices: one row per document.

    `license` is that of the entire text, null if unknown; `notices` has the sorted
    identifiers of all lines that are known by themselves, comma-joined, empty if
    none. Null and empty texts have the digest of nothing, which is no licence. Repeated
    rows get equal results; extra columns are ignored. `more` (license, text) adds to the catalogue.

    The built-in catalogue is small, so it is broadcast; documents aren't shuffled
    but for the few that have notices, whose identifiers are joined back. Lines of a
    length that no known text has are not digested. With `more`, of any size, both are left to
    the joins.
    """
    spark = docs.sparkSession
    known = staged(known_digests(spark, texts, more), "license-digests")
    lines, beside = F.col("lines"), lambda x: x
    if more is None:
        sizes, beside = [r.size for r in known.select("size").distinct().collect()], F.broadcast
        lines = F.filter("lines", lambda x: F.length(x).isin(sizes))
    fitting = F.transform(lines, lambda x: F.sha2(x, 256))
    rows = staged(
        keyed(docs).select("doc", "tag", canonical_lines(F.col("text")).alias("lines"))
        .select("doc", "tag", F.sha2(F.array_join("lines", " "), 256).alias("digest"), fitting.alias("lines")),
        "license-lines",
    )
    lines = rows.select("doc", "tag", F.explode("lines").alias("digest")).join(beside(known), "digest")
    notices = lines.groupBy("doc", "tag").agg(F.collect_set("license").alias("notices"))
    notices = staged(notices.select("doc", "tag", F.array_join(F.sort_array("notices"), ",").alias("notices")), "license-notices")
    whole = known.groupBy("digest").agg(F.min("license").alias("license"))
    out = rows.select("doc", "tag", "digest").join(beside(whole), "digest", "left").join(notices, ["doc", "tag"], "left")
    return out.select(shown_id().alias("doc_id"), "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    spelled = "regexp_replace(regexp_replace(lower(coalesce(text, '')), " + quote(COPYRIGHT) + ", '', 'g'), " + quote(OTHER) + ", ' ', 'g')"
    for variant, common in SPELLINGS:
        spelled = f"replace({spelled}, {quote(variant)}, {quote(common)})"
    lines = f"list_filter(list_transform(string_split({spelled}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    values = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in TEXTS)
    return f"""
    WITH k AS (SELECT DISTINCT license, sha256(array_to_string({lines}, ' ')) AS digest FROM (VALUES {values}) AS t(license, text)),
    d AS (SELECT doc_id, row_number() OVER () AS r, {lines} AS l FROM documents),
    n AS (SELECT r, string_agg(license, ',' ORDER BY license) AS notices
          FROM (SELECT DISTINCT r, license FROM (SELECT r, sha256(unnest(l)) AS digest FROM d) JOIN k USING (digest)) GROUP BY r),
    w AS (SELECT digest, min(license) AS license FROM k GROUP BY digest)
    SELECT doc_id, sha256(array_to_string(l, ' ')) AS digest, license, coalesce(notices, '') AS notices
    FROM d LEFT JOIN n USING (r) LEFT JOIN w ON w.digest = sha256(array_to_string(l, ' '))
    """


OP6_SQL = _sql()
