"""Topic patterns: dot-separated words, `*` for one word, `#` for any number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dotted(key: Column) -> Column:
    """Every word with a dot before it, so that `#` can also stand for no word."""
    return F.when(key == "", F.lit("")).otherwise(F.concat(F.lit("."), key))


def topic_regex(pattern: Column) -> Column:
    """Anchored regular expression over `dotted(routing key)`."""
    words = F.transform(
        F.split(pattern, r"\."),
        lambda w: F.when(w == "#", F.lit(r"(\.[^.]*)*"))
        .when(w == "*", F.lit(r"\.[^.]*"))
        .otherwise(F.concat(F.lit(r"\."), F.regexp_replace(w, r"([^A-Za-z0-9_])", r"\\$1"))),
    )
    return F.concat(F.lit(r"\A"), F.array_join(words, ""), F.lit(r"\z"))


# One dotted word that is not a wildcard.
_LITERAL = r"\.(?![*#](?:\.|\z))[^.]*"


def literal_ends(pattern: Column) -> tuple[Column, Column]:
    """The literal words before the first wildcard and after the last one, dotted.

    A pattern without wildcards is all prefix.
    """
    prefix = F.regexp_extract(dotted(pattern), rf"\A((?:{_LITERAL})*)", 1)
    suffix = F.regexp_extract(dotted(pattern), rf"((?:{_LITERAL})*)\z", 1)
    return prefix, F.when(prefix == dotted(pattern), F.lit("")).otherwise(suffix)


def possible_ends(key: Column) -> tuple[Column, Column]:
    """Every run of words a key starts with, and every one it ends with, dotted."""
    words = F.split(dotted(key), r"(?=\.)")
    count = F.when(key == "", F.lit(0)).otherwise(F.size(words))
    steps = F.sequence(F.lit(0), count)
    return (
        F.transform(steps, lambda n: F.array_join(F.slice(words, F.lit(1), n), "")),
        F.transform(steps, lambda n: F.array_join(F.slice(words, count - n + 1, n), "")),
    )
