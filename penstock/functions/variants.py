"""Small helpers over VARIANT values taken from a parsed JSON object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT_JSON = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "allowUnquotedFieldNames": "false",
}


def kind(value: Column) -> Column:
    """JSON type of a variant as text: STRING, BIGINT, OBJECT<…>, ARRAY<…>, VOID (null)."""
    return F.schema_of_variant(value)


def text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def absent(value: Column) -> Column:
    """Missing key or explicit null."""
    return value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False))


def is_string(value: Column) -> Column:
    return F.coalesce(kind(value) == "STRING", F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("OBJECT"), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("ARRAY"), F.lit(False))


def is_boolean(value: Column) -> Column:
    return F.coalesce(kind(value) == "BOOLEAN", F.lit(False))


def object_of(value: Column) -> Column:
    """A variant as MAP<STRING, VARIANT>, NULL where it is no object."""
    return value.try_cast("map<string,variant>")


def parsed_text(raw: Column) -> Column:
    """`raw` as an ARRAY of JSON objects, NULL where it is no list of objects.

    Brackets around the text make trailing characters a syntax error, which the
    JSON reader would otherwise ignore.
    """
    return F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<map<string,variant>>", STRICT_JSON)


def only_object(parsed: Column) -> Column:
    """The object out of `parsed_text`, NULL unless it is the only one. Of a repeated key the last value counts.

    Inside the values the reader does the same, with this library's session settings.
    """
    first = F.get(parsed, F.lit(0))
    keys = F.map_keys(first)
    last = F.filter(F.map_entries(first), lambda e, i: F.array_position(F.reverse(keys), e["key"]) == F.size(keys) - i)
    single = F.when(F.size(keys) == F.size(F.array_distinct(keys)), first).otherwise(F.map_from_entries(last))
    return F.when(F.size(parsed) == 1, single)


def with_object(df: DataFrame, raw: str, name: str) -> DataFrame:
    """Add `name`, the one JSON object in the text column `raw` as MAP<STRING, VARIANT>, else NULL.

    Two projections, so that the text is parsed once and not once per use.
    """
    return df.withColumn("_parsed", parsed_text(F.col(raw))).withColumn(name, only_object(F.col("_parsed"))).drop("_parsed")


def fenced(df: DataFrame, name: str) -> DataFrame:
    """Pass a costly column through a one-element generator.

    A filter on the column would otherwise be pushed below the projection that makes
    it, taking a copy of the whole expression along, and every row would pay twice.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(name)).alias(name))
