"""Strict type tests on untrusted JSON.

A cast turns ``true`` into 1 and 5 into ``"5"``; the schema of the value does not lie.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """The text as VARIANT; null unless the whole of it is one JSON value.

    The parser stops after the first value, so the text is also read as the only member of an object and as the
    only element of a list: what could end the one early is wrong in the other. Those two readings build nothing.
    """
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    inside = F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when(alone & inside, F.try_parse_json(text))


def at(value: Column, path: str) -> Column:
    """The member at a JSON path as VARIANT; null when absent."""
    return F.try_variant_get(value, path, "variant")


def type_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_text(value: Column) -> Column:
    return F.coalesce(type_of(value) == "STRING", F.lit(False))


def is_whole(value: Column) -> Column:
    return F.coalesce(type_of(value) == "BIGINT", F.lit(False))


def is_json_null(value: Column) -> Column:
    return F.coalesce(type_of(value) == "VOID", F.lit(False))


def is_absent(value: Column) -> Column:
    """Missing or JSON null."""
    return value.isNull() | is_json_null(value)


def members(value: Column) -> Column:
    """An object as a map of its members; null for anything else.

    One walk over the value answers whether it is an object, what keys it has and what they
    hold; describing the schema of a whole object costs far more.
    """
    return F.try_variant_get(value, "$", "map<string,variant>")


def elements(value: Column, path: str = "$") -> Column:
    """A list as an array of its elements; null for anything else."""
    return F.try_variant_get(value, path, "array<variant>")


def as_text(value: Column) -> Column:
    """The value when it is a string, else null."""
    return F.when(type_of(value) == "STRING", F.try_variant_get(value, "$", "string"))


def as_whole(value: Column, kind: str = "bigint") -> Column:
    """The value when it is a whole number, else null."""
    return F.when(type_of(value) == "BIGINT", F.try_variant_get(value, "$", kind))


def text(value: Column, path: str = "$") -> Column:
    """The string at ``path``, or null when it is anything but a string."""
    member = at(value, path)
    return F.when(is_text(member), F.try_variant_get(value, path, "string"))


def whole(value: Column, path: str = "$") -> Column:
    """The integer at ``path``, or null when it is anything but a whole number."""
    member = at(value, path)
    return F.when(is_whole(member), F.try_variant_get(value, path, "bigint"))
