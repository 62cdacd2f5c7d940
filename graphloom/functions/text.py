"""Scalar functions of the graph queries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def location_line(location: Column) -> Column:
    """The start line of a JSON location."""
    return F.get_json_object(location, "$.start.line").try_cast("int")


def json_int(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).try_cast("long")


def object_parameter(name: Column) -> Column:
    """The name in <context>.<name>-o<n>."""
    return F.split_part(F.split_part(name, F.lit("."), F.lit(2)), F.lit("-"), F.lit(1))


def left_trimmed(line: Column) -> Column:
    return F.ltrim(F.regexp_replace(line, "\n", ""))


def is_number(key: Column) -> Column:
    return key.rlike(r"^\d+$")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]*$", "")


def union_type(types: Column) -> Column:
    """any, the one type, or the sorted types in braces."""
    distinct = F.array_sort(F.array_distinct(types))
    return F.when(F.size(distinct) == 0, F.lit("any")).when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).otherwise(F.concat(F.lit("{"), F.array_join(distinct, ","), F.lit("}")))
