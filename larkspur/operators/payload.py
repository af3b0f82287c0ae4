"""Rewriting of all strings in nested columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def walk(value: Column, kind: T.DataType, change: Callable[[Column], Column]) -> Column:
    """A nested value with every string changed; keys, field names and other types stay."""
    if isinstance(kind, T.StringType):
        return change(value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[walk(value.getField(f.name), f.dataType, change).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: walk(x, kind.elementType, change))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: walk(x, kind.valueType, change))
    return value


def change_payload(rows: DataFrame, column: str, change: Callable[[Column], Column]) -> DataFrame:
    """Change all strings in a column by an expression."""
    return rows.withColumn(column, walk(F.col(column), rows.schema[column].dataType, change))


def leaves(value: Column, kind: T.DataType) -> Column:
    """All strings in a nested value, from left to right."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.when(value.isNotNull(), F.array(value)).otherwise(none)
    if isinstance(kind, T.StructType):
        return F.coalesce(F.concat(none, *[leaves(value.getField(f.name), f.dataType) for f in kind.fields]), none)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: leaves(x, kind.elementType))), none)
    if isinstance(kind, T.MapType):
        return leaves(F.map_values(value), T.ArrayType(kind.valueType))
    return none
