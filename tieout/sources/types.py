"""Leaves of nested column types."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T


def leaf_columns(schema: T.StructType) -> list[tuple[str, str]]:
    """(path, type) of every leaf: fields after a dot, array elements as ``[]``, map keys and values as ``{key}`` and ``{value}``.

    A field that is added deep in a struct is one path more, and no changed type of its column. An empty struct is a leaf.
    """
    return [leaf for field in schema.fields for leaf in _leaves(field.name, field.dataType)]


def _leaves(path: str, kind: T.DataType) -> list[tuple[str, str]]:
    if isinstance(kind, T.StructType) and kind.fields:
        return [leaf for field in kind.fields for leaf in _leaves(f"{path}.{field.name}", field.dataType)]
    if isinstance(kind, T.ArrayType):
        return _leaves(f"{path}[]", kind.elementType)
    if isinstance(kind, T.MapType):
        return _leaves(f"{path}{{key}}", kind.keyType) + _leaves(f"{path}{{value}}", kind.valueType)
    return [(path, kind.simpleString())]


def leaf_dtypes(df: DataFrame) -> list[tuple[str, str]]:
    return leaf_columns(df.schema)
