"""Path algebra for nested schema pruning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

from wirefold import errors


def _struct_in(kind: T.DataType) -> T.StructType | None:
    """The struct that fields below a column lie in; arrays and map values are transparent."""
    if isinstance(kind, T.StructType):
        return kind
    if isinstance(kind, T.ArrayType):
        return _struct_in(kind.elementType)
    if isinstance(kind, T.MapType):
        return _struct_in(kind.valueType)
    return None


def _with(kind: T.DataType, struct: T.StructType) -> T.DataType:
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_with(kind.elementType, struct), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _with(kind.valueType, struct), kind.valueContainsNull)
    return struct


def prune_schema(schema: T.StructType, paths: Iterable[str]) -> T.StructType:
    """Keep a field if a path is a prefix of its path, or its path of one; no paths keep nothing.

    The empty path stands for the whole message and keeps everything.
    """
    wanted = [tuple(p.split(".")) if p else () for p in paths]

    def keep(struct: T.StructType, at: tuple[str, ...]) -> T.StructType:
        out = []
        for f in struct.fields:
            here = (*at, f.name)
            if any(p == here[: len(p)] for p in wanted):
                out.append(f)
            elif any(here == p[: len(here)] for p in wanted):
                inner = _struct_in(f.dataType)
                out.append(f if inner is None else T.StructField(f.name, _with(f.dataType, keep(inner, here)), f.nullable))
        return T.StructType(out)

    return keep(schema, ())


def required_paths(schema: T.StructType) -> list[str]:
    """Paths of all fields; arrays and maps add no segment."""
    out: list[str] = []

    def walk(struct: T.StructType, at: str) -> None:
        for f in struct.fields:
            here = f"{at}.{f.name}" if at else f.name
            out.append(here)
            inner = _struct_in(f.dataType)
            if inner is not None:
                walk(inner, here)

    walk(schema, "")
    return out


def leaf_paths(schema: T.StructType) -> list[str]:
    """Paths of the fields that hold no others."""
    paths = required_paths(schema)
    inner = {p.rpartition(".")[0] for p in paths}
    return [p for p in paths if p not in inner]


def check_paths(schema: T.StructType, paths: Iterable[str]) -> None:
    known = set(required_paths(schema))
    for p in paths:
        if p and p not in known:
            raise errors.unknown_path(p)
