"""Spark schemas of messages, in two dialects.

"wire" (descriptor-set bytes): enums are INT, maps are arrays of entries,
Timestamp and Duration are plain structs; recursion follows mode and depth.
"typed" (descriptor file or class): enums are STRING, maps MAP, Timestamp
TIMESTAMP and Duration an interval; recursion is counted per type.
"""

from __future__ import annotations

from google.protobuf.descriptor import Descriptor, FieldDescriptor
from pyspark.sql import types as T

from wirefold import errors
from wirefold.options import Options

_PLAIN = {
    FieldDescriptor.CPPTYPE_INT32: T.IntegerType(),
    FieldDescriptor.CPPTYPE_UINT32: T.IntegerType(),
    FieldDescriptor.CPPTYPE_INT64: T.LongType(),
    FieldDescriptor.CPPTYPE_UINT64: T.LongType(),
    FieldDescriptor.CPPTYPE_FLOAT: T.FloatType(),
    FieldDescriptor.CPPTYPE_DOUBLE: T.DoubleType(),
    FieldDescriptor.CPPTYPE_BOOL: T.BooleanType(),
}


def is_map(field: FieldDescriptor) -> bool:
    return field.message_type is not None and field.message_type.GetOptions().map_entry and field.is_repeated


def well_known(descriptor: Descriptor | None) -> str | None:
    """Timestamp or Duration, by short name and shape."""
    if descriptor is not None and descriptor.name in ("Timestamp", "Duration") and [f.name for f in descriptor.fields] == ["seconds", "nanos"]:
        return descriptor.name
    return None


def describe(field: FieldDescriptor) -> str:
    return f"{field.containing_type.full_name}.{field.name}"


def _plain(field: FieldDescriptor) -> T.DataType:
    if field.type == FieldDescriptor.TYPE_BYTES:
        return T.BinaryType()
    if field.type == FieldDescriptor.TYPE_STRING:
        return T.StringType()
    found = _PLAIN.get(field.cpp_type)
    if found is None:
        raise errors.unsupported_type(field.type)
    return found


# --- typed dialect -----------------------------------------------------------


def typed_schema(descriptor: Descriptor, options: Options = Options()) -> T.StructType:
    return T.StructType([s for f in descriptor.fields if (s := _typed(f, {descriptor.full_name: 1}, options))])


def _typed(field: FieldDescriptor, seen: dict[str, int], options: Options) -> T.StructField | None:
    if field.type == FieldDescriptor.TYPE_GROUP:
        return None
    message = field.message_type
    if is_map(field):
        parts = {f.name: _typed(f, seen, options) for f in message.fields}
        if parts["key"] is None or parts["value"] is None:
            return None
        return T.StructField(field.name, T.MapType(parts["key"].dataType, parts["value"].dataType, False), True)
    if field.cpp_type == FieldDescriptor.CPPTYPE_ENUM:
        kind: T.DataType = T.StringType()
    elif message is None:
        kind = _plain(field)
    elif (known := well_known(message)) is not None:
        kind = T.TimestampType() if known == "Timestamp" else T.DayTimeIntervalType(0, 3)
    else:
        count = seen.get(message.full_name, 0)
        if count and not 0 < options.depth <= 10:
            raise errors.found_recursion(describe(field))
        if count and count >= options.depth:
            return None
        inner = {**seen, message.full_name: count + 1}
        kind = T.StructType([s for f in message.fields if (s := _typed(f, inner, options))])
        if not kind.fields:
            return None
    if field.is_repeated:
        return T.StructField(field.name, T.ArrayType(kind, False), True)
    return T.StructField(field.name, kind, not field.is_required)


# --- wire dialect ------------------------------------------------------------


def wire_schema(descriptor: Descriptor, options: Options = Options()) -> T.StructType:
    return _Wire(options).message(descriptor, (), 0)


class _Wire:
    """Recursion depth is 0 outside a cycle; the first return to a type on the path is depth 1, and every message field below adds 1."""

    def __init__(self, options: Options):
        self.options = options
        self.limit = options.depth
        self.way = options.recursion or "drop"
        if options.depth < 0:
            self.limit = 0
            if options.recursion in ("", "recursive"):
                # no finite schema is unlimited: some copies are unrolled, the last keeps raw bytes
                self.limit, self.way = options.unroll, "binary"

    def message(self, descriptor: Descriptor, path: tuple[str, ...], depth: int) -> T.StructType:
        path = (*path, descriptor.full_name)
        return T.StructType([s for f in descriptor.fields if (s := self.field(f, path, depth))])

    def field(self, field: FieldDescriptor, path: tuple[str, ...], depth: int) -> T.StructField | None:
        if field.type == FieldDescriptor.TYPE_GROUP:
            return None
        message = field.message_type
        if is_map(field):
            if depth and depth + 1 > self.limit:
                return None  # the entry is a message inside a cycle as well
            parts = {f.name: self.field(f, path, depth) for f in message.fields}
            if parts["key"] is None or parts["value"] is None:
                return None
            entry = T.StructType([T.StructField("key", parts["key"].dataType, False), T.StructField("value", parts["value"].dataType, True)])
            return T.StructField(field.name, T.ArrayType(entry), True)
        if field.cpp_type == FieldDescriptor.CPPTYPE_ENUM:
            kind: T.DataType | None = T.IntegerType()
        elif message is None:
            kind = _plain(field)
        else:
            kind = self.nested(field, message, path, depth)
            if kind is None:
                return None
        return T.StructField(field.name, T.ArrayType(kind) if field.is_repeated else kind, True)

    def nested(self, field: FieldDescriptor, message: Descriptor, path: tuple[str, ...], depth: int) -> T.DataType | None:
        again = message.full_name in path
        below = depth + 1 if again or depth else 0
        if again and self.options.recursion == "fail":
            raise errors.recursive_field(field.name, message.full_name)
        if below > self.limit:
            # a message that is not recursive itself goes, even where recursive ones stay as bytes
            return T.BinaryType() if again and self.way == "binary" else None
        return self.message(message, path, below)


def mocked_fields(descriptor: Descriptor) -> list[str]:
    """Dotted paths of the fields that return to a message on their own path."""
    out: list[str] = []

    def walk(d: Descriptor, path: tuple[str, ...], names: tuple[str, ...]) -> None:
        for f in d.fields:
            if f.message_type is not None and f.type != FieldDescriptor.TYPE_GROUP:
                if f.message_type.full_name in path:
                    out.append(".".join([*names, f.name]))
                else:
                    walk(f.message_type, (*path, f.message_type.full_name), (*names, f.name))

    walk(descriptor, (descriptor.full_name,), ())
    return out


class RecursiveSchema:
    """Text of a cyclic schema: a type that returns is written as a marker."""

    def __init__(self, descriptor: Descriptor):
        self.descriptor = descriptor

    def text(self, d: Descriptor | None = None, path: tuple[str, ...] = ()) -> str:
        d = d or self.descriptor
        path = (*path, d.full_name)
        parts = []
        for f in d.fields:
            if f.type == FieldDescriptor.TYPE_GROUP:
                continue
            m = f.message_type
            if f.cpp_type == FieldDescriptor.CPPTYPE_ENUM:
                kind = "int"
            elif m is None:
                kind = _plain(f).simpleString()
            elif m.full_name in path:
                kind = f"recursive:{m.name}"
            else:
                kind = self.text(m, path)
            parts.append(f"{f.name}:{f'array<{kind}>' if f.is_repeated else kind}")
        return f"struct<{','.join(parts)}>"

    simpleString = catalogString = sql = __str__ = text


def schema_info(descriptor: Descriptor, options: Options = Options()) -> str:
    """A message's schema tree and its recursive fields, for reading."""
    lines = [f"message {descriptor.full_name}", wire_schema(descriptor, options).treeString().rstrip()]
    mocked = mocked_fields(descriptor)
    return "\n".join([*lines, f"recursive fields: {', '.join(mocked) or 'none'}"])


def schema_of(descriptor: Descriptor, dialect: str, options: Options = Options()) -> T.StructType:
    return wire_schema(descriptor, options) if dialect == "wire" else typed_schema(descriptor, options)
