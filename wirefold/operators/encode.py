"""Columnar encoding of struct columns as Protobuf messages.

Every field becomes pieces (tag, length, payload), each with the number of
bytes that each row has of it and those bytes end to end.  A message is the
rows' pieces woven together; nested messages are woven first and are a payload
of the level above.  All of it is NumPy over whole columns.

Accepted pairs of types, and what happens to nulls and zeros, follow the
descriptor: a null field is left out (a required scalar gets its default), a
field without presence is left out if it is zero.  Timestamps and intervals
have millisecond precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from google.protobuf.descriptor import Descriptor, FieldDescriptor
from pyspark.sql.pandas.types import from_arrow_type

from wirefold import errors
from wirefold.operators.wire import _WIRE_TYPE, BYTES, FIXED64, VARINT, offsets_of, spread
from wirefold.plans.schema import is_map, well_known

F = FieldDescriptor
#: (bytes that each row has, all bytes in row order)
Piece = tuple[np.ndarray, np.ndarray]

_INT32 = (F.TYPE_INT32, F.TYPE_SINT32, F.TYPE_UINT32, F.TYPE_FIXED32, F.TYPE_SFIXED32)
_INT64 = (F.TYPE_INT64, F.TYPE_SINT64, F.TYPE_UINT64, F.TYPE_FIXED64, F.TYPE_SFIXED64)


def varints(values: np.ndarray) -> Piece:
    """Varints of 64-bit patterns."""
    values = values.view(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        more = values >= np.uint64(1) << np.uint64(7 * k)
        if not more.any():
            break
        size += more
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        low = (values[has] >> np.uint64(7 * k)) & np.uint64(0x7F)
        out[at[has] + k] = low.astype(np.uint8) | np.where(size[has] > k + 1, 0x80, 0).astype(np.uint8)
    return size, out


def weave(pieces: list[Piece], n: int) -> Piece:
    """Each row's bytes of all pieces, piece after piece."""
    total = np.zeros(n, np.int64)
    for size, _ in pieces:
        total += size
    at = np.cumsum(total) - total
    out = np.empty(int(total.sum()), np.uint8)
    for size, data in pieces:
        if len(data):
            width = len(data) // n if n and len(data) % n == 0 else 0
            if width and width <= 16 and (size == width).all():
                out[at[:, None] + np.arange(width)] = data.reshape(n, width)
            else:
                out[spread(at, size)] = data
            at = at + size
    return total, out


def _constant(data: bytes, where: np.ndarray) -> Piece:
    """The same bytes for the rows of a mask."""
    return where.astype(np.int64) * len(data), np.tile(np.frombuffer(data, np.uint8), int(where.sum()))


def _tag(field: FieldDescriptor, wire: int) -> bytes:
    out, v = bytearray(), field.number << 3 | wire
    while v >= 0x80:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def _framed(field: FieldDescriptor, payload: Piece, where: np.ndarray) -> list[Piece]:
    """Tag, length and payload for the rows of a mask; the payload has bytes for those rows only."""
    size = payload[0][where]
    held, data = varints(size.astype(np.uint64))
    length = np.zeros(len(where), np.int64)
    length[where] = held
    return [_constant(_tag(field, BYTES), where), (length, data), payload]


def _grouped(flat: Piece, offsets: np.ndarray) -> Piece:
    """Sizes of list rows from those of their elements."""
    ends = np.concatenate([[0], np.cumsum(flat[0])])
    return ends[offsets[1:]] - ends[offsets[:-1]], flat[1]


def _valid(array: pa.Array) -> np.ndarray:
    return array.is_valid().to_numpy(zero_copy_only=False)


def _numpy(array: pa.Array, kind, fill) -> np.ndarray:
    """Values with nulls filled."""
    if array.null_count:
        array = pc.fill_null(array, pa.scalar(fill, array.type))
    return np.ascontiguousarray(array.to_numpy(zero_copy_only=False).astype(kind, copy=False))


def _list(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0, and the elements of a list or map array; null rows are empty."""
    if array.null_count:  # a null row may cover elements: take leaves them out
        array = array.take(pa.array(np.arange(len(array))))
    offsets = array.offsets.to_numpy().astype(np.int64)
    low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    if pa.types.is_map(array.type):
        values = pa.StructArray.from_arrays([array.keys.slice(low, high - low), array.items.slice(low, high - low)], ["key", "value"])
    else:
        values = array.values.slice(low, high - low)
    return offsets - low, values


class Encoder:
    """Encodes struct arrays of one Arrow type as messages of one descriptor."""

    def __init__(self, descriptor: Descriptor, kind: pa.DataType, case_sensitive: bool = False, strict: bool = False, path: tuple[str, ...] = (), entry: bool = False):
        if not pa.types.is_struct(kind):
            raise errors.cannot_convert_sql_to_message(_show(kind), descriptor.name)
        self.descriptor, self.strict, self.path, self.entry, self.case = descriptor, strict, path, entry, case_sensitive
        same = (lambda a, b: a == b) if case_sensitive else (lambda a, b: a.lower() == b.lower())
        self.parts: list[tuple[int, FieldDescriptor]] = []
        used = set()
        for i in range(kind.num_fields):
            name = kind.field(i).name
            found = [f for f in descriptor.fields if same(f.name, name) and f.type != F.TYPE_GROUP]
            if len(found) > 1:
                exact = [f for f in found if f.name == name]
                if len(exact) != 1:
                    raise errors.several_fields(name, descriptor.full_name, len(found), ", ".join(f.name for f in found))
                found = exact
            if not found:
                raise errors.no_proto_field(_dotted((*path, name)))
            if found[0].number in used:
                raise errors.several_fields(name, "the Catalyst schema", 2, found[0].name)
            used.add(found[0].number)
            self.parts.append((i, found[0]))
        for f in descriptor.fields:
            if f.is_required and f.number not in used:
                raise errors.no_catalyst_field(_dotted((*path, f.name)))
        # fields are written by number, whatever the struct's order
        self.parts.sort(key=lambda p: p[1].number)
        self.inner: dict[int, Encoder] = {}

    def rows(self, array: pa.StructArray) -> Piece:
        """Message bytes of each row; null rows have none."""
        n = len(array)
        null = None if not array.null_count else ~_valid(array)
        columns = array.flatten() if null is not None else [array.field(i) for i in range(array.type.num_fields)]
        pieces: list[Piece] = []
        for i, f in self.parts:
            pieces += self.field(columns[i], f, n, null)
        return weave(pieces, n)

    def column(self, array: pa.StructArray) -> pa.Array:
        size, data = self.rows(array)
        offsets = offsets_of(size)
        valid = pa.py_buffer(np.packbits(_valid(array), bitorder="little").tobytes()) if array.null_count else None
        return pa.Array.from_buffers(pa.binary(), len(array), [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])

    def field(self, array: pa.Array, f: FieldDescriptor, n: int, null: np.ndarray | None) -> list[Piece]:
        if pa.types.is_null(array.type):
            return []
        if is_map(f):
            return self.repeated(array, f)
        if f.is_repeated:
            if not (pa.types.is_list(array.type) or pa.types.is_large_list(array.type)):
                raise self.unfit(array.type, f)
            return self.repeated(array, f)
        where = _valid(array) if array.null_count else np.ones(n, bool)
        if f.is_required and f.message_type is None and not where.all():
            # a required scalar that is null is written as its default; rows that are null themselves stay empty
            array = pc.fill_null(array, pa.scalar(_enum_default(f) if f.cpp_type == F.CPPTYPE_ENUM and pa.types.is_string(array.type) else f.default_value, array.type))
            where = np.ones(n, bool) if null is None else ~null
        wire = _WIRE_TYPE[f.type]
        if f.message_type is not None:
            return _framed(f, self.message(array, f), where)
        implicit = not f.has_presence and not self.entry
        if wire == BYTES:
            size, data = self.blob(array, f)
            if implicit:
                where = where & (size > 0)
            return _framed(f, (size, data), where)
        bits = self.bits(array, f)
        if implicit:
            where = where & (bits != 0)
        size, data = self.scalar(bits[where], wire)
        full = np.zeros(n, np.int64)
        full[where] = size
        return [_constant(_tag(f, wire), where), (full, data)]

    def scalar(self, bits: np.ndarray, wire: int) -> Piece:
        if wire == VARINT:
            return varints(bits)
        width = 8 if wire == FIXED64 else 4
        raw = bits.astype(np.uint64 if width == 8 else np.uint32).view(np.uint8)
        return np.full(len(bits), width, np.int64), raw

    def bits(self, array: pa.Array, f: FieldDescriptor) -> np.ndarray:
        """The 64-bit patterns that a scalar field holds on the wire; nulls are 0."""
        t, kind = array.type, f.type
        if f.cpp_type == F.CPPTYPE_ENUM:
            values = self.symbols(array, f)
        elif kind == F.TYPE_BOOL and pa.types.is_boolean(t):
            return _numpy(array, np.bool_, False).astype(np.uint64)
        elif kind == F.TYPE_FLOAT and pa.types.is_float32(t):
            return _numpy(array, np.float32, 0).view(np.uint32).astype(np.uint64)
        elif kind == F.TYPE_DOUBLE and pa.types.is_float64(t):
            return _numpy(array, np.float64, 0).view(np.uint64)
        elif kind in _INT32 and (pa.types.is_int8(t) or pa.types.is_int16(t) or pa.types.is_int32(t) or pa.types.is_date32(t)):
            values = _numpy(array.cast(pa.int32()), np.int32, 0).astype(np.int64)
        elif kind in _INT64 and pa.types.is_int64(t):
            values = _numpy(array, np.int64, 0)
        else:
            raise self.unfit(t, f)
        if kind in (F.TYPE_SINT32, F.TYPE_SINT64):
            return (values.view(np.uint64) << np.uint64(1)) ^ (values >> 63).view(np.uint64)
        if kind in (F.TYPE_UINT32, F.TYPE_FIXED32, F.TYPE_SFIXED32):
            return values.view(np.uint64) & np.uint64(0xFFFFFFFF)
        return values.view(np.uint64)

    def symbols(self, array: pa.Array, f: FieldDescriptor) -> np.ndarray:
        """Numbers of an enum field; from names, or from the numbers themselves."""
        if pa.types.is_int32(array.type) and not self.strict:
            return _numpy(array, np.int32, 0).astype(np.int64)
        if not (pa.types.is_string(array.type) or pa.types.is_large_string(array.type)):
            raise self.unfit(array.type, f)
        numbers = {v.name: v.number for v in f.enum_type.values}
        coded = array.dictionary_encode()
        table = []
        for name in coded.dictionary.to_pylist():
            if name is not None and name not in numbers:
                raise errors.not_an_enum_symbol(name, _dotted((*self.path, f.name)), ", ".join(numbers), f.full_name)
            table.append(numbers.get(name, 0))
        index = _numpy(coded.indices, np.int64, 0)
        return np.array(table or [0], np.int64)[index]

    def blob(self, array: pa.Array, f: FieldDescriptor) -> Piece:
        t = array.type
        text = pa.types.is_string(t) or pa.types.is_large_string(t)
        if not (text if f.type == F.TYPE_STRING else pa.types.is_binary(t) or pa.types.is_large_binary(t)):
            raise self.unfit(t, f)
        if pa.types.is_large_string(t) or pa.types.is_large_binary(t):
            array = array.cast(pa.string() if text else pa.binary())
        if array.null_count:
            array = pc.fill_null(array, pa.scalar("" if text else b"", array.type))
        n = len(array)
        _, offsets, data = array.buffers()
        at = np.frombuffer(offsets, np.int32, n + 1, array.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        return np.diff(at), raw[at[0] : at[-1]]

    def message(self, array: pa.Array, f: FieldDescriptor) -> Piece:
        t = array.type
        known = well_known(f.message_type)
        if known == "Timestamp" and pa.types.is_timestamp(t):
            millis = _numpy(array.cast(pa.timestamp("us", t.tz)).cast(pa.int64()), np.int64, 0) // 1000
            seconds = millis // 1000  # floor: nanoseconds are never negative
            return self.clock(seconds, (millis - seconds * 1000) * 1_000_000, array)
        if known == "Duration" and pa.types.is_duration(t):
            us = _numpy(array.cast(pa.duration("us")).cast(pa.int64()), np.int64, 0)
            millis = np.sign(us) * (np.abs(us) // 1000)
            seconds = np.sign(millis) * (np.abs(millis) // 1000)  # towards zero: both have the interval's sign
            return self.clock(seconds, (millis - seconds * 1000) * 1_000_000, array)
        if not pa.types.is_struct(t):
            raise self.unfit(t, f)
        return self.nested(f, t).rows(array)

    def clock(self, seconds: np.ndarray, nanos: np.ndarray, array: pa.Array) -> Piece:
        """A message of two varint fields, zeros left out."""
        pieces = []
        valid = _valid(array)
        for tag, values in ((b"\x08", seconds), (b"\x10", nanos)):
            where = (values != 0) & valid
            size, data = varints(values[where].astype(np.int64))
            full = np.zeros(len(values), np.int64)
            full[where] = size
            pieces += [_constant(tag, where), (full, data)]
        return weave(pieces, len(values))

    def nested(self, f: FieldDescriptor, kind: pa.DataType) -> Encoder:
        if f.number not in self.inner:
            self.inner[f.number] = Encoder(f.message_type, kind, self.case, self.strict, (*self.path, f.name), f.message_type.GetOptions().map_entry)
        return self.inner[f.number]

    def repeated(self, array: pa.Array, f: FieldDescriptor) -> list[Piece]:
        if is_map(f) and not (pa.types.is_map(array.type) or pa.types.is_list(array.type)):
            raise self.unfit(array.type, f)
        offsets, values = _list(array)
        n = len(values)
        if values.null_count:
            raise errors.null_array_element(_dotted((*self.path, f.name)))
        every = np.ones(n, bool)
        wire = _WIRE_TYPE[f.type]
        if f.message_type is not None:
            flat = weave(_framed(f, self.message(values, f), every), n)
        elif wire == BYTES:
            flat = weave(_framed(f, self.blob(values, f), every), n)
        else:
            size, data = self.scalar(self.bits(values, f), wire)
            if f.is_packed:
                return _framed(f, _grouped((size, data), offsets), np.diff(offsets) > 0)
            flat = weave([_constant(_tag(f, wire), every), (size, data)], n)
        return [_grouped(flat, offsets)]

    def unfit(self, kind: pa.DataType, f: FieldDescriptor) -> Exception:
        return errors.cannot_convert_catalyst_to_proto(_show(kind), _dotted((*self.path, f.name)), f.full_name, "the types do not correspond")


def _enum_default(f: FieldDescriptor) -> str:
    return f.enum_type.values_by_number[f.default_value].name


def _dotted(path: tuple[str, ...]) -> str:
    return f"field '{'.'.join(path)}'" if path else "top-level record"


def _show(kind: pa.DataType) -> str:
    try:
        return from_arrow_type(kind).simpleString()
    except Exception:
        return str(kind)
