"""Columnar decoding of the Protobuf wire format (the "wire" dialect).

A column of messages is parsed in lockstep: each step reads one field of every
message that has bytes left, with NumPy operations over all of them, and files
the values by field.  Messages of one type mostly hold the same fields in the
same order, so a step handles thousands of messages at once.  Nested messages
are kept as byte ranges and parsed the same way, level by level, and only for
fields that the schema asks for.  A few long messages that outlast the others
are finished one by one.

Semantics: a field is null iff it is absent; the last occurrence of a singular
field wins, messages are not merged; packed and unpacked forms are accepted for
every packable repeated field; a field of another wire type than declared, and
an unknown field or a group, is skipped; enums are numbers, unsigned numbers keep their
bits; strings are taken as they are; an absent repeated field is null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from google.protobuf.descriptor import Descriptor, FieldDescriptor
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wirefold import errors

VARINT, FIXED64, BYTES, START, END, FIXED32 = range(6)
#: With at most so many messages left and this many steps done, the rest is parsed one by one.
FEW, STEPS = 8, 64

F = FieldDescriptor
_WIRE_TYPE = {
    **dict.fromkeys((F.TYPE_INT32, F.TYPE_INT64, F.TYPE_UINT32, F.TYPE_UINT64, F.TYPE_SINT32, F.TYPE_SINT64, F.TYPE_BOOL, F.TYPE_ENUM), VARINT),
    **dict.fromkeys((F.TYPE_FIXED64, F.TYPE_SFIXED64, F.TYPE_DOUBLE), FIXED64),
    **dict.fromkeys((F.TYPE_FIXED32, F.TYPE_SFIXED32, F.TYPE_FLOAT), FIXED32),
    **dict.fromkeys((F.TYPE_STRING, F.TYPE_BYTES, F.TYPE_MESSAGE), BYTES),
}
_NUMPY = {
    F.TYPE_DOUBLE: np.float64,
    F.TYPE_FLOAT: np.float32,
    F.TYPE_BOOL: np.bool_,
    **dict.fromkeys((F.TYPE_INT32, F.TYPE_UINT32, F.TYPE_SINT32, F.TYPE_FIXED32, F.TYPE_SFIXED32, F.TYPE_ENUM), np.int32),
    **dict.fromkeys((F.TYPE_INT64, F.TYPE_UINT64, F.TYPE_SINT64, F.TYPE_FIXED64, F.TYPE_SFIXED64), np.int64),
}


@dataclass
class Field:
    """One field of the required schema."""

    name: str
    number: int
    type: int
    wire: int
    repeated: bool
    arrow: pa.DataType  # of one value
    child: Node | None = None
    key_default: bool = False  # an absent map key has its type's default

    @property
    def packable(self) -> bool:
        return self.repeated and self.wire != BYTES


@dataclass
class Node:
    """A message type as far as a schema asks for it."""

    fields: list[Field]
    by_number: dict[int, int] = field(default_factory=dict)
    arrow: pa.StructType | None = None

    def __post_init__(self):
        self.by_number = {f.number: i for i, f in enumerate(self.fields)}


def plan(descriptor: Descriptor, schema: T.StructType) -> Node:
    """Match a schema's fields with the descriptor's by name; the schema's order holds."""
    by_name = descriptor.fields_by_name
    out = []
    for s in schema.fields:
        d = by_name.get(s.name)
        if d is None:
            raise errors.no_proto_field(s.name)
        kind = s.dataType.elementType if d.is_repeated and isinstance(s.dataType, T.ArrayType) else s.dataType
        child = plan(d.message_type, kind) if isinstance(kind, T.StructType) else None
        f = Field(s.name, d.number, d.type, _WIRE_TYPE[d.type], d.is_repeated, child.arrow if child else to_arrow_type(kind), child)
        f.key_default = descriptor.GetOptions().map_entry and d.name == "key"
        out.append(f)
    node = Node(out)
    node.arrow = pa.struct([pa.field(f.name, pa.list_(f.arrow) if f.repeated else f.arrow) for f in out])
    return node


# --- varints -----------------------------------------------------------------


def read_varints(buf: np.ndarray, pos: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (64 bits), positions behind them, and which are whole; ``buf`` is padded by 16 bytes."""
    byte = buf[pos]
    value = (byte & 0x7F).astype(np.uint64)
    more = np.flatnonzero(byte & 0x80)
    after = pos + 1
    good = after <= end
    shift = 7
    while len(more):
        if shift > 63:
            good[more] = False
            break
        at = after[more]
        whole = at < end[more]
        good[more[~whole]] = False
        more, at = more[whole], at[whole]
        byte = buf[at]
        value[more] |= (byte & 0x7F).astype(np.uint64) << np.uint64(shift)
        after[more] = at + 1
        more = more[(byte & 0x80) != 0]
        shift += 7
    return value, after, good


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start .. start + length of each range, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    skips = np.cumsum(lengths) - lengths
    return np.repeat(starts - skips, lengths) + np.arange(total)


def unpack_varints(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All varints of byte ranges: values, how many each range has, and which ranges are well formed."""
    raw = buf[spread(starts, lengths)]
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
    last = raw < 0x80
    ends = np.cumsum(lengths)
    stops = np.cumsum(last)
    counts = np.diff(np.concatenate([[0], np.concatenate([[0], stops])[ends]]))
    nonempty = lengths > 0
    good = np.ones(len(starts), bool)
    good[nonempty] = last[ends[nonempty] - 1]
    where = np.flatnonzero(last)
    first = np.concatenate([[0], where[:-1] + 1]) if len(where) else np.empty(0, np.int64)
    size = where - first + 1
    if len(size) and size.max() > 10:
        which = np.searchsorted(ends, first[size > 10], side="right")
        good[which] = False
    value = np.zeros(len(where), np.uint64)
    for k in range(int(min(size.max(), 10)) if len(size) else 0):
        has = size > k
        value[has] |= (raw[first[has] + k] & 0x7F).astype(np.uint64) << np.uint64(7 * k)
    return value, counts, good


def convert(raw: np.ndarray, kind: int) -> np.ndarray:
    """64-bit patterns as values of a type."""
    if kind in (F.TYPE_SINT32, F.TYPE_SINT64):
        if kind == F.TYPE_SINT32:
            raw = raw & np.uint64(0xFFFFFFFF)
        raw = (raw >> np.uint64(1)) ^ (np.uint64(0) - (raw & np.uint64(1)))
    if kind == F.TYPE_BOOL:
        return raw != 0
    if kind == F.TYPE_DOUBLE:
        return raw.view(np.float64)
    to = _NUMPY[kind]
    if to is np.int64:
        return raw.view(np.int64)
    low = raw.astype(np.uint32)
    return low.view(np.float32) if kind == F.TYPE_FLOAT else low.view(np.int32)


# --- one level of messages ---------------------------------------------------


class _Level:
    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, node: Node):
        self.buf, self.node = buf, node
        self.pos, self.end = starts.copy(), ends
        n = len(starts)
        self.bad = np.zeros(n, bool)
        self.seen: list[np.ndarray | None] = [None] * len(node.fields)
        self.values: list[np.ndarray | None] = [None] * len(node.fields)
        self.lists: list[list[tuple[np.ndarray, ...]]] = [[] for _ in node.fields]
        self.n = n

    def parse(self) -> None:
        live = np.flatnonzero(self.pos < self.end)
        steps = 0
        while len(live):
            steps += 1
            if len(live) <= FEW and steps > STEPS:
                for i in live.tolist():
                    self.finish(i)
                return
            tag, after, good = read_varints(self.buf, self.pos[live], self.end[live])
            if not good.all():
                self.bad[live[~good]] = True
                live, tag, after = live[good], tag[good], after[good]
            tag = tag & np.uint64(0xFFFFFFFF)
            left = np.arange(len(live))
            while len(left):
                t = int(tag[left[0]])
                same = tag[left] == tag[left[0]]
                part = left[same] if not same.all() else left
                left = left[~same] if len(part) < len(left) else left[:0]
                self.step(t, live[part], after[part])
            live = live[(self.pos[live] < self.end[live]) & ~self.bad[live]]

    def step(self, tag: int, rows: np.ndarray, at: np.ndarray) -> None:
        """Read the field with this tag of these messages."""
        number, wire = tag >> 3, tag & 7
        end = self.end[rows]
        index = self.node.by_number.get(number)
        if number == 0 or wire > FIXED32:
            self.bad[rows] = True
            return
        if wire == END:  # the end of no group is skipped
            self.pos[rows] = at
            return
        if wire == VARINT:
            value, after, good = read_varints(self.buf, at, end)
            stop = None
        elif wire == BYTES:
            size, after, good = read_varints(self.buf, at, end)
            size = np.minimum(size, np.uint64(1 << 40)).astype(np.int64)
            value, stop = after, after + size
            good &= stop <= end
            after = stop
        elif wire == START:
            for i, p in zip(rows.tolist(), at.tolist()):
                stopped = self.skip_group(p, int(self.end[i]), number)
                if stopped is None:
                    self.bad[i] = True
                else:
                    self.pos[i] = stopped
            return
        else:
            width = 8 if wire == FIXED64 else 4
            after, stop = at + width, None
            good = after <= end
            value = None
        if not good.all():
            self.bad[rows[~good]] = True
            rows, at, after = rows[good], at[good], after[good]
            value = value[good] if value is not None else None
            stop = stop[good] if stop is not None else None
        self.pos[rows] = after
        if index is None or not len(rows):
            return
        f = self.node.fields[index]
        if wire == f.wire:
            if wire in (FIXED64, FIXED32):
                value = self.fixed(at, 8 if wire == FIXED64 else 4)
            if f.repeated:
                self.lists[index].append((rows, value) if stop is None else (rows, value, stop))
            else:
                self.put(index, f, rows, value, stop)
        elif wire == BYTES and f.packable:
            self.packed(index, f, rows, value, stop)
        else:
            self.mismatch(rows)

    def mismatch(self, rows: np.ndarray) -> None:
        """A known field has another wire type than declared: it is skipped."""

    def fixed(self, at: np.ndarray, width: int) -> np.ndarray:
        raw = self.buf[at[:, None] + np.arange(width)]
        return raw.view(np.uint64 if width == 8 else np.uint32)[:, 0].astype(np.uint64)

    def put(self, index: int, f: Field, rows, value, stop) -> None:
        if self.seen[index] is None:
            self.seen[index] = np.zeros(self.n, bool)
            self.values[index] = np.zeros((2, self.n), np.int64) if f.wire == BYTES else np.zeros(self.n, np.uint64)
        self.seen[index][rows] = True
        if f.wire == BYTES:
            self.values[index][0, rows], self.values[index][1, rows] = value, stop
        else:
            self.values[index][rows] = value

    def packed(self, index: int, f: Field, rows, start, stop) -> None:
        size = stop - start
        if f.wire == VARINT:
            value, counts, good = unpack_varints(self.buf, start, size)
        else:
            width = 8 if f.wire == FIXED64 else 4
            good = size % width == 0
            counts = size // width
            value = self.fixed(spread(start, counts * width)[::width], width) if counts.any() else np.empty(0, np.uint64)
        self.bad[rows[~good]] = True
        if len(value):
            self.lists[index].append((np.repeat(rows, counts), value))

    # --- the slow path: one message

    def _varint(self, p: int, end: int) -> tuple[int, int] | None:
        value = shift = 0
        while p < end and shift < 70:
            b = int(self.buf[p])
            value |= (b & 0x7F) << shift
            p, shift = p + 1, shift + 7
            if b < 0x80:
                return value & 0xFFFFFFFFFFFFFFFF, p
        return None

    def skip_group(self, p: int, end: int, number: int) -> int | None:
        """Position behind the end of a group, or None."""
        open_groups = [number]
        while open_groups:
            found = self._varint(p, end)
            if found is None:
                return None
            tag, p = found[0] & 0xFFFFFFFF, found[1]
            wire = tag & 7
            if wire == START:
                open_groups.append(tag >> 3)
            elif wire == END:
                if open_groups.pop() != tag >> 3:
                    return None
            elif wire == VARINT:
                if (found := self._varint(p, end)) is None:
                    return None
                p = found[1]
            elif wire == BYTES:
                if (found := self._varint(p, end)) is None:
                    return None
                p = found[0] + found[1]
            elif wire in (FIXED64, FIXED32):
                p += 8 if wire == FIXED64 else 4
            else:
                return None
            if p > end:
                return None
        return p

    def finish(self, i: int) -> None:
        """Parse the rest of one message; long runs of one unpacked field are the usual case."""
        end, p = int(self.end[i]), int(self.pos[i])
        runs: dict[int, list] = {}
        spans: dict[int, list] = {}
        row = np.array([i])

        def flush():
            for index, held in runs.items():
                if held:
                    self.lists[index].append((np.full(len(held), i), np.array(held, np.uint64)))
            for index, held in spans.items():
                if held:
                    a = np.array(held, np.int64)
                    self.lists[index].append((np.full(len(held), i), a[:, 0], a[:, 1]))
            runs.clear()
            spans.clear()

        while p < end:
            found = self._varint(p, end)
            if found is None:
                self.bad[i] = True
                break
            tag, at = found[0] & 0xFFFFFFFF, found[1]
            index = self.node.by_number.get(tag >> 3)
            f = self.node.fields[index] if index is not None else None
            if f is not None and f.repeated and f.wire == tag & 7 == VARINT and (got := self._varint(at, end)):
                runs.setdefault(index, []).append(got[0])
                p = got[1]
            elif f is not None and f.repeated and f.wire == tag & 7 == BYTES and (got := self._varint(at, end)) and got[0] + got[1] <= end:
                spans.setdefault(index, []).append((got[1], got[0] + got[1]))
                p = got[0] + got[1]
            elif f is not None and f.repeated and f.wire == tag & 7 in (FIXED32, FIXED64) and at + (w := 8 if f.wire == FIXED64 else 4) <= end:
                runs.setdefault(index, []).append(int.from_bytes(self.buf[at : at + w].tobytes(), "little"))
                p = at + w
            else:
                flush()
                self.pos[i] = at
                self.step(tag, row, np.array([at]))
                if self.bad[i]:
                    break
                p = int(self.pos[i])
        flush()
        self.pos[i] = end

    # --- Arrow

    def column(self, index: int) -> pa.Array:
        f = self.node.fields[index]
        if f.repeated:
            return self.list_column(index, f)
        seen, values = self.seen[index], self.values[index]
        if seen is None:
            if f.key_default:
                return _defaults(f, self.n)
            return pa.nulls(self.n, f.arrow)
        if f.wire != BYTES:
            out = _plain(convert(values, f.type), f.arrow, None if f.key_default else seen)
        elif f.child is None:
            out = _blobs(self.buf, values[0], values[1], f.arrow, None if f.key_default else seen)
        else:
            rows = np.flatnonzero(seen)
            inner, bad = decode(self.buf, values[0][rows], values[1][rows], f.child)
            self.bad[rows[bad]] = True
            take = np.full(self.n, -1, np.int64)
            take[rows] = np.arange(len(rows))
            out = inner.take(pa.array(take, mask=~seen))
        return out

    def list_column(self, index: int, f: Field) -> pa.Array:
        parts = self.lists[index]
        if not parts:
            return pa.nulls(self.n, pa.list_(f.arrow))
        rows = np.concatenate([p[0] for p in parts])
        order = None
        if len(parts) > 1:
            order = np.argsort(rows, kind="stable")
        counts = np.bincount(rows, minlength=self.n)
        columns = [np.concatenate([p[k] for p in parts]) for k in range(1, len(parts[0]))]
        if order is not None:
            columns, rows = [c[order] for c in columns], rows[order]
        if f.wire != BYTES:
            values = _plain(convert(columns[0], f.type), f.arrow, None)
        elif f.child is None:
            values = _blobs(self.buf, columns[0], columns[1], f.arrow, None)
        else:
            values, bad = decode(self.buf, columns[0], columns[1], f.child)
            self.bad[rows[bad]] = True
        offsets = offsets_of(counts)
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(counts == 0))


def _plain(values: np.ndarray, arrow: pa.DataType, seen: np.ndarray | None) -> pa.Array:
    return pa.array(values, arrow, mask=None if seen is None else ~seen)


def offsets_of(sizes: np.ndarray) -> np.ndarray:
    """32-bit offsets of values end to end, which Spark's columns have."""
    out = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    if out[-1] >= 1 << 31:
        raise errors.batch_too_large(int(out[-1]))
    return out.astype(np.int32)


def _blobs(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray, arrow: pa.DataType, seen: np.ndarray | None) -> pa.Array:
    """Byte ranges as strings or binaries; strings are not checked, as the bytes are copied as they are."""
    size = stops - starts
    offsets = offsets_of(size)
    data = buf[spread(starts, size)]
    valid = None if seen is None else pa.py_buffer(np.packbits(seen, bitorder="little").tobytes())
    return pa.Array.from_buffers(arrow, len(starts), [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _defaults(f: Field, n: int) -> pa.Array:
    if f.wire != BYTES:
        return _plain(np.zeros(n, _NUMPY[f.type]), f.arrow, None)
    return pa.array([""] * n if f.type == F.TYPE_STRING else [b""] * n, f.arrow)


def struct(columns: list[pa.Array], kind: pa.StructType, n: int, null: np.ndarray | None = None) -> pa.StructArray:
    """A struct array of n rows; structs without fields keep their length."""
    mask = None if null is None or not null.any() else pa.array(null)
    if not columns:
        return pa.array([None if null is not None and null[i] else {} for i in range(n)], kind)
    return pa.StructArray.from_arrays(columns, fields=list(kind), mask=mask)


def decode(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, node: Node) -> tuple[pa.StructArray, np.ndarray]:
    """Messages of byte ranges as a struct array, and which are malformed."""
    level = _Level(buf, starts, ends, node)
    level.parse()
    columns = [level.column(i) for i in range(len(node.fields))]
    return struct(columns, node.arrow, level.n), level.bad


def ranges(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded bytes of a binary column, each value's start and end, and which are null."""
    if pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width, n + 1, column.offset * np.dtype(width).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    low = int(at[0])
    buf = np.zeros(int(at[-1]) - low + 16, np.uint8)
    buf[: int(at[-1]) - low] = raw[low : int(at[-1])]
    null = ~column.is_valid().to_numpy(zero_copy_only=False) if column.null_count else np.zeros(n, bool)
    starts, ends = at[:-1] - low, at[1:] - low
    return buf, starts, np.where(null, starts, ends), null


def decode_column(column: pa.Array, node: Node, permissive) -> pa.StructArray:
    """Decode a binary column; ``permissive()`` says whether malformed messages become null."""
    buf, starts, ends, null = ranges(column)
    level = _Level(buf, starts, ends, node)
    level.parse()
    columns = [level.column(i) for i in range(len(node.fields))]
    bad = level.bad & ~null
    if bad.any() and not permissive():
        raise errors.malformed()
    return struct(columns, node.arrow, len(null), null | bad)
