"""The columnar decoder and encoder against the runtime and a plain decoder."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wirefold import errors
from wirefold.operators import encode, runtime, wire
from wirefold.options import Options
from wirefold.plans import schema as S
from wirefold.sources.descriptors import define, descriptor_of, message_class

SCALARS = "int32 int64 uint32 uint64 sint32 sint64 fixed32 fixed64 sfixed32 sfixed64 float double bool string bytes".split()
PRIMS = [(f"{t}_field", i + 1, t) for i, t in enumerate(SCALARS)] + [("status_field", 16, "Status")]
RAW = define(
    "testproto",
    {
        "Prims": PRIMS,
        "Lists": [(n.replace("field", "list"), i, f"repeated {t}") for n, i, t in PRIMS],
        "Loose": [(n.replace("field", "list"), i, f"repeated {t}" if t in ("string", "bytes") else f"unpacked {t}") for n, i, t in PRIMS],
        "Complete": [("type", 1, "Status"), ("prims", 2, "Prims"), ("lists", 3, "Lists"), ("id", 4, "string"), ("counts", 5, "map string int32"), ("parts", 6, "map int64 Prims"), ("many", 7, "repeated Prims")],
        "Empty": [],
        "Holder": [("empty", 1, "Empty"), ("empties", 2, "repeated Empty"), ("n", 300, "int32")],
    },
    {"Status": {"UNKNOWN": 0, "ACTIVE": 1, "INACTIVE": 2, "PENDING": 3}},
)
RANGES = {
    "int32": st.integers(-(2**31), 2**31 - 1), "sint32": st.integers(-(2**31), 2**31 - 1), "sfixed32": st.integers(-(2**31), 2**31 - 1),
    "int64": st.integers(-(2**63), 2**63 - 1), "sint64": st.integers(-(2**63), 2**63 - 1), "sfixed64": st.integers(-(2**63), 2**63 - 1),
    "uint32": st.integers(0, 2**32 - 1), "fixed32": st.integers(0, 2**32 - 1), "uint64": st.integers(0, 2**64 - 1), "fixed64": st.integers(0, 2**64 - 1),
    "float": st.floats(-1000, 1000, width=32), "double": st.floats(-1000, 1000), "bool": st.booleans(), "string": st.text(max_size=50), "bytes": st.binary(max_size=10), "status": st.integers(0, 3),
}


def signed(value, kind):
    bits = {"uint32": 32, "fixed32": 32, "uint64": 64, "fixed64": 64}.get(kind)
    return value - (1 << bits) if bits and value >= 1 << (bits - 1) else value


def decoded(name, *messages, options=Options(), permissive=False, schema=None, raw=RAW):
    d = descriptor_of(raw, f"testproto.{name}" if "." not in name else name)
    node = wire.plan(d, schema or S.wire_schema(d, options))
    out = wire.decode_column(pa.array(messages, pa.binary()), node, lambda: permissive)
    out.validate(full=True)
    return out.to_pylist()


prims = st.fixed_dictionaries({}, optional={f"{t}_field": RANGES[t] for t in [*SCALARS, "status"]})
lists = st.fixed_dictionaries({}, optional={f"{t}_list": st.lists(RANGES[t], min_size=1, max_size=5) for t in [*SCALARS, "status"]})


def plain(values):
    """What the wire dialect makes of values that a proto3 message was given."""
    out = dict.fromkeys(f"{t}_field" for t in [*SCALARS, "status"])
    for k, v in values.items():
        minus_zero = isinstance(v, float) and str(v) == "-0.0"
        if v not in (0, "", b"", False) or minus_zero:
            out[k] = signed(v, k.split("_")[0])
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(prims, max_size=8))
def test_primitives_equal_the_runtime(rows):
    cls = message_class(RAW, "testproto.Prims")
    assert decoded("Prims", *(cls(**r).SerializeToString() for r in rows)) == [plain(r) for r in rows]


@settings(max_examples=60, deadline=None)
@given(st.lists(lists, max_size=6), st.sampled_from(["Lists", "Loose"]), st.sampled_from(["Lists", "Loose"]))
def test_lists_packed_or_not(rows, written, read):
    cls = message_class(RAW, f"testproto.{written}")
    want = [{f"{t}_list": [signed(v, t) for v in r[f"{t}_list"]] if f"{t}_list" in r else None for t in [*SCALARS, "status"]} for r in rows]
    assert decoded(read, *(cls(**r).SerializeToString() for r in rows)) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.fixed_dictionaries({"id": st.text(max_size=5)}, optional={"prims": prims, "lists": lists, "many": st.lists(prims, max_size=3), "counts": st.dictionaries(st.text(max_size=4), RANGES["int32"], max_size=3), "parts": st.dictionaries(RANGES["int64"], prims, max_size=2)}), max_size=5))
def test_encoding_gives_back_the_message(rows):
    cls = message_class(RAW, "testproto.Complete")
    messages = []
    for r in rows:
        m = cls(**{k: v for k, v in r.items() if k != "parts"})
        for k, v in r.get("parts", {}).items():
            m.parts[k].CopyFrom(message_class(RAW, "testproto.Prims")(**v))
        messages.append(m)
    d = descriptor_of(RAW, "testproto.Complete")
    raw = pa.array([m.SerializeToString() for m in messages], pa.binary())
    for dialect in ("wire", "typed", "generated"):
        kind = S.schema_of(d, dialect)
        if dialect == "wire":
            column = wire.decode_column(raw, wire.plan(d, kind), lambda: False)
        else:
            column = runtime.decode_column(raw, kind, runtime.row_decoder(d, kind, dialect, lambda: False))
        back = encode.Encoder(d, column.type).column(column).to_pylist()
        assert [cls.FromString(b) for b in back] == messages


def test_absent_is_null_and_explicit_zero_is_not():
    assert decoded("Prims", b"")[0] == dict.fromkeys(f"{t}_field" for t in [*SCALARS, "status"])
    row = decoded("Prims", b"\x08\x00\x72\x00")[0]
    assert row["int32_field"] == 0 and row["string_field"] == "" and row["int64_field"] is None
    assert decoded("Prims", None) == [None]
    assert decoded("Lists", b"")[0]["int32_list"] is None


def test_last_value_wins_and_messages_do_not_merge():
    one, two = b"\x12\x02\x08\x05", b"\x12\x02\x10\x06"
    assert decoded("Complete", one + two)[0]["prims"]["int32_field"] is None
    assert decoded("Prims", b"\x08\x01\x08\x02")[0]["int32_field"] == 2


def test_other_wire_types_and_unknown_fields_are_skipped():
    # field 14 is a string; here it is a varint; 999 is unknown, in every wire type
    unknown = b"\xb8\x3e\x05" + b"\xb9\x3e" + b"x" * 8 + b"\xbd\x3e" + b"x" * 4 + b"\xba\x3e\x03abc" + b"\xbb\x3e\x08\x01\x13\x14\xbc\x3e"
    row = decoded("Prims", unknown + b"\x70\x05\x08\x09")[0]
    assert row["string_field"] is None and row["int32_field"] == 9
    # groups are skipped, known number or not, and so is the end of none
    assert decoded("Prims", b"\x0b\x08\x05\x0c\x10\x07\x0c")[0]["int64_field"] == 7


@pytest.mark.parametrize("raw", [b"\xff\xff\xff", b"\x72\x05ab", b"\x08", b"\x00\x01", b"\x0b\x08\x01", b"\x0b\x14", b"\x09\x01\x02", b"\x0e", b"\x08" + b"\xff" * 11])
def test_malformed(raw):
    with pytest.raises(errors.MalformedMessage, match="Malformed Protobuf message detected during parsing"):
        decoded("Prims", raw)
    assert decoded("Prims", raw, b"\x08\x01", permissive=True)[0] is None


def test_malformed_inside_nested_nulls_the_row():
    assert decoded("Complete", b"\x12\x01\x08", b"\x22\x01a", b"\x3a\x02\x08\xff", permissive=True)[::2] == [None, None]
    # in a field that the schema leaves out it is not seen
    d = descriptor_of(RAW, "testproto.Complete")
    only = S.T.StructType([S.wire_schema(d)["id"]])
    assert decoded("Complete", b"\x12\x01\x08\x22\x01a", schema=only) == [{"id": "a"}]


def test_empty_messages_and_large_numbers():
    assert decoded("Empty", b"", b"\x08\x01") == [{}, {}]
    assert decoded("Holder", b"\x0a\x00\x12\x00\x12\x00\xe0\x12\x07", b"") == [{"empty": {}, "empties": [{}, {}], "n": 7}, {"empty": None, "empties": None, "n": None}]


@pytest.mark.parametrize("size", [0, 1, 64, 65, 1000, 5000])
def test_long_lists_beside_short_ones(size):
    cls = message_class(RAW, "testproto.Loose")
    raw = [cls(int32_list=range(-3, size - 3), string_list=["s"] * (size // 2), double_list=[0.5] * size).SerializeToString(), cls(int64_list=[1]).SerializeToString()]
    rows = decoded("Loose", *raw)
    assert (rows[0]["int32_list"] or []) == list(range(-3, size - 3)) and len(rows[0]["double_list"] or []) == size and len(rows[0]["string_list"] or []) == size // 2
    assert rows[1]["int64_list"] == [1]


def test_sliced_input():
    cls = message_class(RAW, "testproto.Prims")
    column = pa.array([cls(int32_field=i, string_field="x" * i).SerializeToString() if i % 3 else None for i in range(20)], pa.binary()).slice(5, 9)
    d = descriptor_of(RAW, "testproto.Prims")
    out = wire.decode_column(column, wire.plan(d, S.wire_schema(d)), lambda: False).to_pylist()
    assert [r and r["int32_field"] for r in out] == [i if i % 3 else None for i in range(5, 14)]
    # a sliced struct column is encoded as it stands
    structs = pa.array([{"int32_field": i, "string_field": "y" * i} for i in range(9)]).slice(2, 5)
    kind = structs.cast(pa.struct([("int32_field", pa.int32()), ("string_field", pa.string())]))
    assert [cls.FromString(b).int32_field for b in encode.Encoder(d, kind.type).column(kind).to_pylist()] == [2, 3, 4, 5, 6]


def test_schema_order_is_free():
    d = descriptor_of(RAW, "testproto.Prims")
    full = S.wire_schema(d)
    kind = S.T.StructType([full["string_field"], full["int32_field"]])
    cls = message_class(RAW, "testproto.Prims")
    assert decoded("Prims", cls(int32_field=3, string_field="z").SerializeToString(), schema=kind) == [{"string_field": "z", "int32_field": 3}]


@settings(max_examples=120, deadline=None)
@given(st.data(), st.sampled_from(["typed", "generated"]))
def test_columnar_typed_equals_the_runtime(data, dialect):
    """Ordinary, cut, repeated and foreign messages: the columns are what the runtime gives row by row."""
    from wirefold.operators import typed

    name = data.draw(st.sampled_from(["Prims", "Lists", "Complete"]))
    shape = {"Prims": prims, "Lists": lists, "Complete": st.fixed_dictionaries({"id": st.text(max_size=3)}, optional={"prims": prims, "lists": lists, "many": st.lists(prims, max_size=2), "type": RANGES["status"], "counts": st.dictionaries(st.text(max_size=3), RANGES["int32"], max_size=2)})}[name]
    cls = message_class(RAW, f"testproto.{name}")
    raw = [cls(**r).SerializeToString() for r in data.draw(st.lists(shape, max_size=6))]
    raw += [a + b for a, b in zip(raw, raw[1:])]  # fields given twice
    raw += [b"", None, b"\x08\x00", b"\x80\x01\x63", b"\x72\x02\xff\xfe", b"\x72\x01\xc3" + b"\x72\x01\x80", b"\xff\xff", b"\x70\x05", b"\xf2\x3e\x01x", b"\x2a\x00", b"\x2a\x02\x0a\x00\x2a\x02\x10\x05", b"\x32\x02\x08\x01", b"\x12\x00", b"\x22\x02\xc3\xa9"]
    d = descriptor_of(RAW, f"testproto.{name}")
    kind = S.typed_schema(d)
    column = pa.array(raw, pa.binary())
    got = typed.column_decoder(d, kind, dialect, lambda: True)(column)
    got.validate(full=True)
    want = runtime.decode_column(column, kind, runtime.row_decoder(d, kind, dialect, lambda: True))
    same = lambda v: {k: sorted(x, key=repr) if k in ("counts", "parts") and x is not None else x for k, x in v.items()} if isinstance(v, dict) else v
    assert list(map(repr, map(same, got.to_pylist()))) == list(map(repr, map(same, want.to_pylist())))


def test_offsets_do_not_wrap():
    import numpy as np

    from wirefold.operators.wire import offsets_of

    assert offsets_of(np.array([1, 2], np.int32)).tolist() == [0, 1, 3]
    with pytest.raises(OverflowError, match="maxRecordsPerBatch"):
        offsets_of(np.array([2**30, 2**30], np.int32))
