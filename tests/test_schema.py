"""Descriptors, schemas, pruning, options and encoder checks, without Spark jobs."""

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from wirefold import errors
from wirefold.operators.encode import Encoder
from wirefold.options import Options
from wirefold.plans.prune import prune_schema, required_paths
from wirefold.plans.schema import mocked_fields, typed_schema, wire_schema
from wirefold.queries.messages import PROTO2, SET, TREE
from wirefold.sources import descriptors as D


def test_lookup_by_short_and_full_name():
    assert D.from_bytes(SET, "Order").name == D.from_bytes(SET, "shop.Order").name == "shop.Order"
    with pytest.raises(errors.AnalysisError, match="Unable to locate Protobuf message 'Nobody' in descriptor file"):
        D.from_bytes(SET, "Nobody")


def test_sources(tmp_path):
    place = tmp_path / "x.desc"
    place.write_bytes(SET)
    assert D.resolve("Order", str(place)).kind == "file"
    assert D.resolve("Order", str(place), SET).kind == "binary"
    assert D.resolve("Order", SET).kind == "binary"
    assert D.resolve("google.protobuf.timestamp_pb2.Timestamp").name == "google.protobuf.Timestamp"
    for name in ("nothing.of.this", "Plain", "os.path"):
        with pytest.raises(errors.AnalysisError, match="Error loading Protobuf class"):
            D.resolve(name)
    with pytest.raises(errors.AnalysisError, match="Could not read Protobuf descriptor file"):
        D.from_file(str(tmp_path / "none"), "Order")
    place.write_bytes(b"\xff\xff\xff")
    with pytest.raises(errors.AnalysisError, match="Failed to parse Protobuf descriptor file"):
        D.from_file(str(place), "Order")


def test_missing_dependency():
    files = D.parse_set(SET)
    del files.file[0]
    with pytest.raises(errors.AnalysisError, match="Missing dependency 'google/protobuf/timestamp.proto'"):
        D.from_bytes(files.SerializeToString(), "Order")


@pytest.mark.parametrize("given", [{"recursive.fields.max.depth": "11"}, {"recursive.fields.max.depth": "-2"}, {"recursive.fields.max.depth": "x"}, {"recursive.fields.mode": "odd"}, {"recursive.fields.mode": "recursive", "recursive.fields.max.depth": "0"}])
def test_bad_options(given):
    with pytest.raises(errors.IllegalArgument):
        Options.of(given)


def test_options_ignore_case_and_mode_is_judged_late():
    assert Options.of({"RECURSIVE.Fields.Max.Depth": "3", "Mode": "permissive"}) == Options("PERMISSIVE", 3)
    with pytest.raises(errors.AnalysisError, match="Unsupported parse mode 'DROPMALFORMED'"):
        Options.of({"mode": "DROPMALFORMED"}).permissive()


def test_required_fields_are_not_nullable():
    assert not typed_schema(D.descriptor_of(PROTO2, "shop.two.Item"))["id"].nullable
    assert wire_schema(D.descriptor_of(PROTO2, "shop.two.Item"))["id"].nullable


def test_mocked_fields():
    assert mocked_fields(D.descriptor_of(TREE, "trees.MutualA")) == ["b_field.a_field", "b_field.a_list", "b_list.a_field", "b_list.a_list"]


def test_prune():
    full = wire_schema(D.descriptor_of(SET, "shop.Order"))
    some = prune_schema(full, ["lines.l_partkey", "customer"])
    assert required_paths(some)[:2] == ["customer", "customer.c_custkey"] and required_paths(some)[-2:] == ["lines", "lines.l_partkey"]
    assert prune_schema(full, []) == T.StructType([]) and prune_schema(full, [""]) == full
    typed = typed_schema(D.descriptor_of(SET, "shop.Order"))
    assert prune_schema(typed, ["quantities"]).names == ["quantities"]


def encode(struct, message="Customer", raw=SET, **how):
    column = pa.array([struct]) if not isinstance(struct, pa.Array) else struct
    d = D.descriptor_of(raw, D.from_bytes(raw, message).name)
    return Encoder(d, column.type, **how).column(column).to_pylist()


def test_encoder_checks():
    with pytest.raises(errors.AnalysisError, match="Cannot find Catalyst field"):
        encode({"nope": 1})
    with pytest.raises(errors.AnalysisError, match="Cannot find Protobuf field"):
        encode(pa.array([{"size": 1}], pa.struct([("size", pa.int32())])), "Item", PROTO2)
    with pytest.raises(errors.AnalysisError, match="Cannot convert Catalyst type"):
        encode(pa.array([{"c_name": 1}], pa.struct([("c_name", pa.int32())])))
    with pytest.raises(errors.AnalysisError, match="Cannot convert Catalyst type 'int'.*Status|Cannot convert Catalyst type"):
        encode(pa.array([{"o_orderstatus": 1}], pa.struct([("o_orderstatus", pa.int32())])), "Order", strict=True)
    with pytest.raises(errors.AnalysisError, match="Null element"):
        encode(pa.array([{"packed_parts": [1, None]}], pa.struct([("packed_parts", pa.list_(pa.int64()))])), "Order")
    with pytest.raises(errors.AnalysisError, match="Multiple matching fields"):
        encode(pa.StructArray.from_arrays([pa.array(["a"]), pa.array(["b"])], ["c_name", "C_NAME"]))
    with pytest.raises(errors.AnalysisError, match="Cannot find Catalyst field"):
        encode(pa.array([{"C_NAME": "x"}]), case_sensitive=True)


def test_encoded_bytes():
    assert encode({"C_NAME": "ab"}) == [b"\x12\x02ab"]
    assert encode(pa.array([{"c_name": None}, None], pa.struct([("c_name", pa.string())]))) == [b"", None]
    assert encode(pa.array([{"a": -1, "b": 1, "c": -1, "d": 1}], pa.struct([("a", pa.int32()), ("b", pa.int64()), ("c", pa.int64()), ("d", pa.int32())])), "Zigzag") == [b"\x08\x01\x10\x02\x18" + b"\xff" * 9 + b"\x01\x25\x01\x00\x00\x00"]
    # dates are days; a zero without presence is left out
    assert encode(pa.array([{"n_nationkey": 0, "n_regionkey": 300}], pa.struct([("n_nationkey", pa.int32()), ("n_regionkey", pa.int32())])), "Nation") == [b"\x18\xac\x02"]
