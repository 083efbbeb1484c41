"""Queries that return inferred schemas as rows (path, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wirefold import errors
from wirefold.functions import decoder
from wirefold.plans.prune import required_paths
from wirefold.plans.schema import RecursiveSchema, mocked_fields
from wirefold.queries.messages import SET, TREE, descriptor_file
from wirefold.queries.registry import query
from wirefold.sources.descriptors import descriptor_of


def _leaves(schema: T.StructType, at: str = "") -> list[tuple[str, str]]:
    """Paths of fields that are no structs, with their types; arrays and maps add no segment."""
    out = []
    for f in schema.fields:
        here = f"{at}.{f.name}" if at else f.name
        kind = f.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            out += _leaves(kind, here) or [(here, "empty")]
        else:
            out.append((here, f.dataType.simpleString()))
    return out


def _rows(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, "path string, type string")


def _values(*rows: tuple[str, str]) -> str:
    quoted = ", ".join("('{}', '{}')".format(*(c.replace("'", "''") for c in r)) for r in rows)
    return f"SELECT * FROM (VALUES {quoted}) AS t(path, type)"


def _tree(message: str, **options):
    given = {k.replace("_", "."): str(v) for k, v in options.items()}
    return _leaves(decoder(message, None, given, TREE).schema)


_ID = (("id", "string"), ("depth", "int"))


def _nested(*levels: str) -> tuple[tuple[str, str], ...]:
    return tuple((f"{at}{n}", t) for at in levels for n, t in _ID)


# At depth N of one recursive type with two ways to go on, both ways are followed.
def _both(n: int) -> list[str]:
    out, last = [""], [""]
    for _ in range(n):
        last = [f"{at}{way}." for at in last for way in ("child", "children")]
        out += last
    return out


@query(_values(*_nested(*_both(0))))
def recursive_depth_0(spark, d):
    return _rows(spark, _tree("Recursive", recursive_fields_max_depth=0))


@query(_values(*_nested(*_both(1))))
def recursive_depth_1(spark, d):
    return _rows(spark, _tree("Recursive", recursive_fields_max_depth=1))


@query(_values(*_nested(*_both(2))))
def recursive_depth_2(spark, d):
    return _rows(spark, _tree("Recursive", recursive_fields_max_depth=2, recursive_fields_mode="drop"))


@query(_values(*_nested(*_both(3))))
def recursive_depth_3(spark, d):
    return _rows(spark, _tree("Recursive", recursive_fields_max_depth=3))


@query(_values(*_nested("")))
def recursive_drop(spark, d):
    return _rows(spark, _tree("Recursive", recursive_fields_mode="drop"))


@query(_values(*_nested(""), ("child", "binary"), ("children", "array<binary>")))
def recursive_binary(spark, d):
    return _rows(spark, _tree("Recursive", recursive_fields_mode="binary"))


@query(_values(*_nested(*_both(1)), *((f"{at}{way}", kind) for at in ("child.", "children.") for way, kind in (("child", "binary"), ("children", "array<binary>")))))
def recursive_binary_depth_1(spark, d):
    return _rows(spark, _tree("Recursive", recursive_fields_mode="binary", recursive_fields_max_depth=1))


@query(_values(("fail", "Recursive field detected: child of type trees.Recursive. Recursive schemas are not supported in fail mode."), ("typed", "Found recursion in Protobuf schema while processing trees.Recursive.child"), ("mode", "Invalid value for 'recursive.fields.mode': 'twice'. Supported values are: '' (empty), 'drop', 'binary', 'fail', 'recursive'"), ("both", "Invalid configuration: 'recursive.fields.mode=recursive' cannot be used with 'recursive.fields.max.depth=2'. RecursiveStructType requires depth=-1 (default) with explicit mode=recursive.")))
def recursive_errors(spark, d):
    path = descriptor_file(TREE)

    def text(*args, **kw):
        try:
            decoder(*args, **kw)
        except errors.ProtobufError as e:
            return str(e)
        return "no error"

    return _rows(
        spark,
        [
            ("fail", text("Recursive", None, {"recursive.fields.mode": "fail"}, TREE)),
            ("typed", text("Recursive", path)),
            ("mode", text("Recursive", None, {"recursive.fields.mode": "twice"}, TREE)),
            ("both", text("Recursive", None, {"recursive.fields.mode": "recursive", "recursive.fields.max.depth": "2"}, TREE)),
        ],
    )


# A -> B -> A -> B -> A: below the root's b fields, depth 1 to 3.
def _mutual() -> list[tuple[str, str]]:
    a, b = (("name", "string"), ("value_a", "int")), (("label", "string"), ("value_b", "double"))
    out, last = [(n, t) for n, t in a], [""]
    for k in range(4):
        ways = ("b_field", "b_list") if k % 2 == 0 else ("a_field", "a_list")
        last = [f"{at}{way}." for at in last for way in ways]
        out += [(at + n, t) for at in last for n, t in (b if k % 2 == 0 else a)]
    return out


@query(_values(*_mutual()))
def mutual_depth_3(spark, d):
    return _rows(spark, _tree("MutualA", recursive_fields_max_depth=3))


@query(_values(*_nested(""), *_nested("child.", "children.")))
def recursive_typed_depth_2(spark, d):
    return _rows(spark, _leaves(decoder("Recursive", descriptor_file(TREE), {"recursive.fields.max.depth": "2"}).schema))


@query(_values(("child", "recursive"), ("children", "recursive"), ("text", "struct<id:string,depth:int,child:recursive:Recursive,children:array<recursive:Recursive>>")))
def recursive_mocked_fields(spark, d):
    descriptor = descriptor_of(TREE, "trees.Recursive")
    return _rows(spark, [*((p, "recursive") for p in mocked_fields(descriptor)), ("text", RecursiveSchema(descriptor).text())])


_CUSTOMER = [("customer.c_custkey", "bigint"), ("customer.c_name", "string"), ("customer.c_nationkey", "int"), ("customer.c_acctbal", "double"), ("customer.c_mktsegment", "string")]
_LINE = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string")]
_LISTS = [("packed_parts", "array<bigint>"), ("unpacked_parts", "array<bigint>")]


@query(
    _values(
        ("o_orderkey", "bigint"), ("o_orderstatus", "int"), ("o_totalprice", "double"), ("o_orderdate.seconds", "bigint"), ("o_orderdate.nanos", "int"), *_CUSTOMER,
        *((f"lines.{n}", t) for n, t in _LINE), ("lines.l_shipdate.seconds", "bigint"), ("lines.l_shipdate.nanos", "int"), *_LISTS,
        ("quantities.key", "int"), ("quantities.value", "double"), ("waits.seconds", "bigint"), ("waits.nanos", "int"), ("wait.seconds", "bigint"), ("wait.nanos", "int"),
    )
)
def schema_inference_wire(spark, d):
    return _rows(spark, _leaves(decoder("Order", SET).schema))


@query(
    _values(
        ("o_orderkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp"), *_CUSTOMER,
        *((f"lines.{n}", t) for n, t in _LINE), ("lines.l_shipdate", "timestamp"), *_LISTS,
        ("quantities", "map<int,double>"), ("waits", "array<interval day to second>"), ("wait", "interval day to second"),
    )
)
def schema_inference_typed(spark, d):
    return _rows(spark, _leaves(decoder("shop.Order", descriptor_file()).schema))


@query(_values(("customer", "path"), ("customer.c_name", "path"), ("lines", "path"), ("lines.l_partkey", "path")))
def pruned_paths(spark, d):
    return _rows(spark, [(p, "path") for p in required_paths(decoder("Order", SET, fields=["customer.c_name", "lines.l_partkey"]).pruned_schema)])
