"""Message types over the test tables, and the tables encoded as messages."""

from __future__ import annotations

import os
import tempfile

from google.protobuf import descriptor_pb2, duration_pb2, timestamp_pb2
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.functions import to_protobuf
from wirefold.sources.descriptors import define


def _file(module) -> descriptor_pb2.FileDescriptorProto:
    out = descriptor_pb2.FileDescriptorProto()
    module.DESCRIPTOR.CopyToProto(out)
    return out


STAMP, SPAN = ".google.protobuf.Timestamp", ".google.protobuf.Duration"

#: The line messages have presence, so that zeros stay; the plain ones leave zeros out.
SET = define(
    "shop",
    {
        "Line": [
            ("l_orderkey", 1, "optional int64"),
            ("l_partkey", 2, "optional int64"),
            ("l_suppkey", 3, "optional int64"),
            ("l_linenumber", 4, "optional int32"),
            ("l_quantity", 5, "optional double"),
            ("l_extendedprice", 6, "optional double"),
            ("l_discount", 7, "optional double"),
            ("l_tax", 8, "optional double"),
            ("l_returnflag", 9, "optional string"),
            ("l_linestatus", 10, "optional string"),
            ("l_shipdate", 11, STAMP),
        ],
        "PlainLine": [
            ("l_orderkey", 1, "int64"),
            ("l_linenumber", 2, "int32"),
            ("l_quantity", 3, "double"),
            ("l_discount", 4, "double"),
            ("l_tax", 5, "double"),
            ("tags", 6, "repeated int32"),
        ],
        "Nation": [("n_nationkey", 1, "int32"), ("n_name", 2, "string"), ("n_regionkey", 3, "int32")],
        "Customer": [("c_custkey", 1, "optional int64"), ("c_name", 2, "string"), ("c_nationkey", 3, "optional int32"), ("c_acctbal", 4, "optional double"), ("c_mktsegment", 5, "string")],
        "Order": [
            ("o_orderkey", 1, "optional int64"),
            ("o_orderstatus", 2, "Status"),
            ("o_totalprice", 3, "double"),
            ("o_orderdate", 4, STAMP),
            ("customer", 5, "Customer"),
            ("lines", 6, "repeated Line"),
            ("packed_parts", 7, "packed int64"),
            ("unpacked_parts", 8, "unpacked int64"),
            ("quantities", 9, "map int32 double"),
            ("waits", 10, "repeated " + SPAN),
            ("wait", 11, SPAN),
        ],
        "Zigzag": [("a", 1, "sint32"), ("b", 2, "sint64"), ("c", 3, "int64"), ("d", 4, "fixed32")],
        "Key": [("k", 1, "int64")],
        "Choice": [("id", 1, "int64"), ("name", 2, "string", "pick"), ("number", 3, "int32", "pick")],
        "ChoiceLoose": [("id", 1, "int64"), ("name", 2, "optional string"), ("number", 3, "optional int32")],
        "Vector": [("vec_id", 1, "int64"), ("embedding", 2, "repeated float"), ("label", 3, "optional int32")],
        "Document": [("doc_id", 1, "optional int64"), ("text", 2, "optional string"), ("raw", 3, "optional bytes"), ("quality", 4, "optional int32")],
        "Event": [("event_id", 1, "int64"), ("ts", 2, STAMP), ("user_id", 3, "optional int64"), ("event_type", 4, "string"), ("value", 5, "optional double")],
        "Parts": [("packed", 1, "packed int64")],
        "PartsLoose": [("packed", 1, "unpacked int64")],
    },
    {"Status": {"UNSET": 0, "F": 1, "O": 2, "P": 3}},
    needs=[_file(timestamp_pb2), _file(duration_pb2)],
)

#: The same line with one field of another type, and without others.
OLD = define(
    "shop.old",
    {"Line": [("l_orderkey", 1, "optional int64"), ("l_quantity", 5, "optional string"), ("l_returnflag", 9, "optional string"), ("fresh", 99, "optional int32")]},
)

PROTO2 = define(
    "shop.two",
    {
        "Item": [
            ("id", 1, "required int32"),
            ("size", 2, "optional int32", {"default": "7"}),
            ("name", 3, "optional string", {"default": "none"}),
            ("plain", 4, "optional int64"),
            ("marks", 5, "repeated int32"),
        ],
    },
    syntax="proto2",
)

TREE = define(
    "trees",
    {
        "Recursive": [("id", 1, "string"), ("depth", 2, "int32"), ("child", 3, "Recursive"), ("children", 4, "repeated Recursive")],
        "MutualA": [("name", 1, "string"), ("value_a", 2, "int32"), ("b_field", 3, "MutualB"), ("b_list", 4, "repeated MutualB")],
        "MutualB": [("label", 1, "string"), ("value_b", 2, "double"), ("a_field", 3, "MutualA"), ("a_list", 4, "repeated MutualA")],
    },
)


def descriptor_file(raw: bytes = SET) -> str:
    """A descriptor file; only the driver reads it."""
    place = tempfile.mkstemp(suffix=".desc")
    with os.fdopen(place[0], "wb") as f:
        f.write(raw)
    return place[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its timestamps as instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def encoded(df: DataFrame, message: str, columns: list[str] | None = None, raw: bytes = SET) -> DataFrame:
    """``df`` with a column ``data`` of messages of its columns."""
    return df.withColumn("data", to_protobuf(F.struct(*(columns or df.columns)), message, binaryDescriptorSet=raw))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "lineitem"), "Line").select("data")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer, lines, part lists, quantities and shipping waits in one message each."""
    line = table(spark, sf_dir, "lineitem")
    wait = (F.col("l_shipdate") - F.col("o_orderdate")).alias("wait")
    order = table(spark, sf_dir, "orders")
    dates = order.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    own = (
        line.join(dates, "l_orderkey")
        .withColumn("wait", wait)
        .groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.struct(*line.columns).alias("line"), "wait"))).alias("all"))
        .select(
            F.col("l_orderkey").alias("o_orderkey"),
            F.col("all.line").alias("lines"),
            F.col("all.wait").alias("waits"),
            F.transform("all", lambda x: x["line"]["l_partkey"]).alias("packed_parts"),
            F.transform("all", lambda x: x["line"]["l_partkey"]).alias("unpacked_parts"),
            F.map_from_entries(F.transform("all", lambda x, i: F.struct(i + 1, x["line"]["l_quantity"]))).alias("quantities"),
            F.element_at("all.wait", 1).alias("wait"),
        )
    )
    customer = table(spark, sf_dir, "customer")
    who = customer.select(F.col("c_custkey").alias("o_custkey"), F.struct(*customer.columns).alias("customer"))
    full = order.join(own, "o_orderkey", "left").join(who, "o_custkey", "left")
    names = "o_orderkey o_orderstatus o_totalprice o_orderdate customer lines packed_parts unpacked_parts quantities waits wait".split()
    return full.select(F.col("o_orderkey").alias("key"), to_protobuf(F.struct(*names), "Order", binaryDescriptorSet=SET).alias("data"))
