"""Queries that exercise encoding and decoding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wirefold import errors
from wirefold.functions import decode, decoder, from_protobuf, to_protobuf
from wirefold.functions.sql import protobuf_sql, register_encoder, register_functions, register_message
from wirefold.plans.frame import ProtoFrame, staged_decode
from wirefold.queries.messages import OLD, PROTO2, SET, TREE, descriptor_file, encoded, lines, orders, table
from wirefold.queries.registry import query
from wirefold.sources.descriptors import define, message_class
from wirefold.sources.messages import messages_to_df, slice_bytes

LINE = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split()
ALL_LINES = f"SELECT {', '.join(LINE)}, epoch_us(l_shipdate)::BIGINT AS l_shipdate FROM lineitem"


def wire(df, message, data="data", name="m", **how):
    return decode(df, data, message, binaryDescriptorSet=SET, name=name, **how)


@query(ALL_LINES)
def roundtrip_scalars(spark, d):
    m = wire(lines(spark, d), "Line")
    return m.select(*[f"m.{c}" for c in LINE], F.expr("m.l_shipdate.seconds * 1000000 + coalesce(m.l_shipdate.nanos, 0) div 1000").alias("l_shipdate"))


@query(ALL_LINES)
def roundtrip_file(spark, d):
    path = descriptor_file()
    df = table(spark, d, "lineitem").select(to_protobuf(F.struct(*LINE, "l_shipdate"), "Line", path).alias("data"))
    m = df.select(from_protobuf("data", "Line", path, {"mode": "FAILFAST"}).alias("m"))
    return m.select(*[f"m.{c}" for c in LINE], F.unix_micros("m.l_shipdate").alias("l_shipdate"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def roundtrip_class(spark, d):
    cls = message_class(SET, "shop.Customer")
    c = table(spark, d, "customer")
    m = c.select(to_protobuf(F.struct(*c.columns), cls).alias("data")).select(from_protobuf("data", cls, options={"MODE": "failfast"}).alias("m"))
    return m.select("m.*")


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds FROM orders")
def class_by_path(spark, d):
    name = "google.protobuf.timestamp_pb2.Timestamp"
    o = table(spark, d, "orders").select("o_orderkey", F.struct(F.unix_seconds("o_orderdate").alias("seconds")).alias("s"))
    return o.select("o_orderkey", from_protobuf(to_protobuf("s", name), name).getField("seconds").alias("seconds"))


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""
)
def decode_agg_q1(spark, d):
    m = ProtoFrame(lines(spark, d), "data", "Line", binaryDescriptorSet=SET).filter("proto.l_shipdate.seconds * 1000000 + coalesce(proto.l_shipdate.nanos, 0) div 1000 <= unix_micros(timestamp '1998-09-02')")
    m = m.select("proto.l_returnflag", "proto.l_linestatus", "proto.l_quantity", "proto.l_extendedprice", "proto.l_discount")
    return m.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
        F.count(F.lit(1)).alias("count_order"),
    )


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'")
def decode_filter_project(spark, d):
    f = ProtoFrame(lines(spark, d), "data", "Line", binaryDescriptorSet=SET)
    return f.filter("proto.l_quantity > 30").filter("proto.l_returnflag = 'R'").select("proto.l_orderkey", "proto.l_linenumber")


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_discount >= 0.05")
def staged_decoding(spark, d):
    m = staged_decode(lines(spark, d), "data", "proto.l_discount >= 0.05", ["l_orderkey", "l_extendedprice"], messageType="Line", binaryDescriptorSet=SET)
    return m.select("proto.l_orderkey", "proto.l_extendedprice")


PRUNED = "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey"


@query("SELECT l_partkey FROM lineitem")
def prune_single(spark, d):
    return wire(lines(spark, d), "Line", fields=["l_partkey"]).select("m.l_partkey")


@query(PRUNED)
def prune_nested(spark, d):
    return wire(orders(spark, d), "Order", fields=["o_orderkey", "customer.c_name", "customer.c_mktsegment"]).select("m.o_orderkey", "m.customer.c_name", "m.customer.c_mktsegment")


@query(PRUNED)
def prune_disabled(spark, d):
    key = "spark.sql.protobuf.nestedSchemaPruning.enabled"
    spark.conf.set(key, "false")
    try:
        return wire(orders(spark, d), "Order", fields=["o_orderkey", "customer.c_name", "customer.c_mktsegment"]).select("m.o_orderkey", "m.customer.c_name", "m.customer.c_mktsegment")
    finally:
        spark.conf.unset(key)


@query(
    """SELECT n_nationkey, lower((CASE WHEN n_nationkey = 0 THEN '' ELSE '08' || printf('%02x', n_nationkey) END) || '12' || printf('%02x', length(n_name))
    || hex(encode(n_name)) || (CASE WHEN n_regionkey = 0 THEN '' ELSE '18' || printf('%02x', n_regionkey) END)) AS bytes FROM nation"""
)
def encode_bytes_nation(spark, d):
    n = encoded(table(spark, d, "nation"), "Nation")
    return n.select("n_nationkey", F.lower(F.hex("data")).alias("bytes"))


@query("SELECT l_orderkey, CASE WHEN l_orderkey = 0 THEN 0 WHEN l_orderkey < 128 THEN 2 WHEN l_orderkey < 16384 THEN 3 WHEN l_orderkey < 2097152 THEN 4 ELSE 5 END AS size FROM lineitem")
def varint_size(spark, d):
    k = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    return encoded(k, "Key").select(F.col("k").alias("l_orderkey"), F.octet_length("data").alias("size"))


@query("SELECT c_custkey, (-c_nationkey)::INTEGER AS a, -c_custkey AS b, -c_custkey AS c, c_nationkey AS d, CASE WHEN c_custkey = 0 THEN 0 ELSE 11 END AS c_bytes FROM customer")
def zigzag_bytes(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (-F.col("c_nationkey")).alias("a"), (-F.col("c_custkey")).alias("b"), (-F.col("c_custkey")).alias("c"), F.col("c_nationkey").alias("d"))
    m = wire(encoded(c, "Zigzag", ["a", "b", "c", "d"]).withColumn("n", F.octet_length(to_protobuf(F.struct("c"), "Zigzag", binaryDescriptorSet=SET))), "Zigzag")
    zero = lambda x: F.coalesce(F.col(f"m.{x}"), F.lit(0))
    return m.select("c_custkey", zero("a").alias("a"), zero("b").cast("long").alias("b"), zero("c").cast("long").alias("c"), zero("d").alias("d"), F.col("n").alias("c_bytes"))


LISTS = """SELECT o_orderkey, count(l_partkey) AS n, coalesce(sum(l_partkey), 0)::BIGINT AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""


def _size(c):
    return F.when(F.col(c).isNull(), 0).otherwise(F.size(c))


@query(LISTS)
def repeated_packed(spark, d):
    m = wire(orders(spark, d), "Order", fields=["o_orderkey", "packed_parts"]).select("m.o_orderkey", "m.packed_parts")
    return m.select("o_orderkey", _size("packed_parts").cast("long").alias("n"), F.coalesce(F.aggregate("packed_parts", F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).alias("total"))


@query(LISTS)
def repeated_unpacked(spark, d):
    m = wire(orders(spark, d), "Order", fields=["o_orderkey", "unpacked_parts"]).select("m.o_orderkey", F.explode_outer("m.unpacked_parts").alias("p"))
    return m.groupBy("o_orderkey").agg(F.count("p").alias("n"), F.coalesce(F.sum("p"), F.lit(0)).alias("total"))


@query("SELECT p_partkey, 4 AS n, 2 * p_partkey + p_size + 1 AS total, CASE WHEN p_partkey = p_partkey THEN p_size END AS third FROM part")
def repeated_mixed(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    size = F.col("p_size").cast("long")
    one = to_protobuf(F.struct(F.array("p_partkey", "p_partkey").alias("packed")), "Parts", binaryDescriptorSet=SET)
    two = to_protobuf(F.struct(F.array(size, F.lit(1).cast("long")).alias("packed")), "PartsLoose", binaryDescriptorSet=SET)
    m = wire(p.withColumn("data", F.concat(one, two)), "Parts")
    return m.select("p_partkey", F.size("m.packed").alias("n"), F.aggregate("m.packed", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.get("m.packed", F.lit(2)).cast("int").alias("third"))


@query("SELECT o_orderkey, c_custkey, c_name, c_nationkey, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def nested_order_customer(spark, d):
    return wire(orders(spark, d), "Order").select("m.o_orderkey", "m.customer.c_custkey", "m.customer.c_name", "m.customer.c_nationkey", "m.o_totalprice")


@query(ALL_LINES)
def repeated_message_lines(spark, d):
    m = wire(orders(spark, d), "Order", fields=["lines"]).select(F.explode("m.lines").alias("x"))
    return m.select(*[f"x.{c}" for c in LINE], F.expr("x.l_shipdate.seconds * 1000000 + coalesce(x.l_shipdate.nanos, 0) div 1000").alias("l_shipdate"))


MAPS = "SELECT l_orderkey, count(*) AS n, count(*) AS last, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_orderkey"


def _summed(df):
    rows = df.select(F.col("o_orderkey").alias("l_orderkey"), F.explode("q").alias("k", "v"))
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("k").cast("long").alias("last"), F.round(F.sum("v"), 2).alias("qty"))


@query(MAPS)
def map_typed(spark, d):
    m = decode(orders(spark, d), "data", "Order", descriptor_file(), name="m")
    return _summed(m.select("m.o_orderkey", F.col("m.quantities").alias("q")))


@query(MAPS)
def map_wire(spark, d):
    m = wire(orders(spark, d), "Order", fields=["o_orderkey", "quantities"]).where("m.quantities is not null").select("m.o_orderkey", F.map_from_entries("m.quantities").alias("q"))
    return _summed(m)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END::INTEGER AS status FROM orders")
def enum_int(spark, d):
    return wire(orders(spark, d), "Order").select("m.o_orderkey", F.col("m.o_orderstatus").alias("status"))


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders")
def enum_name(spark, d):
    m = orders(spark, d).select(from_protobuf("data", "Order", descriptor_file()).alias("m"))
    return m.select("m.o_orderkey", F.col("m.o_orderstatus").alias("status"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'F' WHEN 2 THEN 'O' WHEN 3 THEN 'P' WHEN 4 THEN 'UNKNOWN_ENUM_VALUE_4' END AS status FROM orders")
def enum_number_encode(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("cast(o_orderkey % 5 as int)").alias("o_orderstatus"))
    m = encoded(o, "Order").select(from_protobuf("data", "Order", descriptor_file()).alias("m"))
    return m.select("m.o_orderkey", F.col("m.o_orderstatus").alias("status"))


STAMPS = "SELECT event_id, (epoch_us(ts) // 1000)::BIGINT * 1000 AS us FROM events"


@query(STAMPS)
def timestamp_typed(spark, d):
    e = encoded(table(spark, d, "events").select("event_id", "ts"), "Event").select(from_protobuf("data", "Event", descriptor_file()).alias("m"))
    return e.select(F.coalesce("m.event_id", F.lit(0).cast("long")).alias("event_id"), F.unix_micros("m.ts").alias("us"))


@query(STAMPS)
def timestamp_wire(spark, d):
    e = wire(encoded(table(spark, d, "events").select("event_id", "ts"), "Event"), "Event")
    return e.select("event_id", F.expr("m.ts.seconds * 1000000 + coalesce(m.ts.nanos, 0) div 1000").alias("us"))


@query("SELECT event_id, epoch_us(date_trunc('milliseconds', ts + to_microseconds(event_id % 1000)))::BIGINT AS us FROM events")
def timestamp_ms_trunc(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr("timestamp_micros(unix_micros(ts) + event_id % 1000)").alias("ts"))
    m = wire(encoded(e, "Event"), "Event")
    return m.select("event_id", F.expr("m.ts.seconds * 1000000 + coalesce(m.ts.nanos, 0) div 1000").alias("us"))


@query("SELECT c_custkey, -c_custkey * 1500 AS us FROM customer")
def timestamp_before_epoch(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.expr("timestamp_micros(-c_custkey * 1500000)").alias("ts"))
    m = encoded(c, "Event", ["ts"]).select("c_custkey", from_protobuf("data", "Event", descriptor_file()).getField("ts").alias("t"))
    return m.select("c_custkey", (F.unix_micros("t") / 1000).cast("long").alias("us"))


WAITS = "SELECT l_orderkey, l_linenumber, ((epoch_us(l_shipdate) // 1000) - (epoch_us(o_orderdate) // 1000))::BIGINT AS ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(WAITS)
def duration_interval(spark, d):
    m = decode(orders(spark, d), "data", "Order", descriptor_file(), name="m")
    x = m.select(F.col("m.o_orderkey").alias("l_orderkey"), F.posexplode(F.arrays_zip(F.col("m.waits").alias("w"), F.col("m.lines.l_linenumber").alias("l"))).alias("i", "x"))
    return x.select("l_orderkey", F.col("x.l").alias("l_linenumber"), F.expr("cast(extract(day from x.w) as bigint) * 86400000 + extract(hour from x.w) * 3600000 + extract(minute from x.w) * 60000 + cast(extract(second from x.w) * 1000 as bigint)").alias("ms"))


@query(WAITS)
def duration_wire(spark, d):
    m = wire(orders(spark, d), "Order", fields=["o_orderkey", "waits", "lines.l_linenumber"])
    x = m.select(F.col("m.o_orderkey").alias("l_orderkey"), F.explode(F.arrays_zip(F.col("m.waits").alias("w"), F.col("m.lines.l_linenumber").alias("l"))).alias("x"))
    return x.select("l_orderkey", F.col("x.l").alias("l_linenumber"), F.expr("coalesce(x.w.seconds, 0) * 1000 + coalesce(x.w.nanos, 0) div 1000000").alias("ms"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE l_discount <> 0) AS discounts, count(*) FILTER (WHERE l_tax <> 0) AS taxes, 0::BIGINT AS tags FROM lineitem")
def null_absent_wire(spark, d):
    p = table(spark, d, "lineitem").select("l_orderkey", "l_discount", "l_tax")
    m = wire(encoded(p, "PlainLine"), "PlainLine")
    return m.agg(F.count(F.lit(1)).alias("n"), F.count("m.l_discount").alias("discounts"), F.count("m.l_tax").alias("taxes"), F.count("m.tags").alias("tags"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE l_discount <> 0) AS discounts, count(*) AS empty_tags FROM lineitem")
def typed_defaults(spark, d):
    p = table(spark, d, "lineitem").select("l_orderkey", "l_discount", "l_tax")
    m = encoded(p, "PlainLine").select(from_protobuf("data", "PlainLine", descriptor_file()).alias("m"))
    return m.agg(F.count(F.lit(1)).alias("n"), F.count("m.l_discount").alias("discounts"), F.count_if(F.size("m.tags") == 0).alias("empty_tags"))


@query("SELECT l_orderkey, l_linenumber, l_discount, l_tax, 0::DOUBLE AS l_quantity FROM lineitem")
def generated_defaults(spark, d):
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    m = encoded(p, "PlainLine").select(from_protobuf("data", message_class(SET, "shop.PlainLine")).alias("m"))
    return m.select("m.l_orderkey", "m.l_linenumber", "m.l_discount", "m.l_tax", "m.l_quantity")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 7 END AS size, 'none' AS name, NULL::BIGINT AS plain, 0 AS marks FROM part")
def proto2_defaults(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("int").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("size"))
    m = encoded(p, "Item", ["id", "size"], PROTO2).select("p_partkey", from_protobuf("data", "Item", descriptor_file(PROTO2)).alias("m"))
    return m.select("p_partkey", "m.size", "m.name", "m.plain", F.size("m.marks").alias("marks"))


@query("SELECT p_partkey, 0 AS id FROM part")
def required_null_is_default(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lit(None).cast("int").alias("id"))
    m = encoded(p, "Item", ["id"], PROTO2).select("p_partkey", from_protobuf("data", "Item", binaryDescriptorSet=PROTO2).alias("m"))
    return m.select("p_partkey", "m.id")


def _damaged(spark, d):
    return table(spark, d, "customer").withColumn("data", to_protobuf(F.struct("c_custkey", "c_name"), "Customer", binaryDescriptorSet=SET)).withColumn("data", F.when(F.col("c_custkey") % 7 == 0, F.unhex(F.lit("FFFFFF"))).otherwise(F.col("data")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS name, c_custkey % 7 = 0 AS lost FROM customer")
def permissive_malformed(spark, d):
    m = _damaged(spark, d).withColumn("m", from_protobuf("data", "Customer", binaryDescriptorSet=SET, options={"mode": "PERMISSIVE"}))
    return m.select("c_custkey", F.col("m.c_name").alias("name"), F.col("m").isNull().alias("lost"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS name FROM customer")
def permissive_typed(spark, d):
    m = _damaged(spark, d).withColumn("m", from_protobuf("data", "Customer", descriptor_file(), {"Mode": "permissive"}))
    return m.select("c_custkey", F.col("m.c_name").alias("name"))


def _message_of(run) -> str:
    """The package's own text in an error that came through Spark."""
    try:
        run()
    except Exception as e:
        for line in str(e).split("\n"):
            for kind in ("MalformedMessage: ", "AnalysisError: ", "IllegalArgument: "):
                if kind in line:
                    return line.split(kind, 1)[1].strip()
        return str(e).split("\n")[0]
    return "no error"


@query("SELECT 'Malformed Protobuf message detected during parsing' AS text, 'wire' AS dialect UNION ALL SELECT 'Malformed Protobuf message detected during parsing', 'typed'")
def malformed_failfast(spark, d):
    bad = spark.range(1).select(F.unhex(F.lit("FFFFFF")).alias("data"))
    one = _message_of(lambda: bad.select(from_protobuf("data", "Customer", binaryDescriptorSet=SET)).collect())
    two = _message_of(lambda: bad.select(from_protobuf("data", "Customer", descriptor_file())).collect())
    return spark.createDataFrame([(one, "wire"), (two, "typed")], "text string, dialect string")


@query(
    """SELECT * FROM (VALUES ('extra field', 'Cannot find Catalyst field field ''nope'' in Protobuf schema'), ('missing required', 'Cannot find Protobuf field field ''id'' in Catalyst schema'),
    ('enum symbol', 'Value ''X'' at field ''o_orderstatus'' is not one of the allowed enum symbols UNSET, F, O, P for field shop.Order.o_orderstatus'),
    ('bad depth', 'Invalid value for ''recursive.fields.max.depth'': 11. Supported values are -1 (default), 0 (no recursions), or 1-10 (specific depth limit). Values > 10 can cause stack overflows.'),
    ('no message', 'Unable to locate Protobuf message ''Nobody'' in descriptor file'), ('bad mode', 'Unsupported parse mode ''DROPMALFORMED'' for function from_protobuf')) AS t(what, text)"""
)
def encode_validation_errors(spark, d):
    one = spark.range(1)
    case = lambda s, m, raw=SET: lambda: one.select(to_protobuf(s, m, binaryDescriptorSet=raw)).collect()
    rows = [
        ("extra field", _message_of(case(F.struct(F.lit(1).alias("nope")), "Customer"))),
        ("missing required", _message_of(case(F.struct(F.lit(1).alias("size")), "Item", PROTO2))),
        ("enum symbol", _message_of(case(F.struct(F.lit("X").alias("o_orderstatus")), "Order"))),
        ("bad depth", _error(lambda: from_protobuf("id", "Customer", binaryDescriptorSet=SET, options={"recursive.fields.max.depth": "11"}))),
        ("no message", _error(lambda: from_protobuf("id", "Nobody", binaryDescriptorSet=SET))),
        ("bad mode", _message_of(lambda: one.select(from_protobuf(F.unhex(F.lit("FFFFFF")), "Customer", binaryDescriptorSet=SET, options={"mode": "DROPMALFORMED"})).collect())),
    ]
    return spark.createDataFrame(rows, "what string, text string")


def _error(run) -> str:
    try:
        run()
    except errors.ProtobufError as e:
        return str(e)
    return "no error"


@query("SELECT l_orderkey, NULL::VARCHAR AS l_quantity, l_returnflag, NULL::INTEGER AS fresh FROM lineitem")
def wire_mismatch_skip(spark, d):
    return lines(spark, d).select(from_protobuf("data", "Line", binaryDescriptorSet=OLD).alias("m")).select("m.*")


@query("SELECT l_orderkey, l_returnflag FROM lineitem")
def unknown_field_skip(spark, d):
    return lines(spark, d).select(from_protobuf("data", "Line", binaryDescriptorSet=OLD, fields=["l_orderkey", "l_returnflag"]).alias("m")).select("m.*")


@query("SELECT 'Malformed Protobuf message detected during parsing' AS text")
def typed_mismatch_fails(spark, d):
    path = descriptor_file(OLD)
    text = _message_of(lambda: lines(spark, d).select(from_protobuf("data", "Line", path).getField("l_orderkey")).write.format("noop").mode("overwrite").save())
    return spark.createDataFrame([(text,)], "text string")


ONEOF = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, CASE WHEN c_custkey % 2 = 1 THEN c_nationkey END AS number FROM customer"


@query(ONEOF)
def oneof_members(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.expr("if(c_custkey % 2 = 0, c_name, null)").alias("name"), F.expr("if(c_custkey % 2 = 1, c_nationkey, null)").alias("number"))
    m = c.withColumn("data", to_protobuf(F.struct(F.col("c_custkey").alias("id"), "name", "number"), "Choice", binaryDescriptorSet=SET))
    return wire(m, "Choice").select("c_custkey", "m.name", "m.number")


@query("SELECT c_custkey, c_name AS wire_name, c_nationkey AS wire_number, NULL::VARCHAR AS typed_name, c_nationkey AS typed_number FROM customer")
def oneof_both_on_the_wire(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("number"))
    c = c.withColumn("data", to_protobuf(F.struct(F.col("c_custkey").alias("id"), "name", "number"), "ChoiceLoose", binaryDescriptorSet=SET))
    m = wire(c, "Choice").withColumn("t", from_protobuf("data", "Choice", descriptor_file()))
    return m.select("c_custkey", F.col("m.name").alias("wire_name"), F.col("m.number").alias("wire_number"), F.col("t.name").alias("typed_name"), F.col("t.number").alias("typed_number"))


@query("SELECT c_custkey, c_name AS name, NULL::DOUBLE AS wire_balance, c_acctbal AS typed_balance FROM customer")
def duplicate_message_last_wins(spark, d):
    c = table(spark, d, "customer")
    first = to_protobuf(F.struct(F.struct("c_acctbal").alias("customer")), "Order", binaryDescriptorSet=SET)
    last = to_protobuf(F.struct(F.struct("c_name").alias("customer")), "Order", binaryDescriptorSet=SET)
    m = wire(c.withColumn("data", F.concat(first, last)), "Order").withColumn("t", from_protobuf("data", "Order", descriptor_file()))
    return m.select("c_custkey", F.col("m.customer.c_name").alias("name"), F.col("m.customer.c_acctbal").alias("wire_balance"), F.col("t.customer.c_acctbal").alias("typed_balance"))


@query("SELECT n_nationkey, n_name AS a, 'x' || n_name AS b, 'y' || n_name AS c, 'z' || n_name AS d, true AS more FROM nation")
def recursive_unrolled(spark, d):
    """Four levels are structs, the fifth is kept as bytes and can be decoded again."""
    n = table(spark, d, "nation")
    node = None
    for k, mark in reversed(list(enumerate(["", "x", "y", "z", "w"]))):
        own = [F.concat(F.lit(mark), "n_name").alias("id"), F.lit(k).alias("depth")]
        node = F.struct(*own, *([node.alias("child")] if node is not None else []))
    m = n.select("n_nationkey", "n_name", to_protobuf(node, "Recursive", binaryDescriptorSet=TREE).alias("data")).withColumn("m", from_protobuf("data", "Recursive", binaryDescriptorSet=TREE))
    rest = from_protobuf("m.child.child.child.child", "Recursive", binaryDescriptorSet=TREE)
    m = m.withColumn("rest", rest)
    return m.select(
        "n_nationkey", F.col("m.id").alias("a"), F.col("m.child.id").alias("b"), F.col("m.child.child.id").alias("c"), F.col("m.child.child.child.id").alias("d"), (F.col("rest.id") == F.concat(F.lit("w"), "n_name")).alias("more")
    )


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45")
def sql_udf(spark, d):
    register_message(spark, "decode_line", "Line", binaryDescriptorSet=SET, fields=["l_orderkey", "l_linenumber", "l_quantity"])
    lines(spark, d).createOrReplaceTempView("line_messages")
    return spark.sql("SELECT m.l_orderkey, m.l_linenumber FROM (SELECT decode_line(data) AS m FROM line_messages) WHERE m.l_quantity > 45")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sql_udf_encode(spark, d):
    register_encoder(spark, "encode_nation", "Nation", descriptor_file())
    register_message(spark, "decode_nation", "Nation", descriptor_file(), options={"mode": "FAILFAST"})
    table(spark, d, "nation").createOrReplaceTempView("nations")
    m = spark.sql("SELECT decode_nation(encode_nation(struct(n_nationkey, n_name, n_regionkey))) AS m FROM nations")
    return m.select(F.coalesce("m.n_nationkey", F.lit(0)).alias("n_nationkey"), "m.n_name", F.coalesce("m.n_regionkey", F.lit(0)).alias("n_regionkey"))


@query("SELECT c_custkey AS k, c_name, c_mktsegment FROM customer")
def sql_udtf(spark, d):
    register_functions(spark)
    encoded(table(spark, d, "customer").withColumn("k", F.col("c_custkey")), "Customer", ["c_name", "c_mktsegment"]).select("k", "data").createOrReplaceTempView("customer_messages")
    return spark.sql(f"SELECT k, c_name, c_mktsegment FROM decode_protobuf(TABLE(SELECT * FROM customer_messages), 'data', 'Customer', '{descriptor_file()}')")


@query("SELECT o_orderkey, o_orderpriority, c_name, 'from_protobuf(x)' AS note FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def sql_on_demand(spark, d):
    """Two message types, encoded and decoded by one query's text.

    Spark takes what is read of a wide struct for a small share of its rows'
    bytes, so it would broadcast all orders; the hint keeps the join to sorts.
    """
    path = descriptor_file().replace("'", "''")
    table(spark, d, "customer").createOrReplaceTempView("sql_customers")
    table(spark, d, "orders").hint("merge").createOrReplaceTempView("sql_orders")
    return protobuf_sql(
        spark,
        f"""SELECT o.o_orderkey, p AS o_orderpriority, m.c_name, 'from_protobuf(x)' AS note -- from_protobuf(
        FROM (SELECT o_custkey, o_orderpriority AS p, From_Protobuf(to_protobuf(struct(o_orderkey, o_totalprice), 'Order', '{path}'), 'Order', '{path}') AS o FROM sql_orders) AS t
        JOIN (SELECT c_custkey AS k, from_protobuf(to_protobuf(struct(c_name), 'Customer', '{path}'), 'Customer', '{path}') AS m FROM sql_customers) ON k = o_custkey WHERE o.o_totalprice > 100000""",
    )


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def typed_messages(spark, d):
    cls = message_class(SET, "shop.Nation")
    rows = table(spark, d, "nation").collect()
    return messages_to_df(spark, [cls(n_nationkey=r[0], n_name=r[1], n_regionkey=r[2]) for r in rows])


@query("SELECT c_custkey, c_name FROM customer")
def slice_decode(spark, d):
    c = encoded(table(spark, d, "customer"), "Customer", ["c_name"]).withColumn("n", F.octet_length("data"))
    c = c.withColumn("frame", F.concat(F.unhex(F.lit("DEADBEEF")), "data", F.unhex(F.lit("00FF"))))
    return c.select("c_custkey", from_protobuf(slice_bytes("frame", 4, F.col("n")), "Customer", binaryDescriptorSet=SET).getField("c_name").alias("c_name"))


@query("SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, label FROM embeddings")
def packed_floats(spark, d):
    m = wire(encoded(table(spark, d, "embeddings"), "Vector").select(F.col("vec_id").alias("id"), "data"), "Vector")
    return m.select(F.col("id").alias("vec_id"), F.size("m.embedding").cast("long").alias("dims"), F.round(F.aggregate("m.embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"), "m.label")


@query("SELECT d.doc_id, length(text)::INTEGER AS chars, md5(text) AS digest, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def long_strings(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    docs = docs.select("doc_id", "text", F.col("text").cast("binary").alias("raw"), "quality")
    m = wire(encoded(docs, "Document").select("data"), "Document")
    return m.select("m.doc_id", F.length("m.text").alias("chars"), F.md5("m.raw").alias("digest"), "m.quality")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 3 = 0) AS nulls FROM customer")
def null_input(spark, d):
    c = encoded(table(spark, d, "customer"), "Customer").withColumn("data", F.expr("if(c_custkey % 3 = 0, null, data)"))
    return wire(c, "Customer").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m").isNull()).alias("nulls"))


@query("SELECT c_custkey, 0 AS size FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 2 = 1")
def encode_null_struct(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.struct(F.lit(None).cast("string").alias("c_name"))).alias("s"))
    return c.select("c_custkey", F.octet_length(to_protobuf("s", "Customer", binaryDescriptorSet=SET)).alias("size"))



_WIDE = [(f"double_{i:03d}", i + 1, "optional double") for i in range(40)] + [(f"long_{i:03d}", i + 41, "optional int64") for i in range(40)] + [(f"text_{i:03d}", i + 81, "optional string") for i in range(40)]
WIDE = define("wide", {"Wide": _WIDE})
WIDE_SQL = "SELECT o_orderkey, round(40 * o_totalprice, 2) AS doubles, 40 * o_custkey + 780 AS longs, 40 * length(o_orderpriority) AS chars FROM orders"


def _wide(spark, d):
    """Orders as messages of 120 fields."""
    o = table(spark, d, "orders")
    columns = [F.col("o_totalprice").alias(n) for n, _, k in _WIDE if "double" in k]
    columns += [(F.col("o_custkey") + i).alias(f"long_{i:03d}") for i in range(40)]
    columns += [F.col("o_orderpriority").alias(n) for n, _, k in _WIDE if "string" in k]
    return o.select("o_orderkey", to_protobuf(F.struct(*columns), "Wide", binaryDescriptorSet=WIDE).alias("data"))


def _wide_sums(m):
    total = lambda name: sum((F.col(f"m.{name}_{i:03d}") for i in range(1, 40)), F.col(f"m.{name}_000"))
    chars = F.length(F.concat(*[F.col(f"m.text_{i:03d}") for i in range(40)]))
    return m.select("o_orderkey", F.round(total("double"), 2).alias("doubles"), total("long").alias("longs"), chars.cast("long").alias("chars"))


@query(WIDE_SQL)
def wide_message(spark, d):
    return _wide_sums(_wide(spark, d).withColumn("m", from_protobuf("data", "Wide", binaryDescriptorSet=WIDE)))


@query(WIDE_SQL)
def wide_message_typed(spark, d):
    return _wide_sums(_wide(spark, d).withColumn("m", from_protobuf("data", "Wide", descriptor_file(WIDE))))


@query("SELECT o_orderkey, o_custkey + 7 AS long_007 FROM orders")
def wide_message_pruned(spark, d):
    return _wide(spark, d).select("o_orderkey", from_protobuf("data", "Wide", binaryDescriptorSet=WIDE, fields=["long_007"]).getField("long_007").alias("long_007"))


# --- frames over messages ----------------------------------------------------


@query("SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 100 AND c_custkey % 2 = 0")
def frame_join(spark, d):
    """A condition on an ordinary column reaches the scan; the join and the selection name what is decoded."""
    c = encoded(table(spark, d, "customer"), "Customer").select("c_custkey", "data")
    f = ProtoFrame(c, "data", "Customer", binaryDescriptorSet=SET).filter("proto.c_acctbal > 100 AND c_custkey % 2 = 0")
    return f.join(table(spark, d, "nation"), "coalesce(proto.c_nationkey, 0) = n_nationkey", "proto.c_name AS c_name", "n_name")


@query("SELECT c_mktsegment AS seg, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_nationkey < 10 GROUP BY 1")
def frame_group(spark, d):
    c = encoded(table(spark, d, "customer"), "Customer").select("c_nationkey", "data")
    f = ProtoFrame(c, "data", "Customer", binaryDescriptorSet=SET).where("c_nationkey < 10")
    return f.group(["proto.c_mktsegment AS seg"], n="count(1)", total="round(sum(proto.c_acctbal), 2)")


@query(
    """WITH o AS (SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0),
    l AS (SELECT c_mktsegment AS seg, n_name, round(sum(l_quantity), 2) AS qty FROM o JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = o_orderkey % 25 GROUP BY 1, 2)
    SELECT seg, n_name, qty, rank() OVER (PARTITION BY seg ORDER BY qty DESC, n_name)::BIGINT AS place FROM l"""
)
def frame_program(spark, d):
    """A join, an explode, an aggregate and a window over messages; the optimizer finds the three fields they need."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")

    def program(m):
        rows = m.select((F.col("proto.o_orderkey") % 25).alias("n_nationkey"), F.col("proto.customer.c_mktsegment").alias("seg"), F.explode("proto.lines.l_quantity").alias("q"))
        sums = rows.join(nation, "n_nationkey").groupBy("seg", "n_name").agg(F.round(F.sum("q"), 2).alias("qty"))
        return sums.withColumn("place", F.rank().over(Window.partitionBy("seg").orderBy(F.desc("qty"), "n_name")).cast("long"))

    return ProtoFrame(orders(spark, d), "data", "Order", binaryDescriptorSet=SET).filter("key % 2 = 0").query(program)


# --- encoders with options, descriptors, wire rules --------------------------


@query("SELECT n_nationkey, n_name AS by_file, n_name AS by_class, n_name AS by_set FROM nation")
def encode_with_options(spark, d):
    """The options of the three encoders are accepted and not used."""
    n, o = F.struct("n_name"), {"mode": "PERMISSIVE", "recursive.fields.max.depth": "3"}
    path, cls = descriptor_file(), message_class(SET, "shop.Nation")
    made = table(spark, d, "nation").select("n_nationkey", to_protobuf(n, "Nation", path, o).alias("f"), to_protobuf(n, cls, options=o).alias("c"), to_protobuf(n, "Nation", options=o, binaryDescriptorSet=SET).alias("b"))
    read = lambda c: from_protobuf(c, "Nation", binaryDescriptorSet=SET).getField("n_name")
    return made.select("n_nationkey", read("f").alias("by_file"), read("c").alias("by_class"), read("b").alias("by_set"))


@query("SELECT 'missing' AS what, 'shop/stamps.proto' AS named")
def descriptor_dependencies(spark, d):
    """A set whose files need one that it does not hold names that file."""
    from google.protobuf import descriptor_pb2

    files = descriptor_pb2.FileDescriptorSet.FromString(define("lone", {"Lone": [("id", 1, "int64")]}))
    files.file[0].dependency.append("shop/stamps.proto")
    raw = files.SerializeToString()
    text = _error(lambda: from_protobuf("id", "Lone", binaryDescriptorSet=raw))
    named = "shop/stamps.proto" if "shop/stamps.proto" in text and "ependency" in text else text
    return spark.createDataFrame([("missing", named)], "what string, named string")


@query("SELECT c_custkey, c_name AS any_case, 'ambiguous' AS both FROM customer")
def encode_name_matching(spark, d):
    """Names match in any case unless the session is case-sensitive; two that match one field are an error."""
    c = table(spark, d, "customer")
    m = c.select("c_custkey", to_protobuf(F.struct(F.col("c_name").alias("C_Name")), "Customer", binaryDescriptorSet=SET).alias("data"))
    text = _message_of(lambda: c.limit(1).select(to_protobuf(F.struct(F.col("c_name").alias("C_NAME"), F.col("c_name")), "Customer", binaryDescriptorSet=SET)).collect())
    both = "ambiguous" if "mbiguous" in text or "ultiple" in text or "everal" in text else text
    return m.select("c_custkey", from_protobuf("data", "Customer", binaryDescriptorSet=SET).getField("c_name").alias("any_case"), F.lit(both).alias("both"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS lost FROM orders")
def nested_limit(spark, d):
    """A nested message that claims more bytes than its parent has is malformed."""
    o = table(spark, d, "orders").select("o_orderkey")
    bad = F.unhex(F.lit("2A7F0801"))  # field 5, 127 bytes announced, 2 there
    good = to_protobuf(F.struct(F.struct(F.col("o_orderkey").alias("c_custkey")).alias("customer")), "Order", binaryDescriptorSet=SET)
    m = o.withColumn("data", F.when(F.col("o_orderkey") % 3 == 0, bad).otherwise(good))
    m = wire(m, "Order", options={"mode": "PERMISSIVE"}, fields=["customer.c_custkey"])
    return m.select("o_orderkey", (F.coalesce(F.col("m.customer.c_custkey"), F.lit(-1)) != F.col("o_orderkey")).alias("lost"))


@query("SELECT n_nationkey, n_name FROM nation")
def group_skip(spark, d):
    """An unknown group before a message's own fields is passed over."""
    group = F.unhex(F.lit("BB06" + "0805" + "BC06"))  # field 103: start, a varint, end
    n = encoded(table(spark, d, "nation"), "Nation", ["n_name"])
    m = wire(n.withColumn("data", F.concat(group, "data")), "Nation", fields=["n_name"])
    return m.select("n_nationkey", F.col("m.n_name").alias("n_name"))


@query("SELECT count(*) AS n, 0 AS fields, count(*) AS present FROM nation")
def empty_schema(spark, d):
    """A message type without fields is a struct without fields."""
    raw = define("bare", {"Bare": []})
    m = encoded(table(spark, d, "nation"), "Nation").select(from_protobuf("data", "Bare", binaryDescriptorSet=raw).alias("m"))
    width = len(m.schema["m"].dataType.fields)
    return m.agg(F.count(F.lit(1)).alias("n"), F.lit(width).alias("fields"), F.count_if(F.col("m").isNotNull()).alias("present"))


@query("SELECT 'Customer' AS message, 'c_acctbal, c_custkey, c_mktsegment, c_nationkey' AS left_out, 'struct<c_name:string>' AS schema")
def plan_inspection(spark, d):
    """What a decoder tells of itself."""
    made = decoder("Customer", binaryDescriptorSet=SET, fields=["c_name"])
    text = made.explain()
    left = text.split("not decoded: ")[1].strip()
    return spark.createDataFrame([("Customer" if "Customer" in text else text, left, made.schema.simpleString())], "message string, left_out string, schema string")
