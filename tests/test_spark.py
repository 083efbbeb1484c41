"""Functions, frames and names in Spark, and every registered query against its oracle."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wirefold import errors, functions
from wirefold.functions import decode, decoder, from_protobuf, to_protobuf
from wirefold.plans.frame import ProtoFrame
from wirefold.queries import ORACLE, QUERIES
from wirefold.queries.messages import SET, descriptor_file, encoded, lines, table
from wirefold.sources.descriptors import message_class
from wirefold.sources.messages import messages_to_df

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame):
    """Rows as sorted tuples; numbers as rounded floats, all missing values as None."""

    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, str | bool) or not hasattr(v, "__float__"):
            return v
        return round(float(v), 6)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(one, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def against_oracle(spark, folder, name, **tables):
    """A query's rows over tables given as SQL, held against its oracle's."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"CREATE TABLE {t} AS {sql}")
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet' (FORMAT parquet)")
    assert rows(QUERIES[name](spark, str(folder)).toPandas()) == rows(con.execute(ORACLE[name]).df())


def test_long_strings_keeps_empty_texts(spark, tmp_path):
    documents = "SELECT * FROM (VALUES (0, ''), (1, NULL), (2, 'one'), (NULL, 'two'), (NULL, NULL)) AS t(doc_id, text)"
    against_oracle(spark, tmp_path, "long_strings", documents=f"SELECT doc_id::BIGINT AS doc_id, text FROM ({documents})", labels="SELECT 0::BIGINT AS doc_id, 1::INTEGER AS quality")


def test_sessions_hold_every_event(spark, tmp_path):
    # gaps of exactly two hours and one millisecond less, equal times; no user beside user 0; no time; before 1970
    found = """(VALUES
        (1, TIMESTAMP '2024-03-01 00:00:00', 7), (2, TIMESTAMP '2024-03-01 02:00:00', 7), (3, TIMESTAMP '2024-03-01 03:59:59.999', 7), (4, TIMESTAMP '2024-03-01 03:59:59.999', 7),
        (5, TIMESTAMP '2024-03-01 05:59:59.9985', 7), (6, TIMESTAMP '2024-03-01 05:59:59.999001', 7),
        (7, TIMESTAMP '2024-03-01 00:00:00', NULL), (8, TIMESTAMP '2024-03-01 00:00:01', 0), (9, TIMESTAMP '2024-03-01 00:00:02', NULL),
        (10, NULL, 7), (11, NULL, 7), (12, NULL, NULL), (13, TIMESTAMP '1965-01-01 00:00:00.0005', 8), (14, TIMESTAMP '1969-12-31 23:00:00', 8), (15, TIMESTAMP '1970-01-01 00:30:00', 8)) AS t(event_id, ts, user_id)"""
    against_oracle(spark, tmp_path, "stream_session", events=f"SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, 'view' AS event_type, 1.5::DOUBLE AS value FROM {found}")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pruned_decode_reads_only_named_fields(spark):
    f = ProtoFrame(lines(spark, SF), "data", "Line", binaryDescriptorSet=SET).filter("proto.l_quantity > 20")
    assert f.decoder_for(["proto.l_orderkey"]).pruned_schema.names == ["l_orderkey", "l_quantity"]
    assert f.decoder_for(["proto"]).pruned_schema is None
    assert f.select("proto.l_orderkey").columns == ["l_orderkey"]
    with pytest.raises(errors.AnalysisError, match="No field at path"):
        decoder("Line", SET, fields=["l_nothing"])


def test_pruning_can_be_switched_off(spark):
    spark.conf.set(functions.PRUNING, "false")
    try:
        assert decoder("Line", SET, fields=["l_orderkey"]).pruned_schema is None
    finally:
        spark.conf.unset(functions.PRUNING)
    assert decoder("Line", SET, fields=["l_orderkey"]).pruned_schema.names == ["l_orderkey"]
    # only the wire dialect prunes
    assert decoder("Line", descriptor_file(), fields=["l_orderkey"]).pruned_schema is None


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_decode_for_filter_and_projection(spark):
    binary = spark.range(9).selectExpr("cast('' as binary) as data")
    for df in (
        binary.select(from_protobuf("data", "Line", binaryDescriptorSet=SET, deterministic=False).alias("p")).filter("p.l_quantity is null").select("p.l_orderkey"),
        decode(binary, "data", "Line", binaryDescriptorSet=SET, name="p").filter("p.l_quantity is null").select("p.l_orderkey"),
    ):
        assert plan_of(df).count("ArrowEvalPython") == 1 and df.count() == 9


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("messages") / "customers.parquet")
    encoded(table(spark, SF, "customer"), "Customer").select("c_custkey", "c_nationkey", "data").write.parquet(place)
    return place


def test_filters_on_ordinary_columns_reach_the_scan(spark, customers):
    df = spark.read.parquet(customers)
    nation = table(spark, SF, "nation")
    made = decode(df, "data", "Customer", binaryDescriptorSet=SET, name="p")
    frame = ProtoFrame(df, "data", "Customer", binaryDescriptorSet=SET)
    ways = [
        df.withColumn("p", from_protobuf("data", "Customer", binaryDescriptorSet=SET)).where("c_nationkey = 3").select("p.c_name"),
        made.where("c_nationkey = 3").select("p.c_name"),
        made.where("p.c_acctbal > 0 AND c_nationkey = 3").select("p.c_name"),
        made.join(nation, F.col("p.c_nationkey") == F.col("n_nationkey")).where("c_nationkey = 3").select("p.c_name", "n_name"),
        frame.filter("proto.c_acctbal > 0 AND c_nationkey = 3").select("proto.c_name"),
        frame.filter("c_nationkey = 3").join(nation, "proto.c_nationkey = n_nationkey", "proto.c_name", "n_name"),
        frame.filter("c_nationkey = 3").group(["proto.c_mktsegment"], n="count(1)"),
    ]
    want = spark.read.parquet(f"{SF}/customer.parquet").where("c_nationkey = 3")
    for df in ways:
        plan = plan_of(df)
        assert "EqualTo(c_nationkey,3)" in plan and plan.count("ArrowEvalPython") == 1, plan
        # nothing that fails the filter is decoded
        assert plan.index("ArrowEvalPython") < plan.index("c_nationkey#", plan.index("ArrowEvalPython"))
    assert ways[0].count() == ways[1].count() == want.count() and ways[2].count() == ways[4].count() == want.where("c_acctbal > 0").count()


def test_the_optimizer_finds_the_fields(spark, customers):
    frame = ProtoFrame(spark.read.parquet(customers), "data", "Customer", binaryDescriptorSet=SET)
    nation, seen = table(spark, SF, "nation"), []

    def watched(program):
        def run(df):
            seen.append(sorted(df.schema["proto"].dataType.names))
            return program(df)

        return frame.filter("c_custkey > 3").query(run)

    joined = watched(lambda df: df.join(nation, F.col("proto.c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.max("proto.c_acctbal").alias("most")))
    assert seen.pop() == ["c_acctbal", "c_nationkey"] and joined.count() > 0 and plan_of(joined).count("ArrowEvalPython") == 1
    twice = watched(lambda df: df.select("proto.c_name").union(df.select("proto.c_mktsegment")))
    assert seen.pop() == ["c_mktsegment", "c_name"] and twice.count() == 2 * spark.read.parquet(customers).where("c_custkey > 3").count()
    assert watched(lambda df: df.select("c_custkey")).count() > 0 and len(seen.pop()) == 1
    whole = watched(lambda df: df.select("proto"))
    assert len(seen.pop()) == 5 and whole.schema["proto"].dataType.names == frame.full_schema.names


def test_decode_replaces_a_column_of_its_name(spark):
    df = encoded(table(spark, SF, "nation"), "Nation").select("n_nationkey", "data")
    out = decode(df, "data", "Nation", SET, name="data")
    assert out.columns == ["n_nationkey", "data"] and out.where("data.n_name is not null").count() == 25
    bad = spark.range(2).select(F.when(F.col("id") == 0, F.unhex(F.lit("FFFFFF"))).alias("data"))
    assert [r.proto for r in decode(bad, "data", "Nation", SET, {"mode": "PERMISSIVE"}).collect()] == [None, None]


def test_sql_on_demand_broadcasts_no_decoded_side(spark):
    plan = QUERIES["sql_on_demand"](spark, SF)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_sql_on_demand_wants_literals(spark):
    from wirefold.functions.sql import protobuf_sql

    encoded(table(spark, SF, "nation"), "Nation").select("data").createOrReplaceTempView("m")
    with pytest.raises(errors.AnalysisError, match="at least 2 arguments"):
        protobuf_sql(spark, "SELECT from_protobuf(data) FROM m")
    with pytest.raises(errors.AnalysisError, match="literal string for message name"):
        protobuf_sql(spark, "SELECT from_protobuf(data, concat('Na', 'tion')) FROM m")
    path = descriptor_file()
    assert protobuf_sql(spark, f"SELECT x.n_name FROM (SELECT from_protobuf (data , 'Nation', '{path}', 'more') AS x FROM m) WHERE x.n_name <> 'to_protobuf(' /* from_protobuf( */").count() == 25
    assert protobuf_sql(spark, "SELECT 'from_protobuf(a)' AS `from_protobuf(b)`").columns == ["from_protobuf(b)"]


def test_signatures(spark):
    df = encoded(table(spark, SF, "nation"), "Nation").select("data")
    path, cls = descriptor_file(), message_class(SET, "shop.Nation")
    forms = [
        from_protobuf("data", "Nation", path),
        from_protobuf(F.col("data"), "Nation", path, {"mode": "PERMISSIVE"}),
        from_protobuf("data", cls),
        from_protobuf("data", cls, options={"mode": "FAILFAST"}),
        from_protobuf("data", "Nation", SET),
        from_protobuf("data", messageName="Nation", binaryDescriptorSet=SET, options={"mode": "FAILFAST"}),
    ]
    for form in forms:
        assert df.select(form.alias("m")).where("m.n_name = 'CHINA' or m.n_name is not null").count() == 25
    n = F.struct(F.lit("x").alias("n_name"))
    ways = [to_protobuf(n, "Nation", path), to_protobuf(n, "Nation", path, {"a": "b"}), to_protobuf(n, cls), to_protobuf(n, cls, options={}), to_protobuf(n, "Nation", SET), to_protobuf(n, messageName="Nation", binaryDescriptorSet=SET)]
    assert {bytes(r[0]) for w in ways for r in spark.range(1).select(w).collect()} == {b"\x12\x01x"}


def test_explain_names_what_is_left_out(spark):
    text = decoder("Nation", SET, fields=["n_name"]).explain()
    assert "wire dialect" in text and "not decoded: n_nationkey, n_regionkey" in text


def test_columns_need_a_session(spark, monkeypatch):
    monkeypatch.setattr("pyspark.SparkContext._active_spark_context", None)
    with pytest.raises(RuntimeError, match="No active Spark session"):
        from_protobuf("data", "Nation", SET)


def test_rdd_of_messages(spark):
    cls = message_class(SET, "shop.Nation")
    assert messages_to_df(spark, [], cls).count() == 0
    made = spark.sparkContext.parallelize([b"\x12\x01x", b"\x08\x05"], 2)
    raw = SET
    rdd = made.map(lambda b: message_class(raw, "shop.Nation").FromString(b))
    assert sorted(map(tuple, messages_to_df(spark, rdd, cls).collect())) == [(0, "x", 0), (5, "", 0)]
    with pytest.raises(ValueError):
        messages_to_df(spark, [])


def test_unsupported_mode_is_reported_only_at_a_malformed_row(spark):
    ok = encoded(table(spark, SF, "nation"), "Nation")
    mode = {"mode": "DROPMALFORMED"}
    assert ok.select(from_protobuf("data", "Nation", SET, mode).alias("m")).where("m is not null").count() == 25
    with pytest.raises(Exception, match="Unsupported parse mode 'DROPMALFORMED'"):
        spark.range(1).select(from_protobuf(F.unhex(F.lit("FF")), "Nation", SET, mode)).collect()


def test_table_function_wants_literals(spark):
    from wirefold.functions.sql import register_functions

    register_functions(spark)
    encoded(table(spark, SF, "nation"), "Nation").select("data").createOrReplaceTempView("m")
    with pytest.raises(Exception, match="requires at least 2 arguments"):
        spark.sql("SELECT * FROM decode_protobuf(TABLE(m))").collect()
    with pytest.raises(Exception, match="Expected a literal string for message name"):
        spark.sql("SELECT * FROM decode_protobuf(TABLE(m), 'data', CAST(NULL AS STRING))").collect()


def test_three_sources_decode_the_same_message(spark, tmp_path):
    """A well-known message with enums, lists and nested messages, by class, file and descriptor set."""
    from google.protobuf import type_pb2

    from wirefold.sources.descriptors import files_of

    message = type_pb2.Type(name="TestType", oneofs=["a", "b"], fields=[type_pb2.Field(name="f", number=3, kind="TYPE_INT32", packed=True)], syntax="SYNTAX_PROTO3")
    raw = files_of(type_pb2.Type.DESCRIPTOR).SerializeToString()
    place = tmp_path / "type.desc"
    place.write_bytes(raw)
    df = spark.createDataFrame([(bytearray(message.SerializeToString()),)], "data binary")
    row = df.select(
        from_protobuf("data", "google.protobuf.type_pb2.Type").alias("c"), from_protobuf("data", "Type", str(place)).alias("f"), from_protobuf("data", "google.protobuf.Type", binaryDescriptorSet=raw).alias("b")
    ).first()
    assert row.c.name == row.f.name == row.b.name == "TestType" and row.c.oneofs == row.f.oneofs == row.b.oneofs == ["a", "b"]
    assert row.c.fields[0].kind == row.f.fields[0].kind == "TYPE_INT32" and row.b.fields[0].kind == 5
    assert (row.c.syntax, row.f.syntax, row.b.syntax) == ("SYNTAX_PROTO3", "SYNTAX_PROTO3", 1)
    assert (row.c.edition, row.f.edition, row.b.edition) == ("", None, None)
