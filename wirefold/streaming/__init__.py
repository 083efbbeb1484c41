"""Messages in Structured Streaming.

Decoding is a stateless projection, so a decoded stream is an ordinary stream:
watermarks, windows, joins and state are Spark's own.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from wirefold.functions import decode, to_protobuf


def decode_stream(stream: DataFrame, data: str, messageType=None, descFilePath=None, options: Mapping[str, str] | None = None, binaryDescriptorSet: bytes | None = None, *, name: str = "proto", fields=None) -> DataFrame:
    """The stream with its messages as a struct in place of the bytes."""
    out = decode(stream, data, messageType, descFilePath, options, binaryDescriptorSet, name=name, fields=fields)
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c != data])


def encode_stream(stream: DataFrame, struct: Column, messageType=None, descFilePath=None, binaryDescriptorSet: bytes | None = None, *, name: str = "data") -> DataFrame:
    """The stream's structs as messages, for a sink that takes bytes."""
    return stream.select(to_protobuf(struct, messageType, descFilePath, None, binaryDescriptorSet).alias(name))


def windowed(stream: DataFrame, time: str, width: str, *keys: str, slide: str | None = None, late: str = "10 minutes", **aggregates: Column) -> DataFrame:
    """Tumbling or sliding window aggregates with a watermark; columns window_start, keys, aggregates."""
    frame = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    marked = stream.withWatermark(time, late)
    grouped = marked.groupBy(frame.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(F.col("w.start").alias("window_start"), *keys, *aggregates)


def sessions(stream: DataFrame, time: str, gap: str, *keys: str, late: str | None = "10 minutes", **aggregates: Column) -> DataFrame:
    """Session window aggregates with a watermark; columns session_start, session_end, keys, aggregates.

    A session ends ``gap`` after its last row, and a row at that very instant
    opens a new one (Spark's own session windows join such rows).  Rows without
    a time are in no session.  Without ``late`` there is no watermark: for
    "complete" mode, where Spark else drops rows before 1970, as its first
    watermark, and late rows of later batches.
    """
    rows = stream if late is None else stream.withWatermark(time, late)
    grouped = rows.groupBy(F.session_window(F.col(time), f"{gap} -1 microsecond").alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    end = F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")
    return grouped.select(F.col("w.start").alias("session_start"), end.alias("session_end"), *keys, *aggregates)


def matched(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, *, late: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Stream-stream join: rows of one key whose right time is at most ``within`` after the left time.

    Both watermarks and the time bound let Spark drop state that no later row can match.
    """
    right = right.withColumnRenamed(key, f"_{key}").withWatermark(right_time, late)
    span = (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {within}"))
    return left.withWatermark(left_time, late).join(right, (F.col(key) == F.col(f"_{key}")) & span, how).drop(f"_{key}")


def running(stream: DataFrame, key: str, value: str) -> DataFrame:
    """State by key across micro-batches: after each batch, for each key that it holds, the number, sum and largest of all values so far.

    Arrow batches of pandas frames, never single rows; a key's rows of one
    micro-batch may come in several batches.  Update mode.
    """
    kind = stream.schema[key].dataType.simpleString()

    def advance(who, frames, state):
        n, total, most = state.get if state.exists else (0, 0.0, float("-inf"))
        for f in frames:
            found = f[value].dropna()
            n += len(found)
            total += float(found.sum())
            most = max(most, float(found.max())) if len(found) else most
        state.update((n, total, most))
        yield pd.DataFrame({key: [who[0]], "n": [n], "total": [total], "most": [most]})

    rows = stream.select(key, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(advance, f"`{key}` {kind}, n long, total double, most double", "n long, total double, most double", "update", GroupStateTimeout.NoTimeout)


def drain(query: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now, and return what it wrote.

    In "append" mode the sink is Parquet in ``folder``; in "complete" mode each
    batch replaces it; in "update" mode each batch is written to a folder of
    its own, with its number as the column ``batch``.  The checkpoint lies
    beside it.
    """
    spark = query.sparkSession
    schema = query.schema
    writer = query.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    if mode == "append":
        run: StreamingQuery = writer.format("parquet").outputMode("append").start(f"{folder}/out")
    elif mode == "update":
        run = writer.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).start()
        schema = schema.add("batch", "long")
    else:
        run = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")
