"""Message objects as DataFrames, and parts of binary columns as messages."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from google.protobuf.message import Message
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.functions import Decoder
from wirefold.options import Options
from wirefold.plans.schema import typed_schema
from wirefold.sources.descriptors import Source, files_of


def messages_to_df(spark: SparkSession, messages: Iterable[Message] | RDD, message_class=None, options: Mapping[str, str] | None = None) -> DataFrame:
    """A DataFrame with the fields of message objects, in the typed schema.

    The objects travel as their bytes and are decoded by the columnar decoder
    on the executors, so an RDD of messages is never gathered.  The class is
    needed where it cannot be taken from a first object (an RDD, no objects).
    """
    if isinstance(messages, RDD):
        if message_class is None:
            raise ValueError("an RDD of messages needs message_class")
        raw = spark.createDataFrame(messages.map(lambda m: (bytearray(m.SerializeToString()),)), "data binary")
    else:
        held = list(messages)
        if message_class is None:
            if not held:
                raise ValueError("no messages: message_class is needed")
            message_class = type(held[0])
        raw = spark.createDataFrame([(bytearray(m.SerializeToString()),) for m in held], "data binary")
    descriptor = message_class.DESCRIPTOR
    typed_schema(descriptor, Options.of(options))  # errors of the schema show on the driver
    source = Source(files_of(descriptor).SerializeToString(), descriptor.full_name, "class")
    made = Decoder(source, "generated", Options.of(options))(F.col("data"))
    return raw.select(made.alias("m")).select("m.*")


def slice_bytes(data: Column | str, offset: Column | int, length: Column | int) -> Column:
    """Bytes of a message inside a larger binary; offsets count from 0."""
    one = F.col(data) if isinstance(data, str) else data
    at = offset + 1 if isinstance(offset, Column) else F.lit(offset + 1)
    size = length if isinstance(length, Column) else F.lit(length)
    return F.substring(one, at, size)
