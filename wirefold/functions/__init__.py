"""from_protobuf and to_protobuf: columns of messages to structs and back."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold import errors
from wirefold.operators import encode, typed, wire
from wirefold.options import Options
from wirefold.plans.prune import check_paths, prune_schema, required_paths
from wirefold.plans.schema import schema_of
from wirefold.sources.descriptors import Source, descriptor_of, resolve

PRUNING = "spark.sql.protobuf.nestedSchemaPruning.enabled"
#: Which dialect each kind of descriptor source decodes in.
DIALECTS = {"binary": "wire", "file": "typed", "class": "generated"}


def _pruning_enabled() -> bool:
    session = SparkSession.getActiveSession()
    return session is None or session.conf.get(PRUNING, "true").lower() != "false"


@dataclass
class Decoder:
    """A decode of one message type: schema on the driver, work on the executors.

    Only the descriptor's bytes, the schema and the options travel.  Parsers
    are made once for each Python worker.
    """

    source: Source
    dialect: str
    options: Options = field(default_factory=Options)
    fields: tuple[str, ...] | None = None

    def __post_init__(self):
        self.full_schema = schema_of(self.source.descriptor, self.dialect, self.options)
        self.pruned_schema: T.StructType | None = None
        if self.fields is not None:
            check_paths(self.full_schema, self.fields)
            if self.dialect == "wire" and _pruning_enabled():
                self.pruned_schema = prune_schema(self.full_schema, self.fields)

    @property
    def schema(self) -> T.StructType:
        return self.full_schema if self.pruned_schema is None else self.pruned_schema

    def explain(self) -> str:
        """What is decoded, for reading: source, dialect, schema, and the fields that pruning left out."""
        lines = [f"{self.source.name} ({self.source.kind} descriptor, {self.dialect} dialect, mode {self.options.mode})", self.schema.treeString().rstrip()]
        if self.pruned_schema is not None:
            left = sorted(set(required_paths(self.full_schema)) - set(required_paths(self.pruned_schema)))
            lines.append(f"not decoded: {', '.join(left) or 'nothing'}")
        return "\n".join(lines)

    def function(self) -> Callable[[pa.Array], pa.Array]:
        """What runs on a column of message bytes."""
        files, name, dialect, options, schema = self.source.files, self.source.name, self.dialect, self.options, self.schema
        key = (files, name, dialect, options, schema.json())

        def run(column: pa.Array) -> pa.Array:
            return _parser(key, schema)(column)

        return run

    def udf(self, deterministic: bool = True):
        """An Arrow UDF; a fresh one each time, as marking changes the object.

        Deterministic, so that filters on ordinary columns move below it and
        reach the scan.  A filter or join on the decoded struct then decodes
        once for itself and once more for the rows that pass; marked
        non-deterministic, a decode is made once for both, but stops every
        filter.  ``decode`` and ``ProtoFrame`` have neither fault.
        """
        run = self.function()

        def from_protobuf(column: pa.Array) -> pa.Array:
            return run(column)

        out = F.arrow_udf(from_protobuf, self.schema)
        return out if deterministic else out.asNondeterministic()

    def __call__(self, data: Column | str, deterministic: bool = True) -> Column:
        return self.udf(deterministic)(_column(data))


_local = threading.local()


def _parser(key: tuple, schema: T.StructType) -> Callable[[pa.Array], pa.Array]:
    """The parser for a key, made once in each worker thread."""
    made = _local.__dict__.setdefault("parsers", {})
    if key not in made:
        files, name, dialect, options, _ = key
        descriptor = descriptor_of(files, name)
        if dialect == "wire":
            node = wire.plan(descriptor, schema)
            made[key] = lambda column: wire.decode_column(column, node, options.permissive)
        else:
            made[key] = typed.column_decoder(descriptor, schema, dialect, options.permissive)
    return made[key]


def _column(data: Column | str) -> Column:
    if SparkContext._active_spark_context is None:
        raise RuntimeError("No active Spark session: create one before building Protobuf columns")
    return F.col(data) if isinstance(data, str) else data


def _source(messageType, descFilePath, binaryDescriptorSet, messageName) -> Source:
    message = messageType if messageType is not None else messageName
    if message is None:
        raise errors.too_few_arguments("from_protobuf")
    return resolve(message, descFilePath, binaryDescriptorSet)


def decoder(
    messageType=None,
    descFilePath: str | bytes | None = None,
    options: Mapping[str, str] | None = None,
    binaryDescriptorSet: bytes | None = None,
    *,
    messageName=None,
    fields: Iterable[str] | None = None,
    dialect: str | None = None,
) -> Decoder:
    source = _source(messageType, descFilePath, binaryDescriptorSet, messageName)
    if dialect is None:
        dialect = DIALECTS[source.kind]
    elif dialect not in DIALECTS.values():
        raise errors.IllegalArgument(f"Unknown dialect '{dialect}'; known: {', '.join(DIALECTS.values())}")
    return Decoder(source, dialect, Options.of(options), None if fields is None else tuple(fields))


def from_protobuf(
    data: Column | str,
    messageType=None,
    descFilePath: str | bytes | None = None,
    options: Mapping[str, str] | None = None,
    binaryDescriptorSet: bytes | None = None,
    *,
    messageName=None,
    fields: Iterable[str] | None = None,
    dialect: str | None = None,
    deterministic: bool = True,
) -> Column:
    """Decode a binary column of messages to a struct.

    The descriptor is, in this order: ``binaryDescriptorSet`` (dialect "wire"),
    ``descFilePath`` (a file, dialect "typed"; bytes there are a descriptor
    set), or a generated Python class or its dotted path in ``messageType``
    (dialect "generated").  ``fields`` lists dotted paths; with the "wire"
    dialect only these are decoded, and the struct holds no others.
    ``deterministic=False`` makes one decode serve filters on the struct and
    projections alike, at the price that no filter moves below it.
    """
    made = decoder(messageType, descFilePath, options, binaryDescriptorSet, messageName=messageName, fields=fields, dialect=dialect)
    return made(data, deterministic)


def decode(
    df: DataFrame,
    data: str,
    messageType=None,
    descFilePath: str | bytes | None = None,
    options: Mapping[str, str] | None = None,
    binaryDescriptorSet: bytes | None = None,
    *,
    name: str = "proto",
    messageName=None,
    fields: Iterable[str] | None = None,
    dialect: str | None = None,
) -> DataFrame:
    """``df`` with the messages of its column ``data`` as one more column, the struct ``name`` (a column of that name is replaced).

    The struct comes out of a generator over an array of one.  Spark moves
    filters on other columns below a generator, down to the scan, and filters
    and joins on its result never into it: a row that passes the former is
    decoded, once.
    """
    made = decoder(messageType, descFilePath, options, binaryDescriptorSet, messageName=messageName, fields=fields, dialect=dialect)
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*kept, F.inline_outer(F.array(F.struct(made(F.col(f"`{data}`")).alias(name)))))


def _encode(column: pa.Array, files: bytes, name: str, strict: bool, case_sensitive: bool) -> pa.Array:
    """Encode a column with an encoder that is made once in each worker thread."""
    made = _local.__dict__.setdefault("encoders", {})
    key = (files, name, str(column.type), strict, case_sensitive)
    if key not in made:
        made[key] = encode.Encoder(descriptor_of(files, name), column.type, case_sensitive, strict)
    return made[key].column(column)


def encoder_udf(source: Source, strict: bool = False, case_sensitive: bool = False):
    files, name = source.files, source.name

    def to_protobuf(column: pa.Array) -> pa.Array:
        return _encode(column, files, name, strict, case_sensitive)

    return F.arrow_udf(to_protobuf, T.BinaryType())


def to_protobuf(
    data: Column | str,
    messageType=None,
    descFilePath: str | bytes | None = None,
    options: Mapping[str, str] | None = None,
    binaryDescriptorSet: bytes | None = None,
    *,
    messageName=None,
    strict: bool = False,
) -> Column:
    """Encode a struct column as messages.

    Fields are matched by name, case-sensitively if spark.sql.caseSensitive
    says so.  Options are accepted and not used.  ``strict`` rejects numbers
    for enum fields.
    """
    session = SparkSession.getActiveSession()
    sensitive = session is not None and session.conf.get("spark.sql.caseSensitive", "false").lower() == "true"
    return encoder_udf(_source(messageType, descFilePath, binaryDescriptorSet, messageName), strict, sensitive)(_column(data))
