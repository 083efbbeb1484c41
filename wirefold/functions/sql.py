"""SQL names for decode and encode.

A Python UDF's result type is fixed when it is registered, so one SQL name
decodes one message type.  ``protobuf_sql`` runs a query in which any number of
types are named, as literals; it registers a name for each on demand:

    protobuf_sql(spark, "SELECT from_protobuf(data, 'Person', '/path/x.desc').name FROM t")

For plain ``spark.sql`` there is a table function whose schema follows from its
literal arguments (Spark lets no Arrow table function have such an analysis, so
rows come one by one; they are decoded in blocks):

    SELECT * FROM decode_protobuf(TABLE(SELECT * FROM t), 'data', 'Person', '/path/x.desc')
"""

from __future__ import annotations

import datetime
import re
import zlib
from collections.abc import Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from wirefold import errors
from wirefold.functions import Decoder, decoder, encoder_udf
from wirefold.sources.descriptors import Source, resolve


def register_message(spark: SparkSession, name: str, messageType, descFilePath=None, options: Mapping[str, str] | None = None, binaryDescriptorSet: bytes | None = None, *, fields=None) -> None:
    """Make ``name(data)`` decode one message type in SQL."""
    spark.udf.register(name, decoder(messageType, descFilePath, options, binaryDescriptorSet, fields=fields).udf())


def register_encoder(spark: SparkSession, name: str, messageType, descFilePath=None, binaryDescriptorSet: bytes | None = None, *, strict: bool = False) -> None:
    """Make ``name(struct)`` encode one message type in SQL."""
    spark.udf.register(name, encoder_udf(resolve(messageType, descFilePath, binaryDescriptorSet), strict))


def _literal(arg: AnalyzeArgument | None, what: str) -> str:
    if arg is None or not arg.isConstantExpression or arg.value is None:
        raise errors.not_a_literal(what, "null" if arg is not None and arg.isConstantExpression else "an expression")
    return str(arg.value)


@dataclass
class Analyzed(AnalyzeResult):
    """What the analysis found, for the executors."""

    files: bytes = b""
    name: str = ""
    kind: str = ""
    dialect: str = ""


class DecodeProtobuf:
    """Rows of a table with the fields of one binary column's messages behind them.

    Arguments: the table, the column's name, the message's name, and the
    descriptor file (without it the name is a dotted path of a message class).
    A null or, in a file without them, an unreadable descriptor is an error at
    analysis.  Further arguments are ignored.
    """

    @staticmethod
    def analyze(*args: AnalyzeArgument) -> AnalyzeResult:
        if len(args) < 3:
            raise errors.too_few_arguments("decode_protobuf")
        table = args[0].dataType
        if not isinstance(table, T.StructType):
            raise errors.not_a_literal("the table", str(table))
        column, message = _literal(args[1], "column name"), _literal(args[2], "message name")
        path = _literal(args[3], "descriptor file path") if len(args) > 3 else None
        if column not in table.names:
            raise errors.unknown_path(column)
        # the descriptor file is read here, on the driver; its bytes travel
        found = decoder(message, path)
        source = found.source
        return Analyzed(schema=T.StructType([*table.fields, *found.schema.fields]), files=source.files, name=source.name, kind=source.kind, dialect=found.dialect)

    #: Messages that are decoded together.
    ROWS = 1024

    def __init__(self, analyzed: AnalyzeResult):
        self._read = _reader(Decoder(Source(analyzed.files, analyzed.name, analyzed.kind), analyzed.dialect))
        self._rows: list[tuple] = []
        self._raw: list[bytes | None] = []

    def eval(self, row, column, *_):
        self._rows.append(tuple(row))
        self._raw.append(None if row[column] is None else bytes(row[column]))
        if len(self._rows) >= self.ROWS:
            yield from self._flush()

    def terminate(self):
        yield from self._flush()

    def _flush(self):
        rows, raw = self._rows, self._raw
        self._rows, self._raw = [], []
        for row, values in zip(rows, self._read(raw) if rows else ()):
            yield (*row, *values)


def _reader(made: Decoder):
    """From messages to the values of their fields, by the columnar decoder."""
    run, fields = made.function(), made.schema.fields

    def shaped(value, kind):
        """A decoded value as rows of a Python table function hold it."""
        if value is None:
            return None
        if isinstance(kind, T.TimestampType):
            return value.astimezone(datetime.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
        if isinstance(kind, T.StructType):
            return tuple(shaped(value[f.name], f.dataType) for f in kind.fields)
        if isinstance(kind, T.ArrayType):
            return [shaped(v, kind.elementType) for v in value]
        if isinstance(kind, T.MapType):
            return {k: shaped(v, kind.valueType) for k, v in value}
        return value

    def read(raw: list[bytes | None]):
        for found in run(pa.array(raw, pa.binary())).to_pylist():
            yield (None,) * len(fields) if found is None else tuple(shaped(found[f.name], f.dataType) for f in fields)

    return read


# --- names on demand ---------------------------------------------------------

#: What a query's text consists of: strings, quoted names, comments, words, and single characters.
_PART = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|\w+|\s+|.""", re.DOTALL)
_CALLS = ("from_protobuf", "to_protobuf")


def _literal_text(part: str, what: str) -> str:
    part = part.strip()
    m = _PART.fullmatch(part)
    if not m or part[:1] not in ("'", '"'):
        raise errors.not_a_literal(what, part or "nothing")
    mark = part[0]
    return re.sub(r"\\(.)", r"\1", part[1:-1].replace(mark * 2, mark))


def _rewritten(spark: SparkSession, text: str) -> str:
    parts = _PART.findall(text)
    out, i = [], 0
    while i < len(parts):
        word, i = parts[i], i + 1
        k = i
        while k < len(parts) and parts[k].isspace():
            k += 1
        if word.lower() not in _CALLS or (len(out) and out[-1] == ".") or k == len(parts) or parts[k] != "(":
            out.append(word)
            continue
        args, depth, i = [""], 1, k + 1
        while i < len(parts) and depth:
            p, i = parts[i], i + 1
            depth += (p in "([") - (p in ")]") if len(p) == 1 else 0
            if depth == 1 and p == ",":
                args.append("")
            elif depth:
                args[-1] += p
        if depth or len(args) < 2 or not args[0].strip():
            raise errors.too_few_arguments(word.lower())
        message = _literal_text(args[1], "message name")
        path = _literal_text(args[2], "descriptor file path") if len(args) > 2 else None
        name = f"{word.lower()}_{zlib.crc32(repr((message, path)).encode()):08x}"
        if word.lower() == _CALLS[0]:
            register_message(spark, name, message, path)
        else:
            register_encoder(spark, name, message, path)
        out.append(f"{name}({_rewritten(spark, args[0])})")
    return "".join(out)


def protobuf_sql(spark: SparkSession, text: str) -> DataFrame:
    """``spark.sql`` for queries that call from_protobuf and to_protobuf (data, 'Message'[, 'descriptor file']).

    Without a file the message is a dotted path of a message class.  Further
    arguments are ignored.  Strings, quoted names and comments are left alone.
    """
    return spark.sql(_rewritten(spark, text))


def register_functions(spark: SparkSession) -> None:
    """Register the table function ``decode_protobuf``."""
    spark.udtf.register("decode_protobuf", udtf(DecodeProtobuf))


__all__ = ["DecodeProtobuf", "protobuf_sql", "register_encoder", "register_functions", "register_message"]
