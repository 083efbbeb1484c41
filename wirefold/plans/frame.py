"""A frame over a message column that decodes only what its query uses.

Spark cannot narrow the struct that a Python function returns, so the pruning
is done before the plan is made: the frame collects the fields that its filters,
projections, joins and groupings name, decodes their union once, and leaves the
rest to Spark.  ``query`` has Spark's own optimizer find the fields, for any
DataFrame program.  Conditions on ordinary columns move below the decode, so
they reach the scan and rows that fail them are never decoded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold import errors
from wirefold.functions import decode, decoder
from wirefold.plans.prune import check_paths, leaf_paths, required_paths
from wirefold.sources.scratch import scratch_dir


def fields_read(plan: DataFrame, folder: str, name: str) -> T.StructType | None:
    """What a plan reads of the struct ``name`` of a Parquet folder, as Spark's nested schema pruning has it."""
    leaves, found = plan._jdf.queryExecution().sparkPlan().collectLeaves(), None
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "FileSourceScanExec" or folder not in leaf.relation().location().rootPaths().mkString(","):
            continue
        read = T.StructType.fromJson(json.loads(leaf.requiredSchema().json()))
        if name in read.names:
            found = read[name].dataType if found is None else merged(found, read[name].dataType)
    return found


def merged(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type with the fields of both."""
    if isinstance(a, T.StructType):
        other = {f.name: f.dataType for f in b.fields}
        own = [T.StructField(f.name, merged(f.dataType, other[f.name]) if f.name in other else f.dataType, f.nullable) for f in a.fields]
        return T.StructType([*own, *(f for f in b.fields if f.name not in a.names)])
    if isinstance(a, T.ArrayType):
        return T.ArrayType(merged(a.elementType, b.elementType), a.containsNull)
    if isinstance(a, T.MapType):
        return T.MapType(a.keyType, merged(a.valueType, b.valueType), a.valueContainsNull)
    return a


class ProtoFrame:
    """``df`` with the messages of its binary column ``data`` as the struct ``name``.

    Filters and selections are strings (SQL expressions) over the struct's
    dotted fields and the frame's other columns.  Whole-struct use keeps every
    field.
    """

    def __init__(self, df: DataFrame, data: str, messageType=None, descFilePath=None, options=None, binaryDescriptorSet=None, *, name: str = "proto", dialect: str | None = None):
        self.df, self.data, self.name = df, data, name
        self.how = dict(messageType=messageType, descFilePath=descFilePath, options=options, binaryDescriptorSet=binaryDescriptorSet, dialect=dialect)
        self.full_schema = decoder(**self.how).full_schema
        self.conditions: tuple[str, ...] = ()

    def filter(self, condition: str) -> ProtoFrame:
        out = object.__new__(ProtoFrame)
        out.__dict__.update(self.__dict__)
        out.conditions = (*self.conditions, condition)
        return out

    where = filter

    def paths(self, expressions: Iterable[str]) -> list[str]:
        """Fields of the struct that expressions name; the empty path for the struct itself."""
        known = set(required_paths(self.full_schema))
        out: set[str] = set()
        for e in expressions:
            bare = re.sub(r"'(?:[^'\\]|\\.)*'", "''", e)
            for m in re.finditer(rf"(?<![\w.`]){re.escape(self.name)}((?:\s*(?:\.\s*`?\w+`?|\[[^\]]*\]))*)", bare):
                path = ".".join(re.findall(r"\.\s*`?(\w+)`?", m[1]))
                # a call on a map or array may look like a deeper path: the longest known prefix counts
                while path and path not in known:
                    path = path.rpartition(".")[0]
                out.add(path)
        return sorted(out)

    def fields_of(self, expressions: Iterable[str]) -> list[str]:
        """Fields that expressions and the frame's conditions name."""
        paths = self.paths([*expressions, *self.conditions])
        check_paths(self.full_schema, paths)
        return paths

    def decoder_for(self, expressions: Iterable[str]):
        """The decoder that a selection would use; its pruned_schema shows what is decoded."""
        paths = self.fields_of(expressions)
        return decoder(**self.how, fields=None if "" in paths else paths)

    def _frame(self, expressions: Iterable[str]) -> DataFrame:
        """The filtered frame with the struct of the fields that expressions and conditions name."""
        paths = self.fields_of(expressions)
        out = decode(self.df, self.data, **self.how, name=self.name, fields=None if "" in paths else paths)
        for c in self.conditions:
            out = out.filter(c)
        return out

    def select(self, *expressions: str) -> DataFrame:
        if not expressions:
            raise errors.IllegalArgument("nothing selected")
        return self._frame(expressions).selectExpr(*expressions)

    def group(self, keys: Iterable[str], **aggregates: str) -> DataFrame:
        """Aggregates (SQL expressions by name) by keys (SQL expressions); only their fields are decoded."""
        keys = list(keys)
        if not aggregates:
            raise errors.IllegalArgument("nothing selected")
        return self._frame([*keys, *aggregates.values()]).groupBy(*map(F.expr, keys)).agg(*[F.expr(e).alias(n) for n, e in aggregates.items()])

    def join(self, other: DataFrame, condition: str, *expressions: str, how: str = "inner") -> DataFrame:
        """Join with a frame whose columns have other names, and select; only fields that the condition or the selection names are decoded."""
        if not expressions:
            raise errors.IllegalArgument("nothing selected")
        return self._frame([condition, *expressions]).join(other, F.expr(condition), how).selectExpr(*expressions)

    def query(self, program: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``program`` (joins, aggregates, windows: anything) over the filtered frame, decoding only the fields that it needs.

        The program first runs, as a plan, over a table without rows that has
        the frame's columns and the whole struct.  From the optimized plan's
        scan follows which fields are read; these are decoded for the program's
        real run.  It is called twice and should have no side effects.
        """
        schema = T.StructType([*(f for f in self.df.schema.fields if f.name != self.name), T.StructField(self.name, self.full_schema)])
        spark = self.df.sparkSession
        folder = f"{scratch_dir(spark)}/stand-in"
        spark.createDataFrame([], schema).write.parquet(folder)
        like = spark.read.schema(schema).parquet(folder)
        for c in self.conditions:
            like = like.filter(c)
        read = fields_read(program(like), folder, self.name)
        # a program that reads no field still has the struct, of one field
        paths = leaf_paths(read) if read is not None else leaf_paths(self.full_schema)[:1]
        out = decode(self.df, self.data, **self.how, name=self.name, fields=paths)
        for c in self.conditions:
            out = out.filter(c)
        return program(out)

    def decoded(self) -> DataFrame:
        """The frame with the whole struct."""
        return self.select(*[f"`{c}`" for c in self.df.columns if c != self.name], self.name)


def staged_decode(df: DataFrame, data: str, condition: str, fields: Iterable[str], *, name: str = "proto", **how) -> DataFrame:
    """Decode a filter's fields first, and the others only for rows that pass."""
    first = ProtoFrame(df, data, name="_stage", **how)
    rule = re.sub(rf"(?<![\w.`]){re.escape(name)}(?=\s*\.)", "_stage", condition)
    passed = first.filter(rule).select(*[f"`{c}`" for c in df.columns])
    return decode(passed, data, **how, name=name, fields=list(fields))


__all__ = ["ProtoFrame", "fields_read", "staged_decode"]
