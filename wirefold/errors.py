"""Errors of wirefold; the texts are part of the interface."""

from __future__ import annotations


class ProtobufError(Exception):
    """Base of all errors that this package raises on purpose."""


class AnalysisError(ProtobufError):
    """A descriptor, schema or argument does not fit."""


class MalformedMessage(ProtobufError, RuntimeError):
    """Bytes are no message of the given type."""


class IllegalArgument(ProtobufError, ValueError):
    """An option has a value that is not allowed."""


# The error texts.
def cannot_convert_proto_to_catalyst(name, kind):
    return AnalysisError(f"Cannot convert Protobuf type '{name}' to Catalyst type {kind}")


def null_array_element(path):
    return AnalysisError(f"Null element encountered in non‑nullable array at {path}")


def cannot_convert_sql_to_message(kind, name):
    return AnalysisError(f"Cannot convert SQL type '{kind}' to Protobuf message '{name}'")


def not_an_enum_symbol(value, path, symbols, field):
    return AnalysisError(f"Value '{value}' at {path} is not one of the allowed enum symbols {symbols} for field {field}")


def cannot_convert_catalyst_to_proto(kind, path, field, detail):
    return AnalysisError(f"Cannot convert Catalyst type '{kind}' at {path} to Protobuf field {field}: {detail}")


def no_proto_field(field):
    return AnalysisError(f"Cannot find Catalyst field {field} in Protobuf schema")


def no_catalyst_field(field):
    return AnalysisError(f"Cannot find Protobuf field {field} in Catalyst schema")


def several_fields(name, context, count, matches):
    return AnalysisError(f"Multiple matching fields for '{name}' in {context} (found {count} matches: {matches})")


def class_load(name, why):
    return AnalysisError(f"Error loading Protobuf class '{name}': {why}")


def no_message(name):
    return AnalysisError(f"Unable to locate Protobuf message '{name}' in descriptor file")


def descriptor_parse(file):
    return AnalysisError(f"Failed to parse Protobuf descriptor file: {file}")


def descriptor_read(file):
    return AnalysisError(f"Could not read Protobuf descriptor file: {file}")


def descriptor_failed(file):
    return AnalysisError(f"Failed parsing Protobuf descriptor file: {file}")


def missing_dependency(name):
    return AnalysisError(f"Missing dependency '{name}' while resolving Protobuf descriptor dependencies")


def parse_mode(mode, function):
    return AnalysisError(f"Unsupported parse mode '{mode}' for function {function}")


def type_mismatch(detail):
    return AnalysisError(f"Field type mismatch while reading Protobuf message: {detail}")


def found_recursion(field):
    return AnalysisError(f"Found recursion in Protobuf schema while processing {field}")


def unsupported_type(name):
    return AnalysisError(f"Protobuf type '{name}' is not supported yet")


def malformed():
    return MalformedMessage("Malformed Protobuf message detected during parsing")


def bad_depth(depth):
    return IllegalArgument(
        f"Invalid value for 'recursive.fields.max.depth': {depth}. Supported values are -1 (default), 0 (no recursions), "
        "or 1-10 (specific depth limit). Values > 10 can cause stack overflows."
    )


def bad_combination(depth):
    return IllegalArgument(
        f"Invalid configuration: 'recursive.fields.mode=recursive' cannot be used with 'recursive.fields.max.depth={depth}'. "
        "RecursiveStructType requires depth=-1 (default) with explicit mode=recursive."
    )


def bad_mode(mode):
    return IllegalArgument(f"Invalid value for 'recursive.fields.mode': '{mode}'. Supported values are: '' (empty), 'drop', 'binary', 'fail', 'recursive'")


def recursive_field(field, kind):
    return IllegalArgument(f"Recursive field detected: {field} of type {kind}. Recursive schemas are not supported in fail mode.")


def too_few_arguments(name):
    return AnalysisError(f"Function {name} requires at least 2 arguments")


def not_a_literal(what, other):
    return AnalysisError(f"Expected a literal string for {what} but found: {other}")


def unknown_path(path):
    return AnalysisError(f"No field at path '{path}' in the message's schema")


def batch_too_large(size):
    return OverflowError(f"an Arrow batch of messages has {size} bytes or elements, over 2^31; lower spark.sql.execution.arrow.maxRecordsPerBatch or set spark.sql.execution.arrow.maxBytesPerBatch")
