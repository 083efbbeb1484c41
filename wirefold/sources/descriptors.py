"""Where message descriptors come from: descriptor-set bytes, a descriptor file, a Python message class.

Everything is read on the driver and travels as bytes of a FileDescriptorSet,
so executors need no file.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

from google.protobuf import descriptor_pb2, descriptor_pool, message_factory
from google.protobuf.descriptor import Descriptor, FileDescriptor
from google.protobuf.message import DecodeError

from wirefold import errors


@dataclass(frozen=True)
class Source:
    """A message type: the descriptor set that holds it, its full name, and the kind of source."""

    files: bytes
    name: str
    kind: str  # binary, file or class

    @property
    def descriptor(self) -> Descriptor:
        return descriptor_of(self.files, self.name)


def parse_set(raw: bytes, what: str = "<binary descriptor set>") -> descriptor_pb2.FileDescriptorSet:
    try:
        return descriptor_pb2.FileDescriptorSet.FromString(raw)
    except DecodeError as e:
        raise errors.descriptor_parse(what) from e


def build_pool(files: descriptor_pb2.FileDescriptorSet, what: str = "<binary descriptor set>") -> descriptor_pool.DescriptorPool:
    """A pool of all files, dependencies first."""
    pool = descriptor_pool.DescriptorPool()
    by_name = {f.name: f for f in files.file}
    done: set[str] = set()

    def add(name: str) -> None:
        if name in done:
            return
        if name not in by_name:
            raise errors.missing_dependency(name)
        done.add(name)
        for d in by_name[name].dependency:
            add(d)
        try:
            pool.Add(by_name[name])
            pool.FindFileByName(name)
        except (TypeError, KeyError) as e:
            raise errors.descriptor_failed(what) from e

    for f in files.file:
        add(f.name)
    return pool


def find_message(files: descriptor_pb2.FileDescriptorSet, name: str) -> str:
    """Full name of the first top-level message with this short or full name."""
    for f in files.file:
        for m in f.message_type:
            full = f"{f.package}.{m.name}" if f.package else m.name
            if name in (m.name, full):
                return full
    raise errors.no_message(name)


def from_bytes(raw: bytes, name: str, kind: str = "binary", what: str = "<binary descriptor set>") -> Source:
    files = parse_set(bytes(raw), what)
    full = find_message(files, name)
    build_pool(files, what)  # reports missing dependencies here, not on an executor
    return Source(bytes(raw), full, kind)


def from_file(path: str, name: str) -> Source:
    try:
        with open(path, "rb") as f:
            raw = f.read()
    except OSError as e:
        raise errors.descriptor_read(path) from e
    return from_bytes(raw, name, "file", path)


def files_of(descriptor: Descriptor) -> descriptor_pb2.FileDescriptorSet:
    """The descriptor set of a message's file and all that it needs."""
    out = descriptor_pb2.FileDescriptorSet()
    done: set[str] = set()

    def add(file: FileDescriptor) -> None:
        if file.name in done:
            return
        done.add(file.name)
        for d in file.dependencies:
            add(d)
        file.CopyToProto(out.file.add())

    add(descriptor.file)
    return out


def from_class(cls) -> Source:
    """From a generated Python message class, or the dotted path of one."""
    if isinstance(cls, str):
        module, _, name = cls.rpartition(".")
        if not module:
            raise errors.class_load(cls, "not a dotted path of a message class; without a descriptor the name must be one")
        try:
            found = getattr(importlib.import_module(module), name)
        except ImportError as e:
            raise errors.class_load(cls, f"module {module} cannot be imported") from e
        except AttributeError as e:
            raise errors.class_load(cls, f"module {module} has no {name}") from e
        cls = found
    descriptor = getattr(cls, "DESCRIPTOR", None)
    if not isinstance(descriptor, Descriptor):
        raise errors.class_load(str(cls), "it is no Protobuf message class")
    return Source(files_of(descriptor).SerializeToString(), descriptor.full_name, "class")


def resolve(message, file: str | bytes | None = None, binary: bytes | None = None) -> Source:
    """Binary descriptor set before file before class; bytes in the place of a file are a descriptor set."""
    if binary is None and isinstance(file, bytes | bytearray):
        file, binary = None, bytes(file)
    if binary is not None:
        return from_bytes(binary, message)
    if file is not None:
        return from_file(file, message)
    return from_class(message)


@lru_cache(64)
def _pool(files: bytes) -> descriptor_pool.DescriptorPool:
    return build_pool(parse_set(files))


def descriptor_of(files: bytes, name: str) -> Descriptor:
    return _pool(files).FindMessageTypeByName(name)


def message_class(files: bytes, name: str):
    return message_factory.GetMessageClass(descriptor_of(files, name))


def define(package: str, messages: dict[str, Iterable], enums: dict[str, dict[str, int]] | None = None, syntax: str = "proto3", file: str | None = None, needs: Iterable[descriptor_pb2.FileDescriptorProto] = ()) -> bytes:
    """A descriptor set from plain field lists, for programs without protoc.

    A field is (name, number, type) with type a scalar's name, "repeated T",
    "packed T" or "unpacked T" for the repeated forms with that option set,
    "optional T", "required T" or "map K V"; T may be a message or enum by
    name.  A field's fourth entry names the oneof that it belongs to; in proto2
    a dict as fourth entry may hold "default".
    """
    F = descriptor_pb2.FieldDescriptorProto
    scalars = {n[5:].lower(): v for n, v in F.Type.items()}
    f = descriptor_pb2.FileDescriptorProto(name=file or f"{package.replace('.', '/')}.proto", package=package)
    if syntax != "proto2":
        f.syntax = syntax
    for need in needs:
        f.dependency.append(need.name)
    for name, symbols in (enums or {}).items():
        e = f.enum_type.add(name=name)
        for symbol, number in symbols.items():
            e.value.add(name=symbol, number=number)

    def put(field, kind: str) -> None:
        if kind in scalars and kind not in ("message", "enum", "group"):
            field.type = scalars[kind]
        else:
            full = kind if kind.startswith(".") else f".{package}.{kind}"
            field.type = F.TYPE_ENUM if kind.lstrip(".").rpartition(".")[2] in (enums or {}) else F.TYPE_MESSAGE
            field.type_name = full

    for name, fields in messages.items():
        *outer, own = name.split(".")
        at = f
        for o in outer:
            held = at.message_type if at is f else at.nested_type
            at = next(m for m in held if m.name == o)
        m = (at.message_type if at is f else at.nested_type).add(name=own)
        synthetic = []
        for spec in fields:
            fname, number, kind, *rest = spec
            field = m.field.add(name=fname, number=number, label=F.LABEL_OPTIONAL)
            word, _, of = kind.partition(" ")
            if word in ("repeated", "packed", "unpacked"):
                field.label = F.LABEL_REPEATED
                put(field, of)
                if word != "repeated":
                    field.options.packed = word == "packed"
            elif word == "map":
                k, _, v = of.partition(" ")
                entry = m.nested_type.add(name="".join(p.capitalize() for p in fname.split("_")) + "Entry")
                entry.options.map_entry = True
                put(entry.field.add(name="key", number=1, label=F.LABEL_OPTIONAL), k)
                put(entry.field.add(name="value", number=2, label=F.LABEL_OPTIONAL), v)
                field.label, field.type, field.type_name = F.LABEL_REPEATED, F.TYPE_MESSAGE, f".{package}.{name}.{entry.name}"
            elif word == "required":
                field.label = F.LABEL_REQUIRED
                put(field, of)
            elif word == "optional":
                put(field, of)
                if syntax == "proto3":
                    field.proto3_optional = True
                    synthetic.append(field)
            else:
                put(field, kind)
            if rest and isinstance(rest[0], str):
                names = [o.name for o in m.oneof_decl]
                if rest[0] not in names:
                    m.oneof_decl.add(name=rest[0])
                    names.append(rest[0])
                field.oneof_index = names.index(rest[0])
            elif rest and "default" in rest[0]:
                field.default_value = rest[0]["default"]
        for field in synthetic:
            field.oneof_index = len(m.oneof_decl)
            m.oneof_decl.add(name=f"_{field.name}")
    out = descriptor_pb2.FileDescriptorSet()
    for need in needs:
        out.file.add().CopyFrom(need)
    out.file.add().CopyFrom(f)
    return out.SerializeToString()
