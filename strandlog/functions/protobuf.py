"""Protobuf messages described by .proto text: dynamic classes, a column function that decodes, and an encoder.

The text's syntax is read here for the subset: package, message (nested), enum, scalar, message and map fields, repeated, optional, oneof;
options are skipped. Well-known timestamps are supported. Enums are numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALARS = {"double": 1, "float": 2, "int64": 3, "uint64": 4, "int32": 5, "fixed64": 6, "fixed32": 7, "bool": 8, "string": 9, "bytes": 12, "uint32": 13, "sfixed32": 15, "sfixed64": 16, "sint32": 17, "sint64": 18}
TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\]|\\.)*\"|[\w.]+|[{}\[\]()<>=;,:-]", re.DOTALL)


def message_class(text: str, name: str):
    """The class of a message of the .proto text."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory, timestamp_pb2

    words = [t for t in TOKEN.findall(text) if not t.startswith(("//", "/*"))]
    file = descriptor_pb2.FileDescriptorProto(name=f"own_{abs(hash(text))}.proto", syntax="proto3")
    at = 0

    def skip_to(end: str) -> None:
        nonlocal at
        depth = 0
        while depth or words[at] != end:
            depth += words[at] in "{[(" if len(words[at]) == 1 else 0
            depth -= words[at] in "}])" if len(words[at]) == 1 else 0
            at += 1
        at += 1

    def enum(into) -> None:
        nonlocal at
        own = into.enum_type.add(name=words[at])
        at += 2
        while words[at] != "}":
            if words[at] in ("option", "reserved"):
                skip_to(";")
                continue
            sign = -1 if words[at + 2] == "-" else 1
            own.value.add(name=words[at], number=sign * int(words[at + 2 + (sign < 0)]))
            skip_to(";")
        at += 1

    def field(own, one: int | None) -> None:
        nonlocal at
        label = 1
        if words[at] in ("repeated", "optional", "required"):
            label = {"repeated": 3, "optional": 1, "required": 1}[words[at]]
            at += 1
        kind = words[at]
        at += 1
        if kind == "map" and words[at] == "<":
            key, value = words[at + 1], words[at + 3]
            at += 5
            entry = own.nested_type.add(name="".join(x.title() for x in words[at].split("_")) + "Entry")
            entry.options.map_entry = True
            for n, (x, t) in enumerate((("key", key), ("value", value)), 1):
                typed(entry.field.add(name=x, number=n, label=1), t)
            f = own.field.add(name=words[at], number=int(words[at + 2]), label=3, type=11, type_name=entry.name)
        else:
            f = own.field.add(name=words[at], number=int(words[at + 2]), label=label)
            typed(f, kind)
            if one is not None:
                f.oneof_index = one
        skip_to(";")

    def typed(f, kind: str) -> None:
        if kind in SCALARS:
            f.type = SCALARS[kind]
        else:
            f.type_name = "." + kind if kind.startswith("google.") else kind

    def message(into) -> None:
        nonlocal at
        own = into.add(name=words[at])
        at += 2
        while words[at] != "}":
            if words[at] == "message":
                at += 1
                message(own.nested_type)
            elif words[at] == "enum":
                at += 1
                enum(own)
            elif words[at] == "oneof":
                own.oneof_decl.add(name=words[at + 1])
                at += 3
                while words[at] != "}":
                    field(own, len(own.oneof_decl) - 1)
                at += 1
            elif words[at] in ("option", "reserved", "extensions"):
                skip_to(";")
            else:
                field(own, None)
        at += 1

    while at < len(words):
        word, at = words[at], at + 1
        if word == "package":
            file.package = words[at]
            skip_to(";")
        elif word == "message":
            message(file.message_type)
        elif word == "enum":
            enum(file)
        elif word == "extend":
            skip_to("{")
            while words[at] != "}":
                at += 1
            at += 1
        elif word != ";":
            skip_to(";")
    if "google.protobuf.Timestamp" in text:
        file.dependency.append("google/protobuf/timestamp.proto")
    pool = descriptor_pool.DescriptorPool()
    stamp = descriptor_pb2.FileDescriptorProto()
    timestamp_pb2.DESCRIPTOR.CopyToProto(stamp)
    pool.Add(stamp)
    pool.Add(file)
    prefix = file.package + "." if file.package else ""
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(prefix + name))


def spark_type(descriptor) -> T.StructType:
    def one(f) -> T.DataType:
        if f.message_type is not None and f.message_type.full_name == "google.protobuf.Timestamp":
            return T.TimestampNTZType()
        if f.message_type is not None:
            return spark_type(f.message_type)
        return {1: T.DoubleType(), 2: T.FloatType(), 3: T.LongType(), 4: T.LongType(), 5: T.IntegerType(), 8: T.BooleanType(), 9: T.StringType(), 12: T.BinaryType(), 13: T.LongType(), 14: T.IntegerType(), 16: T.LongType(), 6: T.LongType(), 7: T.LongType(), 15: T.IntegerType(), 17: T.IntegerType(), 18: T.LongType()}[f.type]

    out = T.StructType()
    for f in descriptor.fields:
        if f.message_type is not None and f.message_type.GetOptions().map_entry:
            k, v = f.message_type.fields
            out.add(f.name, T.MapType(one(k), one(v)))
        else:
            out.add(f.name, T.ArrayType(one(f)) if f.is_repeated else one(f))
    return out


def to_python(message) -> dict:
    def one(f, x):
        if f.message_type is None:
            return x
        return x.ToDatetime() if f.message_type.full_name == "google.protobuf.Timestamp" else to_python(x)

    out = {}
    for f in message.DESCRIPTOR.fields:
        own = getattr(message, f.name)
        if f.message_type is not None and f.message_type.GetOptions().map_entry:
            value = f.message_type.fields_by_name["value"]
            out[f.name] = {k: one(value, own[k]) for k in own}
        elif f.is_repeated:
            out[f.name] = [one(f, x) for x in own]
        else:
            out[f.name] = one(f, own) if f.message_type is None or message.HasField(f.name) else None
    return out


def encode(text: str, name: str, value: dict) -> bytes:
    from google.protobuf import json_format

    return json_format.ParseDict(value, message_class(text, name)()).SerializeToString(deterministic=True)


def to_json(text: str, name: str, data: bytes) -> str:
    from google.protobuf import json_format

    return json_format.MessageToJson(message_class(text, name).FromString(data), preserving_proto_field_name=True, indent=None)


def decode(column: Column, text: str, name: str) -> Column:
    """struct(value, valid) of a binary column."""
    kind = T.StructType([T.StructField("value", spark_type(message_class(text, name).DESCRIPTOR)), T.StructField("valid", T.BooleanType())])

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from google.protobuf.message import DecodeError

        own = message_class(text, name)
        for part in parts:
            values, fine = [], []
            for x in part:
                try:
                    values.append(to_python(own.FromString(bytes(x))))
                    fine.append(True)
                except (TypeError, DecodeError):
                    values.append(None)
                    fine.append(False)
            yield pd.DataFrame({"value": pd.Series(values, dtype=object), "valid": fine})

    return run(column)
