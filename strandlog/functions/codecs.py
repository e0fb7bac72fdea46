"""Columns between JSON text and Avro or Protobuf bytes, and decoded records as rows. Rows go through Python in Arrow batches."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import avro, protobuf

#: Errors that bad bytes or values raise; a row with one is null and not valid.
BAD = (TypeError, ValueError, KeyError, IndexError, AttributeError, OverflowError, struct.error, decimal.InvalidOperation)


def avro_value(s, value):
    """A value of parsed JSON as avro.write() takes it: bytes are text of one code point a byte, decimals and dates are text or numbers."""
    if isinstance(s, list):
        if value is None:
            return None
        for branch in s:
            if branch == "null":
                continue
            try:
                own = avro_value(branch, value)
                avro.write(branch, own)
                return own
            except BAD:
                continue
        raise ValueError(f"no branch for {value!r}")
    name, logical = (s, None) if isinstance(s, str) else (s["type"], s.get("logicalType"))
    if name in ("bytes", "fixed"):
        if logical == "decimal":
            return decimal.Decimal(str(value))
        return value if logical == "duration" else value.encode("latin-1")
    if logical == "date" and isinstance(value, str):
        return dt.date.fromisoformat(value)
    if name == "string" and not isinstance(value, str) or name in ("float", "double") and (isinstance(value, bool) or not isinstance(value, int | float)):
        raise TypeError(f"{value!r} is no {name}")
    if name == "record":
        return {f["name"]: avro_value(f["type"], value[f["name"]]) for f in s["fields"]}
    if name == "array":
        return [avro_value(s["items"], x) for x in value]
    if name == "map":
        return {k: avro_value(s["values"], x) for k, x in value.items()}
    return value


def plain(s, value):
    """A decoded value of an Avro schema as JSON has it; a union is the value of its branch."""
    if value is None:
        return None
    if isinstance(s, list):
        rest = [x for x in s if x != "null"]
        if len(rest) == 1:
            return plain(rest[0], value)
        return next((plain(x, value[f"field{i + 1}"]) for i, x in enumerate(s) if value[f"field{i + 1}"] is not None), None)
    name = s if isinstance(s, str) else s["type"]
    if name == "record":
        return {f["name"]: plain(f["type"], value[f["name"]]) for f in s["fields"]}
    if name == "array":
        return [plain(s["items"], x) for x in value]
    if name == "map":
        return {k: plain(s["values"], x) for k, x in value.items()}
    if isinstance(value, bytes):
        return value.decode("latin-1")
    if isinstance(value, dt.datetime | dt.date | dt.time):
        return value.isoformat()
    return str(value) if isinstance(value, decimal.Decimal) else value


def _column(column: Column, kind: str, make: Callable[[], Callable]) -> Column:
    """A column by a function of each value; null where it raises one of BAD."""

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = make()
        for part in parts:
            out = []
            for x in part:
                try:
                    out.append(None if x is None else own(x))
                except BAD:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return run(column)


def json_to_avro(column: Column, schema: str) -> Column:
    parsed = avro.parse(schema)
    return _column(column, "binary", lambda: lambda x: avro.write(parsed, avro_value(parsed, json.loads(x))))


def avro_to_json(column: Column, schema: str) -> Column:
    parsed = avro.parse(schema)
    return _column(column, "string", lambda: lambda x: json.dumps(plain(parsed, avro.read(parsed, bytes(x))[0]), separators=(",", ":"), ensure_ascii=False))


def _protobuf(text: str, name: str, encode: bool) -> Callable[[], Callable]:
    def make() -> Callable:
        from google.protobuf import json_format
        from google.protobuf.message import DecodeError

        own = protobuf.message_class(text, name)  # once for each task

        def there(x):
            try:
                return json_format.ParseDict(json.loads(x), own()).SerializeToString(deterministic=True)
            except json_format.ParseError as e:
                raise ValueError from e

        def back(x):
            try:
                return json.dumps(json_format.MessageToDict(own.FromString(bytes(x)), preserving_proto_field_name=True), separators=(",", ":"), ensure_ascii=False)
            except DecodeError as e:
                raise ValueError from e

        return there if encode else back

    return make


def json_to_protobuf(column: Column, text: str, name: str) -> Column:
    return _column(column, "binary", _protobuf(text, name, True))


def protobuf_to_json(column: Column, text: str, name: str) -> Column:
    return _column(column, "string", _protobuf(text, name, False))


def _rows(log: DataFrame, parts: list[str], decoders: dict[str, Callable[[Column], Column]]) -> DataFrame:
    from strandlog.operators.lake import meta

    out = log
    for side, column in (("key", "k"), ("value", "v")):
        if side in decoders:
            out = out.withColumn(f"_{side}", decoders[side](F.col(column)))
    out = out.where(" and ".join(f"_{side}.valid" for side in decoders) or "true")
    columns = {side: F.col(f"_{side}.value").alias(side) for side in decoders} | {"meta": meta(F.col("partition"), F.col("ts")).alias("meta")}
    return out.select(*[columns[x] for x in parts if x in columns])


def avro_rows(log: DataFrame, key: str | None, value: str | None) -> DataFrame:
    """Records whose k and v are readable as rows of key, value and meta; a side without schema is left out."""
    decoders = {side: (lambda s: lambda c: avro.decode(c, s))(s) for side, s in (("key", key), ("value", value)) if s}
    return _rows(log, ["key", "value", "meta"], decoders)


def protobuf_rows(log: DataFrame, text: str, key: str | None, value: str | None) -> DataFrame:
    """Records as rows of meta, key and value, by the names of two messages."""
    decoders = {side: (lambda n: lambda c: protobuf.decode(c, text, n))(n) for side, n in (("key", key), ("value", value)) if n}
    return _rows(log, ["meta", "key", "value"], decoders)
