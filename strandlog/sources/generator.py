"""Made-up records from a schema: a Protobuf message or a JSON Schema, with options for single fields.

An option names a field by its dotted path: skip (True: null, an empty list or map where the schema has no null), make (the name of one of MAKERS, or a SQL expression over the
row's number `id`), repeated ({"len": n} or {"range": [least, most]} and, beside it, make for the items). Without options numbers are random, texts are "abc",
enumerations their number 1, messages made field by field, and repeated fields have none or one item. A row depends on its number and the seed
only, so reruns and other partitionings give the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.functions import protobuf

from .records import CITIES, COUNTRIES, FIRST, INDUSTRIES, LAST, STREETS, number, pick

#: Names that `make` may have: a column from the row's number and a seed.
MAKERS: dict[str, Callable[[Column, int], Column]] = {
    "first_name": lambda row, seed: pick(FIRST, row, seed),
    "last_name": lambda row, seed: pick(LAST, row, seed),
    "safe_email": lambda row, seed: F.lower(F.concat(pick(FIRST, row, seed), F.lit("."), pick(LAST, row, seed + 1), row.cast("string"), F.lit("@example.com"))),
    "building_number": lambda row, seed: F.floor(number(row, seed, 1, 200)).cast("string"),
    "street_name": lambda row, seed: pick(STREETS, row, seed),
    "city_name": lambda row, seed: pick(CITIES, row, seed),
    "post_code": lambda row, seed: F.format_string("%05d", F.floor(number(row, seed, 0, 99_999))),
    "country_name": lambda row, seed: pick(COUNTRIES, row, seed),
    "industry": lambda row, seed: pick(INDUSTRIES, row, seed),
    "rand_bool": lambda row, seed: number(row, seed, 0, 1) < 0.5,
    "rand_float": lambda row, seed: number(row, seed, 0, 1),
    "rand": lambda row, seed: F.floor(number(row, seed, 0, 1_000_000)),
}


def _seed(path: str, seed: int, at: int = 0) -> int:
    return (zlib.crc32(path.encode()) + 7919 * seed + 104_729 * at) % (1 << 31)


def _made(how: str, row: Column, path: str, seed: int, at: int) -> Column:
    return MAKERS[how](row, _seed(path, seed, at)) if how in MAKERS else F.expr(how)


def _field(kind: T.DataType, path: str, options: Mapping[str, dict], seed: int, row: Column, enums: frozenset[str], at: int = 0, item: bool = False) -> Column:
    own = options.get(path, {})
    if own.get("skip"):
        empty = isinstance(kind, T.ArrayType | T.MapType)
        return (F.array() if isinstance(kind, T.ArrayType) else F.create_map() if empty else F.lit(None)).cast(kind)
    if isinstance(kind, T.ArrayType) and not item:
        repeated = own.get("repeated", {"range": [0, 1]})
        least, most = (repeated["len"],) * 2 if "len" in repeated else repeated["range"]
        items = F.array(*[_field(kind.elementType, path, options, seed, row, enums, at=k + 1, item=True) for k in range(most)]).cast(kind)
        return items if least == most else F.slice(items, 1, (F.floor(number(row, _seed(path, seed, -1), least, most + 1))).cast("int"))
    if "make" in own:
        return _made(own["make"], row, path, seed, at).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[_field(f.dataType, f"{path}.{f.name}", options, seed, row, enums, at).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    if path in enums:
        return F.lit(1).cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit("abc")
    if isinstance(kind, T.BinaryType):
        return F.lit(b"abc")
    if isinstance(kind, T.BooleanType):
        return MAKERS["rand_bool"](row, _seed(path, seed, at))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.timestamp_micros((number(row, _seed(path, seed, at), 0, 1) * 1_700_000_000_000_000).cast("long")).cast(kind)
    return (MAKERS["rand_float"] if isinstance(kind, T.FractionalType) else MAKERS["rand"])(row, _seed(path, seed, at)).cast(kind)


def records(spark: SparkSession, n: int, kind: T.StructType, options: Mapping[str, dict] | None = None, seed: int = 0, enums: frozenset[str] = frozenset()) -> DataFrame:
    """n rows of a struct type."""
    row = F.col("id")
    return spark.range(n).select(*[_field(f.dataType, f.name, options or {}, seed, row, enums).alias(f.name) for f in kind.fields])


def _enums(descriptor, path: str = "") -> frozenset[str]:
    out = {f"{path}{f.name}" for f in descriptor.fields if f.enum_type is not None}
    for f in descriptor.fields:
        if f.message_type is not None and not f.message_type.GetOptions().map_entry and f.message_type.full_name != "google.protobuf.Timestamp":
            out |= _enums(f.message_type, f"{path}{f.name}.")
    return frozenset(out)


def from_message(spark: SparkSession, n: int, text: str, name: str, options: Mapping[str, dict] | None = None, seed: int = 0) -> DataFrame:
    """n rows of a Protobuf message, by its .proto text."""
    descriptor = protobuf.message_class(text, name).DESCRIPTOR
    return records(spark, n, protobuf.spark_type(descriptor), options, seed, _enums(descriptor))


#: The type of each JSON type.
JSON_TYPES = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "null": T.StringType()}


def json_type(schema: dict) -> T.DataType:
    kind = schema.get("type", "string")
    kind = next((k for k in kind if k != "null"), "null") if isinstance(kind, list) else kind
    if kind == "object":
        return T.StructType([T.StructField(k, json_type(x)) for k, x in schema.get("properties", {}).items()])
    return T.ArrayType(json_type(schema.get("items", {}))) if kind == "array" else JSON_TYPES[kind]


def from_json_schema(spark: SparkSession, n: int, schema: dict, options: Mapping[str, dict] | None = None, seed: int = 0) -> DataFrame:
    """n rows of an object's JSON Schema; bounds, enumerations and fixed values of fields are kept to."""
    own = {path: {"make": how} for path, how in _bounds(schema)}
    return records(spark, n, json_type(schema), own | dict(options or {}), seed)


def _bounds(schema: dict, path: str = "") -> list[tuple[str, str]]:
    out = []
    for name, s in schema.get("properties", {}).items():
        at = f"{path}{name}"
        some = s.get("enum", [s["const"]] if "const" in s else None)
        if some:
            texts = ", ".join("'" + str(x).replace("'", "''") + "'" for x in some)
            out.append((at, f"element_at(array({texts}), cast(pmod(xxhash64(id, {_seed(at, 0)}), {len(some)}) + 1 as int))"))
        elif "minimum" in s or "maximum" in s or "multipleOf" in s:
            step = s.get("multipleOf", 1 if s.get("type") == "integer" else 0.01)
            least = s.get("minimum", s.get("maximum", 0) - 1000 * step)
            most = s.get("maximum", least + 1000 * step)
            first, last = -(-least // step), most // step
            out.append((at, f"({first} + floor(pmod(xxhash64(id, {_seed(at, 0)}), 1000003) / 1000003D * ({last - first} + 1))) * {step}"))
        elif s.get("type") == "object":
            out += _bounds(s, f"{at}.")
    return out
