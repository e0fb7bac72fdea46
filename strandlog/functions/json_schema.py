"""Validation by JSON Schema as Catalyst predicates, and typed decoding that refuses mixed types.

Keywords: type, properties, required, additionalProperties, propertyNames (pattern, lengths), minProperties, maxProperties, pattern, minLength, maxLength, format, minimum,
maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, items, minItems, maxItems, uniqueItems, contains, enum, const, allOf, anyOf, oneOf, not, and
$ref to #/$defs or #/definitions, but not to what it is part of. A whole number of any spelling is an integer. Numbers are compared as doubles; values
of enum and const that are objects or lists, and the items of a unique list, are compared by their canonical text.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOWN = frozenset(
    "type properties required additionalProperties propertyNames minProperties maxProperties pattern minLength maxLength format minimum maximum exclusiveMinimum exclusiveMaximum multipleOf "
    "items minItems maxItems uniqueItems contains enum const allOf anyOf oneOf not $ref $defs definitions title description $schema $id $comment default examples".split()
)
#: The name that schema_of_variant gives each JSON type.
VARIANT = {"string": ("STRING",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "null": ("VOID",), "object": ("OBJECT",), "array": ("ARRAY",)}
#: Formats that are asserted; others are notes.
FORMATS = {
    "date": r"\A\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])\z",
    "time": r"\A([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([zZ]|[+-]([01]\d|2[0-3]):[0-5]\d)\z",
    "date-time": r"\A\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[tT ]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([zZ]|[+-]([01]\d|2[0-3]):[0-5]\d)\z",
    "email": r"\A[^@\s]+@[^@\s]+\z",
    "uuid": r"\A[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\z",
    "ipv4": r"\A((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(?!\z)|\z)){4}",
    "uri": r"\A[a-zA-Z][a-zA-Z0-9+.-]*:\S*\z",
}
_DEEP = 32


def valid(value: Column, schema: dict | str | bool) -> Column:
    """Whether JSON text (null: missing) is valid; text that isn't JSON is not."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    v = F.try_parse_json(value)
    return F.coalesce(v.isNotNull() & _rule(v, schema, schema, 0), F.lit(False))


def _all(rules: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, rules, F.lit(True))


def _referred(root: dict, path: str) -> dict:
    at = root
    if not path.startswith("#/"):
        raise ValueError(f"keywords not supported: $ref to {path}")
    for part in path[2:].split("/"):
        at = at[part.replace("~1", "/").replace("~0", "~")]
    return at


def _equal(own: Column, kind: Column, x) -> Column:
    """Whether a value is the given one."""
    if isinstance(x, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(own, "$", "boolean") == x)
    if isinstance(x, int | float):
        return _is(kind, "number") & (F.try_variant_get(own, "$", "double") == float(x))
    if isinstance(x, str):
        return (kind == "STRING") & (F.try_variant_get(own, "$", "string") == x)
    if x is None:
        return _is(kind, "null")
    return F.to_json(own) == json.dumps(x, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def _is(kind: Column, name: str) -> Column:
    return reduce(lambda a, b: a | b, [kind.startswith(n) for n in VARIANT[name]])


def _rule(own: Column, schema: dict | bool, root: dict, depth: int) -> Column:
    if isinstance(schema, bool):
        return F.lit(schema)
    unknown = set(schema) - KNOWN
    if unknown:
        raise ValueError(f"keywords not supported: {', '.join(sorted(unknown))}")
    if depth > _DEEP:
        raise ValueError("keywords not supported: $ref to a schema around it")

    def rule(value: Column, inner: dict | bool) -> Column:
        return F.coalesce(_rule(value, inner, root, depth + 1), F.lit(False))

    if "$ref" in schema:
        return rule(own, _referred(root, schema["$ref"]))
    kind = F.schema_of_variant(own)
    text, number = F.try_variant_get(own, "$", "string"), F.try_variant_get(own, "$", "double")
    is_text, is_number, is_object, is_list = (_is(kind, x) for x in ("string", "number", "object", "array"))
    rules: list[Column] = []
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        rules.append(reduce(lambda a, b: a | b, [is_number & (number == F.floor(number)) if t == "integer" else _is(kind, t) for t in kinds]))
    for key, test, of in (
        ("pattern", is_text, lambda x: text.rlike(x)),
        ("minLength", is_text, lambda x: F.length(text) >= x),
        ("maxLength", is_text, lambda x: F.length(text) <= x),
        ("minimum", is_number, lambda x: number >= x),
        ("maximum", is_number, lambda x: number <= x),
        ("exclusiveMinimum", is_number, lambda x: number > x),
        ("exclusiveMaximum", is_number, lambda x: number < x),
        ("multipleOf", is_number, lambda x: F.abs(number / x - F.round(number / x)) < 1e-9),
    ):
        if key in schema:
            rules.append(~test | F.coalesce(of(schema[key]), F.lit(False)))
    if schema.get("format") in FORMATS:
        rules.append(~is_text | text.rlike(FORMATS[schema["format"]]))
    if "enum" in schema or "const" in schema:
        rules.append(reduce(lambda a, b: a | b, [F.coalesce(_equal(own, kind, x), F.lit(False)) for x in (schema["enum"] if "enum" in schema else [schema["const"]])], F.lit(False)))
    for name in schema.get("required", []):
        rules.append(~is_object | F.try_variant_get(own, _step(name), "variant").isNotNull())
    for name, inner in schema.get("properties", {}).items():
        there = F.try_variant_get(own, _step(name), "variant")
        rules.append(~is_object | there.isNull() | rule(there, inner))
    if set(schema) & {"additionalProperties", "propertyNames", "minProperties", "maxProperties"}:
        fields = F.try_variant_get(own, "$", "map<string, variant>")
        names = F.map_keys(fields)
        if "additionalProperties" in schema:
            listed = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
            rest = F.filter(F.map_entries(fields), lambda e: ~F.array_contains(listed, e["key"]))
            rules.append(~is_object | F.forall(rest, lambda e: rule(e["value"], schema["additionalProperties"])))
        for key, of in (("minProperties", lambda x: F.size(names) >= x), ("maxProperties", lambda x: F.size(names) <= x), ("propertyNames", lambda x: F.forall(names, lambda n: rule(F.parse_json(F.to_json(F.array(n))), {"items": x})))):
            if key in schema:
                rules.append(~is_object | of(schema[key]))
    if set(schema) & {"items", "minItems", "maxItems", "uniqueItems", "contains"}:
        items = F.try_variant_get(own, "$", "array<variant>")
        for key, of in (("minItems", lambda x: F.size(items) >= x), ("maxItems", lambda x: F.size(items) <= x), ("items", lambda x: F.forall(items, lambda i: rule(i, x))), ("contains", lambda x: F.exists(items, lambda i: rule(i, x))), ("uniqueItems", lambda x: F.size(F.array_distinct(F.transform(items, lambda i: F.to_json(i)))) == F.size(items) if x else F.lit(True))):
            if key in schema:
                rules.append(~is_list | F.coalesce(of(schema[key]), F.lit(False)))
    if "allOf" in schema:
        rules.append(_all([rule(own, x) for x in schema["allOf"]]))
    if "anyOf" in schema:
        rules.append(reduce(lambda a, b: a | b, [rule(own, x) for x in schema["anyOf"]], F.lit(False)))
    if "oneOf" in schema:
        rules.append(reduce(lambda a, b: a + b, [rule(own, x).cast("int") for x in schema["oneOf"]], F.lit(0)) == 1)
    if "not" in schema:
        rules.append(~rule(own, schema["not"]))
    return _all(rules)


def _step(name: str) -> str:
    if "'" in name or "\\" in name:
        raise ValueError(f"property name {name!r}")
    return f"$['{name}']"


def record_valid(key: Column, value: Column, key_schema: dict | None, value_schema: dict | None) -> Column:
    """A record is valid if each part that has a schema is there and valid."""
    return (valid(key, key_schema) if key_schema else F.lit(True)) & (valid(value, value_schema) if value_schema else F.lit(True))


class NoCommonType(ValueError):
    """Values of a batch have types without a common one."""


def common_type(rows: DataFrame, value: str) -> str:
    """The DDL type of all values of a JSON column, fields of objects in order of name and together; NoCommonType where types differ. Numbers with a point are doubles, as are whole ones beside them."""
    kind = rows.where(F.col(value).isNotNull()).agg(F.schema_of_variant_agg(F.parse_json(value))).first()[0]
    if kind is None or kind == "VOID":
        return "STRING"
    if re.search(r"\bVARIANT\b", kind):
        raise NoCommonType(kind)
    return re.sub(r"\bDECIMAL\(\d+, ?\d+\)", "DOUBLE", re.sub(r"\bVOID\b", "STRING", kind.replace("OBJECT<", "STRUCT<")))


def decoded(rows: DataFrame, value: str) -> DataFrame:
    """rows with the JSON column as typed values: structs with fields by name, lists, or plain values."""
    kind = common_type(rows, value)
    whole = kind.startswith(("STRUCT<", "ARRAY<"))
    return rows.withColumn(value, F.from_json(value, kind) if whole else F.try_variant_get(F.parse_json(value), "$", kind))


