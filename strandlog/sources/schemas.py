"""Schemas by topic: files topic.json, topic.avsc and topic.proto of a folder that Spark reads, or texts in memory."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions import avro, codecs, json_schema, protobuf
from strandlog.operators.lake import json_meta

KINDS = {"json": "json", "avsc": "avro", "proto": "protobuf"}


@dataclass
class Schema:
    """kind: json, avro or protobuf. A JSON or Avro schema describes a record's key and value as the properties (fields) of these names, Protobuf as messages Key and Value."""

    kind: str
    text: str

    def part(self, side: str) -> str | dict | None:
        """The schema of `key` or `value`, None where there is none."""
        if self.kind == "protobuf":
            return side.title() if f"message {side.title()}" in self.text else None
        said = json.loads(self.text)
        if self.kind == "json":
            return said.get("properties", {}).get(side)
        own = next((f["type"] for f in said.get("fields", []) if f["name"] == side), None)
        return None if own is None else json.dumps(own)

    def valid(self, key: Column, value: Column) -> Column:
        """Whether a record fits: bytes (text for JSON) must be there and readable where a side has a schema."""
        out = F.lit(True)
        for side, column in (("key", key), ("value", value)):
            own = self.part(side)
            if own is not None:
                out = out & (json_schema.valid(column, own) if self.kind == "json" else avro.decode(column, own)["valid"] if self.kind == "avro" else protobuf.decode(column, self.text, own)["valid"])
        return out

    def encoded(self, column: Column, side: str) -> Column:
        """JSON text as a record's bytes; null where it doesn't fit. A side without schema is the text itself."""
        own = self.part(side)
        if own is None or self.kind == "json":
            return column.cast("binary")
        return codecs.json_to_avro(column, own) if self.kind == "avro" else codecs.json_to_protobuf(column, self.text, own)

    def json(self, column: Column, side: str) -> Column:
        """A record's bytes as JSON text."""
        own = self.part(side)
        if own is None or self.kind == "json":
            return column.cast("string")
        return codecs.avro_to_json(column, own) if self.kind == "avro" else codecs.protobuf_to_json(column, self.text, own)

    def rows(self, log: DataFrame) -> DataFrame:
        """The readable records of a log as typed rows: key, value and meta of Avro, meta, key and value of Protobuf and JSON, whose objects have their fields in order of name."""
        if self.kind == "avro":
            return codecs.avro_rows(log, self.part("key"), self.part("value"))
        if self.kind == "protobuf":
            return codecs.protobuf_rows(log, self.text, self.part("key"), self.part("value"))
        out = log.where(self.valid(F.col("k").cast("string"), F.col("v").cast("string"))).withColumns({"k": F.col("k").cast("string"), "v": F.col("v").cast("string")})
        for side, column in (("key", "k"), ("value", "v")):
            if self.part(side) is not None:
                out = json_schema.decoded(out, column)
        return out.select(json_meta(F.col("partition"), F.col("ts")).alias("meta"), *[F.col(c).alias(side) for side, c in (("key", "k"), ("value", "v")) if self.part(side) is not None])


class Registry:
    """Schemas of a folder (any path that Spark reads) or of a mapping of file names to texts. A text that can't be parsed is an error."""

    def __init__(self, spark: SparkSession, source: str | Mapping[str, str]):
        if isinstance(source, str):
            files = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.{json,avsc,proto}").text(source).select(F.input_file_name().alias("name"), "value")
            source = {r.name.rsplit("/", 1)[-1]: r.value for r in files.collect()}  # a text for each topic of the catalog
        self.schemas: dict[str, Schema] = {}
        for name, text in source.items():
            topic, _, ending = name.rpartition(".")
            if topic and ending in KINDS:
                self.schemas[topic] = self._checked(Schema(KINDS[ending], text))

    @staticmethod
    def _checked(schema: Schema) -> Schema:
        for side in ("key", "value"):
            own = schema.part(side)
            if own is not None and schema.kind == "avro":
                avro.parse(own)
            elif own is not None and schema.kind == "protobuf":
                protobuf.message_class(schema.text, own)
            elif own is not None:
                json_schema.valid(F.lit(None).cast("string"), own)
        return schema

    def __getitem__(self, topic: str) -> Schema:
        return self.schemas[topic]

    def get(self, topic: str) -> Schema | None:
        return self.schemas.get(topic)

    def __iter__(self):
        return iter(self.schemas)
