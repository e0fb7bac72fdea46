"""Appending batches of records: sequence check, validation, offsets, and what goes to the log and to the lake.

A batch is what one request brings for one topition. Its verdict is that of its producer's sequence; then INVALID_RECORD, if any record of it fails the
topic's schema. A batch that is not accepted leaves no record and moves neither sequence nor offsets.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions import json_schema
from strandlog.sources.store import written

from .log import TOPITION
from .transactions import CONTROL, sequence_check

#: A topic's options and what they are where a topic says nothing.
OPTIONS = {"schema.validation": "true", "lake.sink": "false", "lake.normalize": "false", "lake.normalize.separator": ".", "lake.partition": "", "lake.z_order": "", "virtual": "false", "batch": "false", "batch.timeout_ms": "10000", "batch.max_records": "1000", "message.timestamp.type": "CreateTime"}


def options(config: DataFrame, topics: DataFrame) -> DataFrame:
    """config (topic, name, value) -> topics with a column for each option; dots in names become underscores."""
    own = config.groupBy("topic").agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name.replace(".", "_")) for name in OPTIONS])
    rows = topics.select("topic").distinct().join(own, "topic", "left")
    return rows.select("topic", *[F.coalesce(name.replace(".", "_"), F.lit(value)).alias(name.replace(".", "_")) for name, value in OPTIONS.items()])


def generated(config: DataFrame) -> DataFrame:
    """topic, column and SQL expression of each lake.generate.<column> option."""
    return config.where(F.col("name").startswith("lake.generate.")).select("topic", F.expr("substr(name, 15)").alias("column"), F.col("value").alias("expression"))


def batching(own: DataFrame) -> DataFrame:
    """options of a request's topics -> the least waiting time and number of records of those that ask for batches; no row if none does."""
    rows = own.where("batch = 'true'").agg(F.min(F.col("batch_timeout_ms").cast("long")).alias("timeout_ms"), F.min(F.col("batch_max_records").cast("long")).alias("max_records"))
    return rows.where("timeout_ms is not null")


@dataclass
class Produced:
    """verdicts: batch and verdict; log: appended records; lake: records for lake tables; marks: watermarks afterwards."""

    verdicts: DataFrame
    log: DataFrame
    lake: DataFrame
    marks: DataFrame


def _valid(schemas: Mapping[str, tuple[dict | None, dict | None]]) -> Column:
    out = F.lit(True)
    for topic, (key, value) in schemas.items():
        out = F.when(F.col("topic") == topic, json_schema.record_valid(F.col("k"), F.col("v"), key, value)).otherwise(out)
    return out


def produce(rows: DataFrame, marks: DataFrame, producers: DataFrame, own: DataFrame, schemas: Mapping[str, tuple[dict | None, dict | None]], now: Column) -> Produced:
    """rows (batch, arrival, place, topic, partition, producer_id, epoch, base_sequence, attributes, ts, k, v); marks (topic, partition, low, high);
    own as of options(); schemas by topic, (key, value) of JSON Schema.

    Rows without producer are not checked for sequence. Records of topics with log-append time get `now`. Sink-only topics reach the lake and move
    their offsets but are not part of the log. The lake gets no control records and no topic without schema.
    """
    rows = rows.join(own.select("topic", "schema_validation", "lake_sink", "message_timestamp_type"), "topic", "left")
    rows = rows.withColumn("_ok", (F.coalesce("schema_validation", F.lit("true")) == "false") | (F.col("attributes").bitwiseAND(CONTROL) != 0) | _valid(schemas))
    batches = rows.groupBy("batch", "arrival", *TOPITION, "producer_id", "epoch", "base_sequence").agg(F.count("*").alias("n"), F.every("_ok").alias("ok"))
    batches = written(batches.withColumn("records", F.when(F.col("ok"), F.col("n")).otherwise(F.lit(0))))  # a row a batch, read several times
    checked = sequence_check(batches.where("producer_id is not null"), producers)
    said = checked.unionByName(batches.where("producer_id is null").withColumn("verdict", F.lit("NONE")))
    said = written(said.withColumn("verdict", F.when((F.col("verdict") == "NONE") & ~F.col("ok"), "INVALID_RECORD").otherwise(F.col("verdict"))))
    good = said.where("verdict = 'NONE'").select("batch")
    place = F.row_number().over(Window.partitionBy(*TOPITION).orderBy("arrival", "place")) - 1
    taken = rows.join(good, "batch", "left_semi").join(marks.select(*TOPITION, "high"), TOPITION, "left")
    taken = taken.withColumn("offset_id", (F.coalesce("high", F.lit(0)) + place).cast("long"))
    taken = taken.withColumn("ts", F.when(F.col("message_timestamp_type") == "LogAppendTime", now).otherwise(F.col("ts")))
    columns = [*TOPITION, "offset_id", "ts", "k", "v", "producer_id", "epoch", "attributes"]
    sink = F.coalesce("lake_sink", F.lit("false")) == "true"
    ends = taken.groupBy(*TOPITION).agg((F.max("offset_id") + 1).alias("_high"))
    after = marks.join(ends, TOPITION, "full").select(*TOPITION, F.coalesce("low", F.lit(0)).cast("long").alias("low"), F.coalesce("_high", "high").alias("high"))
    lake = taken.where((F.col("attributes").bitwiseAND(CONTROL) == 0) & F.col("topic").isin(*schemas)).select(columns)
    return Produced(said.select("batch", "verdict"), taken.where(~sink).select(columns), lake, after)
