"""The driver's tables as record logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import LogStore, kept


def events_store(spark: SparkSession, sf_dir: str) -> LogStore:
    """A topic for each event type with four partitions by user; the key is the user, the value the properties."""
    path = f"{sf_dir}/events.parquet"
    return kept(spark, path, lambda: _event_rows(spark, path), ["ts", "event_id"])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_store(spark, sf_dir).log


def _event_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(
        F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), "ts", "event_id",
        F.col("user_id").cast("string").alias("k"), F.col("props").alias("v"), "value",
    )


#: The same in DuckDB.
EVENTS_SQL = """select event_type as topic, cast(user_id % 4 as integer) as "partition", ts, event_id, cast(user_id as varchar) as k, props as v, value,
  row_number() over (partition by event_type, user_id % 4 order by ts, event_id) - 1 as offset_id from events"""


def conversations_store(spark: SparkSession, sf_dir: str) -> LogStore:
    """A topic for each role with eight partitions by conversation, in order of conversation and turn; the key is the conversation."""
    path = f"{sf_dir}/conversations.parquet"

    def rows() -> DataFrame:
        own = spark.read.parquet(path)
        return own.select(F.col("role").alias("topic"), (F.col("conv_id") % 8).cast("int").alias("partition"), "conv_id", "turn", F.col("conv_id").cast("string").alias("k"), F.col("text").alias("v"))

    return kept(spark, path, rows, ["conv_id", "turn"])


#: The same in DuckDB.
CONVERSATIONS_SQL = """select role as topic, cast(conv_id % 8 as integer) as "partition", conv_id, turn, cast(conv_id as varchar) as k, text as v,
  row_number() over (partition by role, conv_id % 8 order by conv_id, turn) - 1 as offset_id from conversations"""


def relation(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small literal relation; columns as DDL."""
    return spark.createDataFrame(rows, columns)


def relation_sql(columns: str, rows: list[tuple]) -> str:
    """The same in DuckDB."""

    def literal(x) -> str:
        return "NULL" if x is None else repr(x) if isinstance(x, int | float) and not isinstance(x, bool) else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"

    kinds = {"string": "varchar", "long": "bigint", "int": "integer", "boolean": "boolean", "double": "double"}
    names = [c.strip().split(" ") for c in columns.split(",")]
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    casts = ", ".join(f'cast("{n}" as {kinds[t]}) as "{n}"' for n, t in names)
    return f"select {casts} from (values {values}) x({', '.join(chr(34) + n + chr(34) for n, _ in names)})"
