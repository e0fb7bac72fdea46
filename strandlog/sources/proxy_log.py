"""Requests and responses in a proxy's text log: pairs, their latency, and how many were in flight.

A line counts if it has a time, an id of 21 characters and the bytes of a frame; a request's bytes begin with its size (4), API key (2) and
version (2). An id's first line is its request, the second its response; later ones are ignored. Colours are taken out first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The form of a line.
COLOUR = r"\x1b\[[;\d]*[A-Za-z]"
LINE = r'^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z).*req\{id="(.{21})"\}.*(?:request|response)=\[((?:\d{1,3},?\s*)*)\]'
BUCKET_US = 1_000_000


def _short(data: Column, at: int) -> Column:
    """The signed 16-bit number at a place of an array of bytes, null beyond its end."""
    value = F.try_element_at(data, F.lit(at + 1)) * 256 + F.try_element_at(data, F.lit(at + 2))
    return F.when(value >= 32768, value - 65536).otherwise(value)


def frames(lines: DataFrame) -> DataFrame:
    """lines (value) -> id, at, bytes (array of int): the lines that have a frame."""
    plain = lines.select(F.regexp_replace("value", COLOUR, "").alias("line")).where(F.col("line").rlike(LINE))
    numbers = F.regexp_extract_all("line", F.lit(LINE), F.lit(3))[0]
    data = F.transform(F.filter(F.split(numbers, r"[,\s]+"), lambda x: x != ""), lambda x: x.cast("int"))
    return plain.select(F.regexp_extract("line", LINE, 2).alias("id"), F.to_timestamp(F.regexp_extract("line", LINE, 1)).alias("at"), data.alias("bytes"))


def _holds(data: Column, text: str) -> Column:
    """Whether a frame has a string, with its length before it: in two bytes, or plus one in one byte that is not the second of two."""
    own = text.encode()
    said = F.concat(F.lit(","), F.array_join(F.transform(data, lambda x: x.cast("string")), ","), F.lit(","))
    long = "," + ",".join(map(str, [len(own) >> 8, len(own) & 255, *own])) + ","
    short = "(?<!,0)," + ",".join(map(str, [len(own) + 1, *own])) + ","
    return said.contains(long) | said.rlike(short) if len(own) < 127 else said.contains(long)


def calls(found: DataFrame, apis: list[int] | None = None, holding: list[str] | None = None) -> DataFrame:
    """One row for each request: id, api_key, api_version, started, ended, elapsed_us; a request without response has nulls.

    One shuffle by id. apis: only requests of these keys. holding: only those whose request has each of these strings, such as a group's and a member's name.
    """
    turn = F.row_number().over(Window.partitionBy("id").orderBy("at", "bytes"))
    rows = found.withColumn("turn", turn).where("turn <= 2").groupBy("id").agg(*[F.max(F.when(F.col("turn") == n, F.struct("at", "bytes"))).alias(f"own{n}") for n in (1, 2)])
    for text in holding or []:
        rows = rows.where(_holds(F.col("own1.bytes"), text))
    out = rows.select("id", _short(F.col("own1.bytes"), 4).alias("api_key"), _short(F.col("own1.bytes"), 6).alias("api_version"), F.col("own1.at").alias("started"), F.col("own2.at").alias("ended"))
    out = out.withColumn("elapsed_us", F.unix_micros("ended") - F.unix_micros("started"))
    return out if apis is None else out.where(F.col("api_key").isin(apis))


def in_flight(found: DataFrame) -> DataFrame:
    """calls with the number of others that had begun before, by (started, id), and had not ended.

    Begins and ends are added up within seconds; the window over all time has one row a second only.
    """
    begins = found.select("id", F.unix_micros("started").alias("us"), F.lit(1).alias("turn"), F.lit(1).alias("more"))
    ends = found.where("ended is not null").select("id", F.unix_micros("ended").alias("us"), F.lit(0).alias("turn"), F.lit(-1).alias("more"))
    moves = begins.unionByName(ends).withColumn("second", F.floor(F.col("us") / BUCKET_US))
    total = moves.groupBy("second").agg(F.sum("more").alias("sum"))
    before = total.select("second", (F.sum("sum").over(Window.orderBy("second")) - F.col("sum")).alias("before"))
    own = F.sum("more").over(Window.partitionBy("second").orderBy("us", "turn", "id").rowsBetween(Window.unboundedPreceding, 0))
    counted = moves.withColumn("own", own).where("turn = 1").join(before, "second").select("id", (F.col("own") + F.col("before") - 1).alias("others"))
    return found.join(counted, "id")


def read(spark: SparkSession, path: str, apis: list[int] | None = None, holding: list[str] | None = None) -> DataFrame:
    return in_flight(calls(frames(spark.read.text(path)), apis, holding))
