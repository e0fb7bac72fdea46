"""Record logs as DataFrames: topic, partition, offset_id, ts, k, v and any further columns.

A (topic, partition) is the unit of order. Filters stand below windows, so that they and the columns read reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TOPITION = ["topic", "partition"]
#: Codes of a requested time that ask for an end of the log.
EARLIEST, LATEST = -2, -1


def in_order() -> WindowSpec:
    return Window.partitionBy(*TOPITION).orderBy("offset_id")


def so_far(less: int = 0) -> WindowSpec:
    """The records up to this one, less the last few."""
    return in_order().rowsBetween(Window.unboundedPreceding, -less)


def byte_size(*columns: str) -> Column:
    """Bytes of the columns, null as none."""
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0)).cast("long")


def append(log: DataFrame | None, rows: DataFrame, order: list[str], high: DataFrame | None = None) -> DataFrame:
    """rows with offset_id: the stored high watermark, or the end of log, plus the place in `order`. Offsets are never used twice."""
    own = rows.withColumn("offset_id", F.row_number().over(Window.partitionBy(*TOPITION).orderBy(*order)).cast("long") - 1)
    if high is None and log is not None:
        high = log.groupBy(*TOPITION).agg((F.max("offset_id") + 1).alias("high"))
    if high is None:
        return own
    return own.join(high.select(*TOPITION, "high"), TOPITION, "left").withColumn("offset_id", F.col("offset_id") + F.coalesce("high", F.lit(0))).drop("high")


def numbered(rows: DataFrame, order: list[str], written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with offset_id from 0 in each topition, by one range partitioning in place of a window over a whole topition.

    An offset is the place in the sorted partition, less the topition's first place there, plus its records in earlier partitions; the relation
    of those has a row for each partition and one more for each topition. `written` makes a table of what is sorted, so it is sorted once.
    """
    key = [*TOPITION, *order]
    placed = rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_place", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_place", 33)))
    runs = placed.groupBy(*TOPITION, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    runs = runs.withColumn("_before", F.sum("_n").over(Window.partitionBy(*TOPITION).orderBy("_part")) - F.col("_n"))
    runs = runs.select(F.col("topic").alias("_topic"), F.col("partition").alias("_partition"), F.col("_part").alias("_at"), "_first", "_before")
    same = F.col("topic").eqNullSafe(F.col("_topic")) & F.col("partition").eqNullSafe(F.col("_partition")) & (F.col("_part") == F.col("_at"))
    return placed.join(runs, same).select(*rows.columns, (F.col("_place") - F.col("_first") + F.col("_before")).alias("offset_id"))


def _reached(rows: DataFrame, marks: DataFrame, start: int, until: int, max_bytes: int) -> bool:
    """Whether the records below `until` spend every topition's budget or are all that it has."""
    spent = rows.where(F.col("offset_id") < until).groupBy(*TOPITION).agg(F.sum(byte_size("k", "v")).alias("spent"))
    short = marks.where(F.col("high") > max(until, start)).join(spent, TOPITION, "left").where(F.coalesce("spent", F.lit(0)) < max_bytes)
    return short.isEmpty()


def fetch(log: DataFrame, start: int, max_bytes: int, end: int | None = None, key: str | None = None, at_least_one: bool = False, marks: DataFrame | None = None) -> DataFrame:
    """Records of each topition from offset `start`, in order, while the bytes of keys and values so far stay below max_bytes.

    at_least_one: the record that crosses the budget is part of the answer. key: only records of that key (a virtual topic).
    marks: the stored watermarks. With them only as many offsets are read as the budget can need, as records mostly have a byte at least;
    where records without one leave a budget unspent, the range of offsets doubles.
    """
    rows = log.where(F.col("offset_id") >= start)
    if marks is not None and key is None and end is None:
        width = max(1024, max_bytes)
        while not _reached(rows, marks, start, start + width, max_bytes):
            width *= 2
        end = start + width
    if end is not None:
        rows = rows.where(F.col("offset_id") < end)
    if key is not None:
        rows = rows.where(F.col("k") == key)
    rows = rows.withColumn("size", byte_size("k", "v"))
    spent = F.coalesce(F.sum("size").over(so_far(1)), F.lit(0)) if at_least_one else F.sum("size").over(so_far())
    return rows.withColumn("spent", spent).where(F.col("spent") < max_bytes).drop("spent")


def fetch_across(log: DataFrame, start: int, max_bytes: int, partition_max_bytes: int) -> DataFrame:
    """One budget for all topitions in order. The first that has records may use all of it; each later one is first cut to its own limit,
    then the running sum of all is cut.

    The second pass adds up one number a topition, so the window without partition holds topitions, not records.
    """
    rows = fetch(log, start, max(max_bytes, partition_max_bytes)).withColumn("spent", F.sum("size").over(so_far()))
    first = rows.select(*TOPITION).distinct().orderBy(*TOPITION).limit(1).withColumn("first", F.lit(True))
    own = rows.join(first, TOPITION, "left").where(F.col("first").isNotNull() | (F.col("spent") < partition_max_bytes)).drop("first", "spent")
    totals = own.groupBy(*TOPITION).agg(F.sum("size").alias("total"))
    gone = totals.withColumn("gone", F.coalesce(F.sum("total").over(Window.orderBy(*TOPITION).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = own.join(gone.select(*TOPITION, "gone"), TOPITION)
    return both.withColumn("spent", F.sum("size").over(so_far()) + F.col("gone")).where(F.col("spent") < max_bytes).drop("spent", "gone")


def watermarks(log: DataFrame) -> DataFrame:
    return log.groupBy(*TOPITION).agg(F.min("offset_id").alias("low"), (F.max("offset_id") + 1).alias("high"))


def list_offsets(log: DataFrame, marks: DataFrame, at: Column | int, stable: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """The offset of each topition of marks (topic, partition, low, high) at a time or an end of the log, with the time of its record.

    The latest offset is the stored high watermark, whatever has been deleted since; for reads of committed data it is the last stable
    offset of `stable` (topic, partition, stable). Its time is that of the record before it (of the record there, where a transaction is open).
    compat: offset 0 where that record is deleted.
    """
    if not isinstance(at, int) or at not in (EARLIEST, LATEST):
        return offsets_at(log, marks, at)
    edge = marks.select(*TOPITION, F.col("low").alias("offset_id"), F.col("low").alias("_at"))
    if at == LATEST:
        edge = marks.select(*TOPITION, F.col("high").alias("offset_id"), (F.col("high") - 1).alias("_at"))
        if stable is not None:
            open_ = stable.select(*TOPITION, "stable")
            edge = marks.join(open_, TOPITION, "left").select(*TOPITION, F.coalesce("stable", "high").alias("offset_id"), F.when(F.col("stable") < F.col("high"), F.col("stable")).otherwise(F.col("high") - 1).alias("_at"))
    times = log.select(*TOPITION, F.col("offset_id").alias("_at"), "ts")
    out = edge.join(times, [*TOPITION, "_at"], "left").select(*TOPITION, "offset_id", "ts")
    return out.withColumn("offset_id", F.when(F.col("ts").isNull(), 0).otherwise(F.col("offset_id"))) if compat else out


def append_time(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows of topics with log-append time: their time is that of the append."""
    return rows.withColumn("ts", F.current_timestamp() if now is None else now)


def combined(batches: DataFrame, same: list[str]) -> DataFrame:
    """batches (..., arrival, base_offset, records array, max_ts) of one producer and topition as one batch: records follow each other in order of arrival, the time is the greatest."""
    rows = batches.select(*same, "arrival", "max_ts", F.posexplode("records").alias("place", "record"))
    order = Window.partitionBy(*same).orderBy("arrival", "place")
    moved = rows.withColumn("delta", F.row_number().over(order).cast("long") - 1)
    return moved.groupBy(*same).agg(F.sort_array(F.collect_list(F.struct("delta", "record"))).alias("records"), F.max("max_ts").alias("max_ts"), F.count("*").alias("n"))


def flushes(queued: DataFrame, least_bytes: int, wait_ms: int, same: list[str]) -> DataFrame:
    """queued (..., arrival, at_ms, size) with the flush of its queue that each request is part of.

    A queue is flushed by the request that makes its bytes exceed least_bytes, or once wait_ms have passed since its first request. Each flush
    depends on the one before, so a queue's requests stream in order of arrival through one task, which keeps three numbers.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, flush, held, first = None, 0, 0, 0
        for pdf in parts:
            keys = list(zip(*(pdf[c] for c in same), strict=True))
            out = []
            for k, ms, size in zip(keys, pdf["at_ms"].tolist(), pdf["size"].tolist(), strict=True):
                if k != at:
                    at, flush, held, first = k, 0, 0, ms
                elif held > least_bytes or ms - first >= wait_ms:
                    flush, held, first = flush + 1, 0, ms
                held += size
                out.append(flush)
            yield pdf.assign(flush=out)

    kinds = ", ".join(f"`{c}` {t}" for c, t in queued.dtypes)
    return queued.repartition(*same).sortWithinPartitions(*same, "arrival").mapInPandas(run, f"{kinds}, flush long")


def offsets_at(log: DataFrame, topitions: DataFrame, at: Column | int) -> DataFrame:
    """The first offset at or after a time, or an end of the log; offset 0 and no time where there is none."""
    if isinstance(at, int) and at in (EARLIEST, LATEST):
        pick = F.min_by if at == EARLIEST else F.max_by
        edge = F.min("offset_id") if at == EARLIEST else F.max("offset_id") + 1
        found = log.groupBy(*TOPITION).agg(edge.alias("offset_id"), pick("ts", "offset_id").alias("ts"))
    else:
        found = log.where(F.col("ts") >= at).groupBy(*TOPITION).agg(F.min("offset_id").alias("offset_id"), F.min_by("ts", "offset_id").alias("ts"))
    return topitions.select(*TOPITION).join(found, TOPITION, "left").withColumn("offset_id", F.coalesce("offset_id", F.lit(0).cast("long")))


def batches(log: DataFrame, same: list[str]) -> DataFrame:
    """Runs of records that follow each other without a gap and agree in `same`: one row for each batch."""
    prior = [F.lag(c).over(in_order()).eqNullSafe(F.col(c)) for c in same]
    joins = F.lag("offset_id").over(in_order()) + 1 == F.col("offset_id")
    for p in prior:
        joins = joins & p
    rows = log.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("batch", F.sum("_new").over(so_far()))
    return rows.groupBy(*TOPITION, "batch", *same).agg(F.min("offset_id").alias("base_offset"), F.count("*").alias("records"), F.max("ts").alias("max_ts"))


def contiguous(log: DataFrame, start: int = 0) -> DataFrame:
    """The records before the first gap after `start`."""
    rows = log.where(F.col("offset_id") >= start).withColumn("_place", F.row_number().over(in_order()) - 1 + start)
    return rows.where(F.col("offset_id") == F.col("_place")).drop("_place")


def virtual(log: DataFrame, topic: str, key: str) -> DataFrame:
    """The view topic/key of a topic."""
    return log.where((F.col("topic") == topic) & (F.col("k") == key)).withColumn("topic", F.concat_ws("/", F.lit(topic), F.lit(key)))


def virtual_if_enabled(log: DataFrame, own: DataFrame, topic: str, key: str) -> DataFrame:
    """As virtual(), empty unless the topic's option `virtual` is true; own as of produce.options()."""
    return virtual(log.join(own.where((F.col("topic") == topic) & (F.col("virtual") == "true")).select("topic"), "topic", "left_semi"), topic, key)


def page(rows: DataFrame, after: tuple[str, int] | None, limit: int) -> DataFrame:
    """A page of topitions in order, after a cursor."""
    if after is not None:
        rows = rows.where((F.col("topic") > after[0]) | (F.col("topic") == after[0]) & (F.col("partition") > after[1]))
    return rows.orderBy(*TOPITION).limit(limit)


def timed_batches(log: DataFrame, wait_ms: int, most: int) -> DataFrame:
    """log with slot and batch: records of one span of wait_ms, in order, in batches of `most` at most."""
    rows = log.withColumn("slot", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (1000 * wait_ms)))
    place = F.row_number().over(Window.partitionBy(*TOPITION, "slot").orderBy("offset_id")) - 1
    return rows.withColumn("batch", F.floor(place / most))


def headers_of(rows: DataFrame) -> DataFrame:
    """Appended records with an array of headers (hk, hv) as rows of the relation of headers, each with its place."""
    return rows.select(*TOPITION, "offset_id", F.posexplode("headers").alias("place", "h")).select(*TOPITION, "offset_id", "place", "h.hk", "h.hv")


def with_headers(log: DataFrame, headers: DataFrame) -> DataFrame:
    """Each record with an array of its headers, in their order."""
    own = headers.groupBy(*TOPITION, "offset_id").agg(F.sort_array(F.collect_list(F.struct("place", "hk", "hv"))).alias("headers"))
    return log.join(own, [*TOPITION, "offset_id"], "left")
