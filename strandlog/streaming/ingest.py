"""Streaming ingest: offsets from state, batches into lake tables once, heartbeats that run out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandlog.operators.log import TOPITION, byte_size
from strandlog.operators.transactions import verdict


def assigned(stream: DataFrame, order: str = "arrival") -> DataFrame:
    """stream (topic, partition, arrival, ...) with offset_id, in order of arrival within a micro-batch. The next offset of each topition is state, so it is never used twice.

    A topition's rows of one micro-batch are sorted in one task; the source's limits (files, rows or bytes a trigger) bound them.
    """
    kinds = T.StructType([*stream.schema.fields, T.StructField("offset_id", T.LongType())])

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high = state.get[0] if state.exists else 0
        held = pd.concat(list(parts), ignore_index=True)  # all of the group's rows in this micro-batch, whose size the source bounds
        out = held.sort_values(order, kind="stable")
        yield out.assign(offset_id=range(high, high + len(out)))
        state.update((high + len(out),))

    return stream.groupBy("topic", "partition").applyInPandasWithState(run, kinds, "high long", "append", GroupStateTimeout.NoTimeout)


def sequenced(stream: DataFrame, producers: DataFrame) -> DataFrame:
    """sequence_check() over a stream: batches with their verdict; where each producer's next batch must begin is state. producers is a table, read anew by each micro-batch.

    A producer's batches of one micro-batch for a topition are sorted in one task; the source's limits bound them.
    """
    key = ["producer_id", "epoch", *TOPITION]
    current = producers.groupBy("producer_id").agg(F.max("epoch").alias("_current"))
    kinds = T.StructType([*stream.schema.fields, T.StructField("verdict", T.StringType())])
    names = stream.columns

    def run(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected = state.get[0] if state.exists else 0
        rows, said = pd.concat(list(parts), ignore_index=True).sort_values("arrival", kind="stable"), []
        for epoch, now, base, records in zip(rows["epoch"], rows["_current"], rows["base_sequence"].tolist(), rows["records"].tolist(), strict=True):
            if pd.isna(now):
                said.append("UNKNOWN_PRODUCER_ID")
            elif now != epoch:
                said.append("PRODUCER_FENCED" if now > epoch else "INVALID_PRODUCER_EPOCH")
            else:
                said.append(verdict(expected, base))
                expected += records if said[-1] == "NONE" else 0
        state.update((expected,))
        yield rows[names].assign(verdict=said)

    return stream.join(current, "producer_id", "left").groupBy(*key).applyInPandasWithState(run, kinds, "expected long", "append", GroupStateTimeout.NoTimeout)


def expired(beats: DataFrame, timeout_ms: int = 45_000) -> DataFrame:
    """beats (group_id, member, ts): members that stay silent longer than the timeout of event time."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"group_id": [key[0]], "member": [key[1]], "last_ms": [last]})
            return
        last = max([*(int(p["ts"].max().timestamp() * 1000) for p in parts), state.get[0] if state.exists else 0])
        state.update((last,))
        state.setTimeoutTimestamp(max(last + timeout_ms, state.getCurrentWatermarkMs() + 1))

    marked = beats.withWatermark("ts", "0 seconds")
    return marked.groupBy("group_id", "member").applyInPandasWithState(run, "group_id string, member string, last_ms long", "last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def to_lake(root: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch is a directory of its own that a replay overwrites, so no row is stored twice."""

    def put(df: DataFrame, epoch: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{root}/batch={epoch:020d}")

    return put


def scheduled(job: Callable[[], None], every_s: float, until: Callable[[], bool], clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run a job at every multiple of every_s after the start until `until` holds; gives how often. A run that takes longer skips the times it misses, so runs never overlap."""
    began, at, runs = clock(), 0, 0
    while not until():
        wait = began + at * every_s - clock()
        if wait > 0:
            sleep(wait)
            continue
        job()
        runs += 1
        at = max(at + 1, int((clock() - began) // every_s) + (1 if (clock() - began) % every_s else 0))
    return runs


def polled(read: Callable[[], DataFrame], least_bytes: int, wait_s: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, every_s: float = 0.1) -> DataFrame:
    """read() again and again until its records (k, v) have least_bytes, or the deadline has passed; gives the last answer."""
    end = clock() + wait_s
    while True:
        rows = read()
        if (rows.agg(F.sum(byte_size("k", "v"))).first()[0] or 0) >= least_bytes or clock() >= end:
            return rows
        sleep(min(every_s, max(0.0, end - clock())))


def limited(rows: DataFrame, per_second: int, order: list[str]) -> DataFrame:
    """rows with second: when each may go out if no second has more than per_second of each topition."""
    place = F.row_number().over(Window.partitionBy(*TOPITION).orderBy(*order)) - 1
    return rows.withColumn("second", F.floor(place / per_second).cast("long"))


def rate(spark, rows_per_second: int) -> DataFrame:
    """A paced source of numbered rows."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("timestamp").alias("ts"), "value")
