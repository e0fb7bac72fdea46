"""Compaction, retention and deletion: each gives the log that stays, and never moves the high watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .log import TOPITION

WEEK_MS, CONTROL = 7 * 24 * 3600 * 1000, 32


def has_policy(value: Column, policy: str) -> Column:
    """A cleanup policy is an element of a comma list."""
    return F.array_contains(F.transform(F.split(value, ","), lambda x: F.trim(x)), policy)


def compact(log: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """The last record of each key, and records without one; control records (attributes bit 32) stay. Keys in head (topic, partition, k) have a later record there.

    Last offsets are counted per key with partial aggregation, so a key that holds many records makes no large task.
    """
    data = log.where(F.col("k").isNotNull())
    if "attributes" in log.columns:
        data = data.where(F.col("attributes").bitwiseAND(CONTROL) == 0)
    if head is not None:
        data = data.join(head.select(*TOPITION, "k").where("k is not null").distinct(), [*TOPITION, "k"], "left_anti").select(data.columns)
    last = data.groupBy(*TOPITION, "k").agg(F.max("offset_id").alias("offset_id"))
    kept = data.join(last, [*TOPITION, "k", "offset_id"], "left_semi")
    rest = F.col("k").isNull()
    if "attributes" in log.columns:
        rest = rest | (F.col("attributes").bitwiseAND(CONTROL) != 0)
    return kept.select(log.columns).unionByName(log.where(rest))


def duplicated_keys(log: DataFrame) -> DataFrame:
    """The last offset of each key that has more than one record."""
    found = log.where(F.col("k").isNotNull()).groupBy(*TOPITION, "k").agg(F.max("offset_id").alias("last_offset"), F.count("k").alias("records"))
    return found.where("records > 1")


def _fresh(now: Column, retention_ms: Column) -> Column:
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000
    return ~(age > F.coalesce(retention_ms, F.lit(WEEK_MS)))


def retain_batches(log: DataFrame, batch: str, now: Column, retention_ms: int = WEEK_MS) -> DataFrame:
    """As retain(), but whole batches go, by the greatest time of their records: the log's head up to the first batch within retention."""
    ends = log.groupBy(*TOPITION, batch).agg(F.max("ts").alias("ts"), F.min("offset_id").alias("_base"))
    first = ends.where(_fresh(now, F.lit(retention_ms))).groupBy(*TOPITION).agg(F.min("_base").alias("_first"))
    return log.join(first, TOPITION).where(F.col("offset_id") >= F.col("_first")).select(log.columns)


def retain(log: DataFrame, now: Column, retention_ms: Column | int = WEEK_MS, prefix: bool = True) -> DataFrame:
    """Records not older than retention. prefix: only the log's head goes, up to the first record that stays."""
    fresh = _fresh(now, retention_ms if isinstance(retention_ms, Column) else F.lit(retention_ms))
    if not prefix:
        return log.where(fresh)
    first = log.where(fresh).groupBy(*TOPITION).agg(F.min("offset_id").alias("_first"))
    return log.join(first, TOPITION).where(F.col("offset_id") >= F.col("_first")).select(log.columns)


def delete_before(log: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (topic, partition, before): records from that offset on stay."""
    return log.join(targets, TOPITION, "left").where(F.coalesce(F.col("offset_id") >= F.col("before"), F.lit(True))).select(log.columns)


def low_after(stored: DataFrame, kept: DataFrame) -> DataFrame:
    """stored (topic, partition, low, high) with low at the first survivor, or at high if none is left."""
    first = kept.groupBy(*TOPITION).agg(F.min("offset_id").alias("first"))
    return stored.join(first, TOPITION, "left").select(*TOPITION, F.coalesce("first", "high").alias("low"), "high")


def maintained(log: DataFrame, config: DataFrame, now: Column) -> DataFrame:
    """Deletion, then compaction, as each topic's settings (topic, policy, retention_ms) say.

    Deletion takes a prefix, so a key's last record is the same before and after it: both bounds are counted from the log itself, and
    the log is read once against them.
    """
    rows = log.join(config, "topic", "left")
    deletes, compacts = (F.coalesce(has_policy(F.col("policy"), p), F.lit(False)) for p in ("delete", "compact"))
    keyed = F.col("k").isNotNull()
    if "attributes" in log.columns:
        keyed = keyed & (F.col("attributes").bitwiseAND(CONTROL) == 0)
    first = rows.where(deletes & _fresh(now, F.col("retention_ms"))).groupBy(*TOPITION).agg(F.min("offset_id").alias("_first"))
    last = rows.where(compacts & keyed).groupBy(*TOPITION, "k").agg(F.max("offset_id").alias("offset_id")).withColumn("_last", F.lit(True))
    kept = rows.join(first, TOPITION, "left").where(~deletes | F.coalesce(F.col("offset_id") >= F.col("_first"), F.lit(False)))
    return kept.join(last, [*TOPITION, "k", "offset_id"], "left").where(~compacts | ~keyed | F.col("_last").isNotNull()).select(log.columns)


def maintain(log: DataFrame, marks: DataFrame, config: DataFrame, now: Column, lake: Callable[[], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """One run of maintenance: deletion, compaction, then the lake's own. Gives the log that stays and the marks, whose low is at the first survivor."""
    kept = maintained(log, config, now)
    after = low_after(marks, kept)
    if lake is not None:
        lake()
    return kept, after


def compacted_batches(log: DataFrame, marks: DataFrame, batch: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compaction of stored batches: (records that stay, batches that are left, marks with low at the first survivor). Control batches are not touched."""
    kept = compact(log)
    left = kept.groupBy(*TOPITION, batch).agg(F.min("offset_id").alias("base_offset"), F.count("*").alias("records"))
    return kept, left, low_after(marks, kept)


def distinct_keys(log: DataFrame) -> DataFrame:
    return log.where(F.col("k").isNotNull()).select(*TOPITION, "k").distinct()


def drop_topic(relations: dict[str, DataFrame], topic: str) -> dict[str, DataFrame]:
    """Every relation without the rows of a topic."""
    return {name: rows.where(F.col("topic") != topic) if "topic" in rows.columns else rows for name, rows in relations.items()}


def upsert(stored: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """One row for each key: the one with the greatest seq, new rows before stored ones of the same seq."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key and c != "_new"]
    last = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(seq, "_new")).alias("row"))
    return last.select(*key, "row.*")


def accumulated(stored: DataFrame, new: DataFrame, key: list[str], add: list[str] = [], low: list[str] = [], high: list[str] = []) -> DataFrame:  # noqa: B006
    """Sums, least and greatest values over stored and new rows of each key."""
    both = stored.unionByName(new)
    return both.groupBy(*key).agg(*[F.sum(c).alias(c) for c in add], *[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high])
