"""Idempotent producers, the life of transactions and the isolation of reads.

The relations of a transaction coordinator: producers (producer_id, epoch; a row for each epoch), txns (txn, producer_id, epoch, status, started_at;
a row for each epoch of a named transaction), ranges (txn, producer_id, epoch, topic, partition, offset_start, offset_end; null offsets until
something is produced) and pending (txn, producer_id, epoch, group_id, topic, partition, committed). Operators give new versions of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .log import TOPITION

OPEN = ("BEGIN", "PREPARE_COMMIT", "PREPARE_ABORT")
#: The attributes bit of a control record, the two kinds of marker, and offsets in a block of the join with aborted ranges.
CONTROL, COMMIT_MARKER, ABORT_MARKER, BLOCK = 32, 1, 0, 4096


def stable_offsets(marks: DataFrame, txns: DataFrame) -> DataFrame:
    """marks (topic, partition, low, high), txns (..., status, offset_start): low, last stable and high of each topition."""
    first = txns.where(F.col("status").isin(*OPEN)).groupBy(*TOPITION).agg(F.min("offset_start").alias("stable"))
    return marks.join(first, TOPITION, "left").select(*TOPITION, F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("stable", "high", F.lit(0)).alias("stable"), F.coalesce("high", F.lit(0)).alias("high"))


def read_committed(log: DataFrame, marks: DataFrame, txns: DataFrame, hide_aborted: bool = True) -> DataFrame:
    """Records below the last stable offset; by default without those of aborted transactions and without control records.

    log has producer_id and epoch (null: no transaction), txns has them too: what another producer wrote between the first and last record of
    an aborted transaction stays. Ranges meet records by blocks of offsets, so a producer with many transactions makes no large join group.
    """
    bound = stable_offsets(marks, txns).select(*TOPITION, "stable")
    rows = log.join(bound, TOPITION).where(F.col("offset_id") < F.col("stable")).select(log.columns)
    if not hide_aborted:
        return rows
    if "attributes" in log.columns:
        rows = rows.where(F.coalesce(F.col("attributes"), F.lit(0)).bitwiseAND(CONTROL) == 0)
    gone = txns.where((F.col("status") == "ABORTED") & F.col("offset_start").isNotNull())
    gone = gone.select(*TOPITION, "producer_id", "epoch", "offset_start", "offset_end", F.explode(F.sequence(F.floor(F.col("offset_start") / BLOCK), F.floor(F.col("offset_end") / BLOCK))).alias("block"))
    rows = rows.withColumn("_block", F.floor(F.col("offset_id") / BLOCK))
    on = [rows[c] == gone[c] for c in (*TOPITION, "producer_id", "epoch")]
    return rows.join(gone, [*on, rows["_block"] == gone["block"], rows["offset_id"].between(gone["offset_start"], gone["offset_end"])], "left_anti").select(log.columns)


def overlapping(txns: DataFrame, name: str) -> DataFrame:
    """Other transactions with an offset range that begins no later than the named one's end, in a topition of its own."""
    own = txns.where(F.col("txn") == name).select(*TOPITION, F.col("offset_end").alias("own_end"))
    other = txns.join(own, TOPITION).where((F.col("offset_start") < F.col("own_end")) & F.col("status").isin(*OPEN))
    return other.select("txn", "status", *TOPITION, "offset_start", "offset_end").exceptAll(txns.where(F.col("txn") == name).select("txn", "status", *TOPITION, "offset_start", "offset_end"))


def end(txns: DataFrame, name: str, commit: bool) -> DataFrame:
    """The transactions after one ends: prepared while another open one overlaps, else final with all prepared ones that it overlaps."""
    names = overlapping(txns, name).select("txn", "status").distinct()
    waits = not names.where(F.col("status") == "BEGIN").isEmpty()
    near = names.select("txn").withColumn("near", F.lit(True))
    rows = txns.join(near, "txn", "left")
    final = F.when(F.col("status") == "PREPARE_COMMIT", "COMMITTED").when(F.col("status") == "PREPARE_ABORT", "ABORTED").otherwise(F.col("status"))
    own = F.lit(("PREPARE_COMMIT" if commit else "PREPARE_ABORT") if waits else ("COMMITTED" if commit else "ABORTED"))
    status = F.when(F.col("txn") == name, own).when(F.col("near") & F.lit(not waits), final).otherwise(F.col("status"))
    return rows.withColumn("status", status).select(txns.columns)


def verdict(expected: int, base: int) -> str:
    """Of a batch that begins at base where the last accepted one ended at expected."""
    return "NONE" if base == expected else "DUPLICATE_SEQUENCE_NUMBER" if expected > base else "OUT_OF_ORDER_SEQUENCE_NUMBER"


def sequence_check(batches: DataFrame, producers: DataFrame) -> DataFrame:
    """batches (producer_id, epoch, topic, partition, arrival, base_sequence, records) -> verdict of each.

    A batch is accepted if it begins where the last accepted one ended. Where every batch of a producer, epoch and topition begins at the
    sum of those before, that settles all of them. Only groups with another batch, or of another epoch, are followed one by one: they stream
    through sorted partitions, with one number of state, and no group is held in memory.
    """
    key = ["producer_id", "epoch", *TOPITION]
    current = producers.groupBy("producer_id").agg(F.max("epoch").alias("_current"))
    rows = batches.join(current, "producer_id", "left")
    before = Window.partitionBy(*key).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_odd", (F.col("base_sequence") != F.coalesce(F.sum("records").over(before), F.lit(0))) | ~F.col("epoch").eqNullSafe(F.col("_current")))
    odd = rows.where("_odd").select(*key).distinct().withColumn("_follow", F.lit(True))
    rows = rows.drop("_odd").join(odd, key, "left")
    plain = rows.where("_follow is null").select(*batches.columns, F.lit("NONE").alias("verdict"))
    todo = rows.where("_follow").drop("_follow")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, expected = None, 0
        for pdf in parts:
            said = []
            for k, own, current, base, records in zip(zip(*(pdf[c] for c in key), strict=True), pdf["epoch"], pdf["_current"], pdf["base_sequence"].tolist(), pdf["records"].tolist(), strict=True):
                if k != at:
                    at, expected = k, 0
                if pd.isna(current):
                    said.append("UNKNOWN_PRODUCER_ID")
                elif current != own:
                    said.append("PRODUCER_FENCED" if current > own else "INVALID_PRODUCER_EPOCH")
                else:
                    said.append(verdict(expected, base))
                    expected += records if said[-1] == "NONE" else 0
            yield pdf.drop(columns="_current").assign(verdict=said)

    kinds = ", ".join(f"`{c}` {t}" for c, t in todo.dtypes if c != "_current")
    followed = todo.repartition(*key).sortWithinPartitions(*key, "arrival").mapInPandas(run, f"{kinds}, verdict string")
    return plain.unionByName(followed.select(*batches.columns, "verdict"))


def next_epochs(epochs: DataFrame) -> DataFrame:
    """The epoch that each producer gets next; 0 for one without."""
    return epochs.groupBy("producer_id").agg(F.coalesce(F.max("epoch") + 1, F.lit(0)).alias("epoch"))


def current_epochs(producers: DataFrame) -> DataFrame:
    return producers.groupBy("producer_id").agg(F.max("epoch").alias("epoch"))


def init_producers(producers: DataFrame, txns: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """requests (request, txn or null) -> (answers: request, txn, producer_id, epoch; producers; txns).

    A known transaction keeps its producer, whose epoch grows by one, and an open run of it is aborted; a request without name, or with a new one,
    gets a new producer of epoch 0. Requests for the same name are answered alike, as one. New ids follow the greatest one in order of request.
    """
    known = txns.groupBy("txn").agg(F.max_by("producer_id", "epoch").alias("producer_id"))
    asked = requests.groupBy("txn", F.when(F.col("txn").isNull(), F.col("request")).alias("alone")).agg(F.min("request").alias("first"), F.collect_list("request").alias("requests"))
    asked = asked.join(known, "txn", "left").join(current_epochs(producers).withColumnRenamed("epoch", "_epoch"), "producer_id", "left")
    fresh = asked.where("producer_id is null")
    top = producers.agg(F.max("producer_id")).first()[0] or 0
    place = F.row_number().over(Window.orderBy("first"))  # one task numbers the new names of one step
    new = fresh.select("txn", "requests", (F.lit(top) + place).cast("long").alias("producer_id"), F.lit(0).alias("epoch"))
    old = asked.where("producer_id is not null").select("txn", "requests", "producer_id", (F.col("_epoch") + 1).alias("epoch"))
    given = old.unionByName(new)
    answers = given.select(F.explode("requests").alias("request"), "txn", "producer_id", "epoch")
    named = given.where("txn is not null")
    again = txns.join(named.select("txn", F.lit(True).alias("_again")), "txn", "left").withColumn("status", F.when(F.col("_again") & F.col("status").isin(*OPEN), "ABORTED").otherwise(F.col("status")))
    begun = named.select("txn", "producer_id", "epoch", F.lit(None).cast("string").alias("status"), F.lit(None).cast(dict(txns.dtypes)["started_at"]).alias("started_at"))
    return answers, producers.unionByName(given.select("producer_id", "epoch")), again.select(txns.columns).unionByName(begun)


def fencing(rows: DataFrame, producers: DataFrame) -> DataFrame:
    """rows (producer_id, epoch, ...) with the verdict on their producer: unknown, of another epoch than its current one, or none."""
    known = current_epochs(producers).withColumnRenamed("epoch", "_current")
    verdict = F.when(F.col("_current").isNull(), "UNKNOWN_PRODUCER_ID").when(F.col("_current") != F.col("epoch"), "INVALID_PRODUCER_EPOCH").otherwise("NONE")
    return rows.join(known, "producer_id", "left").withColumn("verdict", verdict).drop("_current")


def add_partitions(producers: DataFrame, txns: DataFrame, ranges: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """requests (txn, producer_id, epoch, topic, partition) -> (verdicts, txns, ranges): accepted topitions join the transaction, which begins with its first."""
    verdicts = fencing(requests.distinct(), producers)
    run = ["txn", "producer_id", "epoch"]
    good = verdicts.where("verdict = 'NONE'").select(*run, *TOPITION)
    new = good.join(ranges.select(*run, *TOPITION), [*run, *TOPITION], "left_anti")
    none = F.lit(None).cast("long")
    wider = ranges.unionByName(new.select(*run, *TOPITION, none.alias("offset_start"), none.alias("offset_end")))
    began = good.select(*run).distinct().withColumn("_began", F.lit(True))
    rows = txns.join(began, run, "left")
    started = F.when(F.col("_began") & F.col("started_at").isNull(), now).otherwise(F.col("started_at"))
    return verdicts, rows.withColumn("started_at", started).withColumn("status", F.when(F.col("_began") & F.col("status").isNull(), "BEGIN").otherwise(F.col("status"))).select(txns.columns), wider


def produced(ranges: DataFrame, written: DataFrame) -> DataFrame:
    """ranges widened by what was written (txn, producer_id, epoch, topic, partition, offset_start, offset_end)."""
    key = ["txn", "producer_id", "epoch", *TOPITION]
    return ranges.unionByName(written.select(ranges.columns)).groupBy(*key).agg(F.min("offset_start").alias("offset_start"), F.max("offset_end").alias("offset_end"))


def commit_offsets(producers: DataFrame, pending: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests (txn, producer_id, epoch, group_id, topic, partition, committed) -> (verdict of each, pending): accepted offsets wait for the transaction's end; the last of a topition counts."""
    verdicts = fencing(requests, producers)
    key = ["txn", "producer_id", "epoch", "group_id", *TOPITION]
    good = verdicts.where("verdict = 'NONE'").groupBy(*key).agg(F.max("committed").alias("committed"))
    return verdicts, pending.join(good.select(*key), key, "left_anti").select(*key, "committed").unionByName(good)


def markers(txns: DataFrame, ranges: DataFrame, ended: DataFrame, marks: DataFrame, now: Column) -> DataFrame:
    """ended (txn, producer_id, epoch, status) -> a control record at the end of each topition that they wrote to, in order of producer and epoch."""
    run = ["txn", "producer_id", "epoch"]
    wrote = ended.join(ranges.where("offset_start is not null").select(*run, *TOPITION), run)
    place = F.row_number().over(Window.partitionBy(*TOPITION).orderBy("producer_id", "epoch")) - 1
    rows = wrote.join(marks.select(*TOPITION, "high"), TOPITION)
    kind = F.when(F.col("status").isin("COMMITTED", "PREPARE_COMMIT"), COMMIT_MARKER).otherwise(ABORT_MARKER)
    return rows.select(*TOPITION, (F.col("high") + place).cast("long").alias("offset_id"), "producer_id", "epoch", F.lit(CONTROL).alias("attributes"), kind.alias("marker"), now.alias("ts"))


def applied(offsets: DataFrame, txns: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(offsets, pending) after committed transactions: their pending offsets replace the groups' own, those of aborted ones are dropped."""
    run = ["txn", "producer_id", "epoch"]
    status = pending.join(txns.select(*run, "status").distinct(), run, "left")
    key = ["group_id", *TOPITION]
    new = status.where("status = 'COMMITTED'").groupBy(*key).agg(F.max_by("committed", F.struct("epoch", "committed")).alias("committed"))
    left = status.where("status is null or status not in ('COMMITTED', 'ABORTED')").select(pending.columns)
    return offsets.join(new.select(*key), key, "left_anti").select(*key, "committed").unionByName(new), left
