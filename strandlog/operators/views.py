"""Reporting views over the catalog's relations.

Relations name each other by their natural keys, so a view is its finest relation, joined with those that must know its keys. The
finest relation comes first: the others are unique in what they share with it, so no join makes rows, and Catalyst broadcasts the
small ones by their sizes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import transactions

CLUSTER, TOPITION, EPOCH = ["cluster"], ["cluster", "topic", "partition"], ["cluster", "producer_id", "producer_epoch"]
GROUP_DETAIL = "generation_id int, rebalance_timeout_ms int, session_timeout_ms int, skip_assignment boolean, members map<string, string>"

#: name -> (relations, the finest first; columns).
VIEWS: dict[str, tuple[list[str], list[str]]] = {
    "v_topic": (["topic", "cluster"], [*CLUSTER, "topic", "uuid", "partitions", "replication_factor", "is_internal"]),
    "v_topition": (["topition", "topic", "cluster"], TOPITION),
    "v_topic_configuration": (["topic_configuration", "topic", "cluster"], [*CLUSTER, "topic", "name", "value"]),
    "v_record": (["record", "topition", "topic", "cluster"], [*TOPITION, "offset_id", "producer_id", "producer_epoch", "ts"]),
    "v_consumer_group": (["consumer_group", "cluster"], [*CLUSTER, "consumer_group"]),
    "v_consumer_offset": (["consumer_offset", "consumer_group", "topition", "topic", "cluster"], [*CLUSTER, "consumer_group", "topic", "partition", "committed_offset", "leader_epoch", "ts", "metadata"]),
    "v_producer_epoch": (["producer_epoch", "producer", "cluster"], EPOCH),
    "v_producer_detail": (["producer_detail", "producer_epoch", "producer", "topition", "topic", "cluster"], [*EPOCH, "topic", "partition", "sequence"]),
    "v_txn": (["txn", "cluster"], [*CLUSTER, "txn"]),
    "v_txn_detail": (["txn_detail", "producer_detail", "producer_epoch", "producer", "topition", "topic", "cluster"], [*EPOCH, "txn", "topic", "partition", "sequence", "transaction_timeout_ms", "started_at", "status"]),
    "v_txn_topition": (["txn_topition", "txn_detail", "txn", "producer_epoch", "producer", "topition", "topic", "cluster"], [*EPOCH, "txn", "topic", "partition"]),
    "v_txn_produce_offset": (["txn_produce_offset", "txn_topition", "txn_detail", "txn", "producer_epoch", "producer", "topition", "topic", "cluster"], [*EPOCH, "txn", "status", "topic", "partition", "offset_start", "offset_end"]),
    "v_txn_consumer_offset_tp": (["txn_offset_commit", "consumer_group", "txn_detail", "txn", "producer_epoch", "producer", "topition", "topic", "cluster"], [*EPOCH, "txn", "consumer_group", "topic", "partition", "committed_offset", "leader_epoch", "metadata"]),
}


def view(relations: Mapping[str, DataFrame], name: str) -> DataFrame:
    """A view by its name. A row whose topic, group, producer or cluster is unknown has no place in it.

    Columns that two relations share by accident do not join: only keys do, and other columns come from the finest relation.
    """
    if name == "v_consumer_group_detail":
        return _group_detail(relations)
    if name == "v_watermark":
        return _watermark(relations)
    names, columns = VIEWS[name]
    rows = relations[names[0]]
    keys = {*TOPITION, *EPOCH, "txn", "consumer_group"}
    for other in names[1:]:
        dim = relations[other]
        on = [c for c in dim.columns if c in keys and c in rows.columns]
        more = [c for c in columns if c in dim.columns and c not in rows.columns]
        rows = rows.join(dim.select(*on, *more), on) if more else rows.join(dim.select(*on), on, "left_semi")
    return rows.select(*columns)


def _group_detail(relations: Mapping[str, DataFrame]) -> DataFrame:
    rows = relations["consumer_group_detail"].join(view(relations, "v_consumer_group"), [*CLUSTER, "consumer_group"], "left_semi")
    rows = rows.withColumn("d", F.from_json("detail", GROUP_DETAIL))
    members = F.sort_array(F.map_keys(F.coalesce("d.members", F.create_map().cast("map<string, string>"))))
    return rows.select(*CLUSTER, "consumer_group", "e_tag", "d.generation_id", "d.rebalance_timeout_ms", "d.session_timeout_ms", "d.skip_assignment", members.alias("members"))


def _watermark(relations: Mapping[str, DataFrame]) -> DataFrame:
    """Low, last stable and high offset of every topition, those without records included."""
    topitions = view(relations, "v_topition")
    ends = topitions.join(relations["watermark"], TOPITION, "left").select(*TOPITION, F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("high", F.lit(0)).alias("high"))
    open_ = view(relations, "v_txn_produce_offset").where(F.col("status").isin(*transactions.OPEN))
    stable = open_.groupBy(*TOPITION).agg(F.min("offset_start").alias("stable"))
    return ends.join(stable, TOPITION, "left").select(*TOPITION, "low", F.coalesce("stable", "high").alias("stable"), "high")


def register(spark: SparkSession, relations: Mapping[str, DataFrame]) -> list[str]:
    """Every view whose relations are given as a temporary view for spark.sql."""
    needs = {n: r for n, (r, _) in VIEWS.items()}
    needs["v_consumer_group_detail"] = ["consumer_group_detail", "consumer_group", "cluster"]
    needs["v_watermark"] = ["watermark", *VIEWS["v_txn_produce_offset"][0]]
    done = [n for n, r in needs.items() if all(x in relations for x in r)]
    for name in done:
        view(relations, name).createOrReplaceTempView(name)
    return done
