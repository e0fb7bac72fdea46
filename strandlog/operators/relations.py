"""The catalog's relations: creating, finding and deleting topics, groups, transactions and settings.

Relations are DataFrames by name: topic (topic, partitions, replication_factor), topition (topic, partition), watermark (topic, partition, low, high),
topic_configuration (topic, name, value), consumer_group_detail (group_id, e_tag, detail, members), consumer_offset (group_id, topic, partition,
committed), and any others that name a topic, group or transaction. Statements give the relations as they are afterwards; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.functions.scalar import topic_name_ok

Relations = dict[str, DataFrame]
#: Partitions and copies of a topic that is created because somebody asked for it.
AUTO_PARTITIONS, AUTO_COPIES = 4, 1


def create_topics(relations: Mapping[str, DataFrame], requests: DataFrame) -> tuple[DataFrame, Relations]:
    """requests (topic, partitions, replication_factor, configs map<string, string>) -> (topic and verdict, relations). Of two requests for a topic the one with more partitions counts."""
    one = requests.groupBy("topic").agg(F.max_by(F.struct("partitions", "replication_factor", "configs"), "partitions").alias("r")).select("topic", "r.*")
    known = relations["topic"].select("topic", F.lit(True).alias("_known"))
    verdict = F.when(~topic_name_ok(F.col("topic")) | F.col("topic").isNull(), "INVALID_TOPIC_EXCEPTION").when(F.col("_known"), "TOPIC_ALREADY_EXISTS").when(F.coalesce("partitions", F.lit(0)) < 1, "INVALID_PARTITIONS").otherwise("NONE")
    said = one.join(known, "topic", "left").withColumn("verdict", verdict)
    new = said.where("verdict = 'NONE'")
    tops = new.select("topic", F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)).alias("partition"))
    zero = F.lit(0).cast("long")
    out = dict(relations)
    out["topic"] = relations["topic"].unionByName(new.select("topic", "partitions", "replication_factor"), allowMissingColumns=True)
    out["topition"] = relations["topition"].unionByName(tops, allowMissingColumns=True)
    out["watermark"] = relations["watermark"].unionByName(tops.select("topic", "partition", zero.alias("low"), zero.alias("high")), allowMissingColumns=True)
    out["topic_configuration"] = relations["topic_configuration"].unionByName(new.select("topic", F.explode("configs").alias("name", "value")), allowMissingColumns=True)
    return said.select("topic", "verdict"), out


def without(relations: Mapping[str, DataFrame], gone: DataFrame, key: list[str]) -> Relations:
    """Every relation that has the key's columns without the rows of `gone`."""
    keys = gone.select(*key).distinct()
    return {name: rows.join(keys, key, "left_anti").select(rows.columns) if set(key) <= set(rows.columns) else rows for name, rows in relations.items()}


def delete_topics(relations: Mapping[str, DataFrame], names: DataFrame) -> tuple[DataFrame, Relations]:
    """names (topic) -> (topic and verdict, relations without all that names one of them)."""
    known = relations["topic"].select("topic", F.lit("NONE").alias("verdict")).distinct()
    said = names.select("topic").distinct().join(known, "topic", "left").withColumn("verdict", F.coalesce("verdict", F.lit("UNKNOWN_TOPIC_OR_PARTITION")))
    return said, without(relations, said.where("verdict = 'NONE'"), ["topic"])


def delete_groups(relations: Mapping[str, DataFrame], names: DataFrame) -> tuple[DataFrame, Relations]:
    """names (group_id) -> (group_id and verdict, relations): groups with members stay."""
    held = relations["consumer_group_detail"].groupBy("group_id").agg(F.max("members").alias("members"))
    verdict = F.when(F.col("members").isNull(), "GROUP_ID_NOT_FOUND").when(F.col("members") > 0, "NON_EMPTY_GROUP").otherwise("NONE")
    said = names.select("group_id").distinct().join(held, "group_id", "left").withColumn("verdict", verdict).select("group_id", "verdict")
    return said, without(relations, said.where("verdict = 'NONE'"), ["group_id"])


def delete_transactions(relations: Mapping[str, DataFrame], runs: DataFrame) -> Relations:
    """relations without what the given runs (txn, producer_id, epoch) hold: produced ranges, topitions and pending offsets; the list of transactions stays."""
    out = without({n: r for n, r in relations.items() if n != "txns"}, runs, ["txn", "producer_id", "epoch"])
    return out | {n: r for n, r in relations.items() if n == "txns"}


def delete_setting(relations: Mapping[str, DataFrame], settings: DataFrame) -> Relations:
    return dict(relations) | {"topic_configuration": without({"c": relations["topic_configuration"]}, settings, ["topic", "name"])["c"]}


def compare_and_set(stored: DataFrame, proposals: DataFrame, key: str = "group_id") -> tuple[DataFrame, DataFrame]:
    """stored (key, e_tag, detail), proposals (key, expected, new_tag, detail, seq) -> (answer to each, stored afterwards).

    A proposal wins if the tag that it expects (null: no row) is the current one and no earlier one did; a loser learns what is stored now.
    """
    rows = proposals.join(stored.select(key, F.col("e_tag").alias("_tag")), key, "left").withColumn("_fits", F.col("expected").eqNullSafe(F.col("_tag")))
    first = rows.where("_fits").groupBy(key).agg(F.min_by(F.struct("seq", "new_tag", "detail"), "seq").alias("w"))
    wins = first.select(key, F.col("w.seq").alias("_seq"), F.col("w.new_tag").alias("e_tag"), F.col("w.detail").alias("detail"))
    after = stored.join(wins.select(key), key, "left_anti").select(key, "e_tag", "detail").unionByName(wins.select(key, "e_tag", "detail"))
    now = after.select(key, F.col("e_tag").alias("current_tag"), F.col("detail").alias("current"))
    said = rows.select(key, "seq").join(wins.select(key, "_seq"), key, "left").join(now, key, "left")
    return said.select(key, "seq", F.when(F.col("seq") == F.col("_seq"), "OK").otherwise("OUTDATED").alias("answer"), "current_tag", "current"), after


def lookup(relations: Mapping[str, DataFrame], name: str, **equal) -> DataFrame:
    """The rows of a relation that have these values; null meets null."""
    rows = relations[name]
    for column, value in equal.items():
        rows = rows.where(F.col(column).eqNullSafe(value if isinstance(value, Column) else F.lit(value)))
    return rows


def metadata(relations: Mapping[str, DataFrame], names: DataFrame, auto_create: bool = True, partitions: int = AUTO_PARTITIONS, copies: int = AUTO_COPIES) -> tuple[DataFrame, Relations]:
    """names (topic) -> (topic, verdict, partitions; relations). Unknown topics of a valid name are created where that is allowed."""
    asked = names.select("topic").distinct()
    out: Relations = dict(relations)
    if auto_create:
        unknown = asked.join(relations["topic"].select("topic"), "topic", "left_anti").where(topic_name_ok(F.col("topic")))
        none = F.lit(None).cast("map<string, string>")
        _, out = create_topics(relations, unknown.select("topic", F.lit(partitions).alias("partitions"), F.lit(copies).alias("replication_factor"), none.alias("configs")))
    count = out["topition"].groupBy("topic").agg(F.count("*").cast("int").alias("partitions"))
    verdict = F.when(~topic_name_ok(F.col("topic")) | F.col("topic").isNull(), "INVALID_TOPIC_EXCEPTION").when(F.col("partitions").isNull(), "UNKNOWN_TOPIC_OR_PARTITION").otherwise("NONE")
    return asked.join(count, "topic", "left").withColumn("verdict", verdict).select("topic", "verdict", "partitions"), out


def describe_configs(relations: Mapping[str, DataFrame], asked: DataFrame) -> DataFrame:
    """asked (topic, names array or null) -> topic, verdict, name, value: all settings of a topic where no names are given; a name without value is null."""
    known = relations["topic"].select("topic", F.lit(True).alias("_known"))
    rows = asked.join(known, "topic", "left").join(relations["topic_configuration"].groupBy("topic").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("own")), "topic", "left")
    names = F.coalesce("names", F.sort_array(F.map_keys("own")), F.array().cast("array<string>"))
    out = rows.select("topic", F.when(F.col("_known"), "NONE").otherwise("UNKNOWN_TOPIC_OR_PARTITION").alias("verdict"), "own", F.explode_outer(F.when(F.col("_known"), names)).alias("name"))
    return out.select("topic", "verdict", "name", F.try_element_at("own", F.col("name")).alias("value"))


def describe_cluster(brokers: DataFrame, cluster: str) -> DataFrame:
    """brokers (node, host, port) -> them with the cluster's name; the least node is the controller."""
    least = brokers.agg(F.min("node")).first()[0]
    return brokers.select(F.lit(cluster).alias("cluster"), "node", "host", "port", (F.col("node") == F.lit(least)).alias("controller"))


def find_coordinator(brokers: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (key) -> the broker that coordinates each: nodes in order, by a hash of the key, so every broker gives the same answer."""
    nodes = [r.node for r in brokers.select("node").distinct().orderBy("node").collect()]  # brokers of one cluster
    if not nodes:
        return keys.select("key", F.lit("COORDINATOR_NOT_AVAILABLE").alias("verdict"), F.lit(None).cast("int").alias("node"))
    place = F.pmod(F.crc32(F.coalesce("key", F.lit("")).cast("binary")), F.lit(len(nodes))).cast("int")
    return keys.select("key", F.lit("NONE").alias("verdict"), F.element_at(F.array(*map(F.lit, nodes)), place + 1).cast("int").alias("node"))


def list_groups(states: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """states (group_id, state, ...) -> the groups in one of the wanted states."""
    rows = states.select("group_id", "state")
    return rows.where(F.col("state").isin(*wanted)) if wanted else rows


def describe_groups(states: DataFrame, members: DataFrame, names: DataFrame) -> DataFrame:
    """names (group_id) -> verdict, state and members in order."""
    own = members.groupBy("group_id").agg(F.sort_array(F.collect_set("member")).alias("members"))
    rows = names.select("group_id").distinct().join(states.select("group_id", "state"), "group_id", "left").join(own, "group_id", "left")
    verdict = F.when(F.col("state").isNull(), "GROUP_ID_NOT_FOUND").otherwise("NONE")
    return rows.select("group_id", verdict.alias("verdict"), F.coalesce("state", F.lit("Dead")).alias("state"), F.coalesce("members", F.array().cast("array<string>")).alias("members"))


def topic_ids(topics: DataFrame, virtual: DataFrame, uuid5) -> DataFrame:
    """Names by id: topics (topic, uuid) and virtual ones (topic, key), whose id is made from their name; each once."""
    name = F.concat_ws("/", "topic", "key")
    return topics.select("uuid", F.col("topic").alias("name")).union(virtual.select(uuid5(F.concat(F.lit("virtual:"), F.col("topic"), F.lit(":"), F.col("key"))).alias("uuid"), name.alias("name"))).distinct()
