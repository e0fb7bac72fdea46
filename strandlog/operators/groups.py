"""Consumer groups: assignment, lag, states, commits and evictions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .log import TOPITION


def range_assignment(topitions: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Per topic: members in order get runs of partitions, the first ones one more."""
    members = subscriptions.withColumn("at", F.row_number().over(Window.partitionBy("topic").orderBy("member")) - 1)
    members = members.withColumn("members", F.count("*").over(Window.partitionBy("topic")))
    parts = topitions.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy("partition")) - 1)
    parts = parts.withColumn("parts", F.count("*").over(Window.partitionBy("topic")))
    both = parts.join(members, "topic")  # one row for each member of a group and topic
    each, more = F.floor(F.col("parts") / F.col("members")), F.col("parts") % F.col("members")
    start = F.col("at") * each + F.least("at", more)
    length = each + F.when(F.col("at") < more, 1).otherwise(0)
    return both.where((F.col("place") >= start) & (F.col("place") < start + length)).select("member", *TOPITION)


def round_robin_assignment(topitions: DataFrame, members: DataFrame) -> DataFrame:
    """Topitions in order go around the members in order; all members have the same subscription."""
    n = members.count()
    turns = members.withColumn("turn", F.row_number().over(Window.orderBy("member")) - 1)
    dealt = topitions.withColumn("turn", F.pmod(F.row_number().over(Window.orderBy(*TOPITION)) - 1, F.lit(n)))
    return dealt.join(turns, "turn").select("member", *TOPITION)


def round_robin_by_subscription(topitions: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """topitions in order go around all members in order, passing those without a subscription to the topic; the turn moves on with each pass.

    Each choice depends on the one before, so one task reads the topitions, a catalog's rows, in order; it keeps the members only.
    A topic without members goes to nobody and moves no turn.
    """
    members = [r[0] for r in subscriptions.select("member").distinct().orderBy("member").collect()]  # one group's members
    heard = subscriptions.groupBy("topic").agg(F.collect_set("member").alias("_heard"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = 0
        for pdf in parts:
            given = []
            for heard_by in pdf["_heard"]:
                own = set(heard_by)
                while members[turn % len(members)] not in own:
                    turn += 1
                given.append(members[turn % len(members)])
                turn += 1
            yield pd.DataFrame({"member": given, "topic": pdf["topic"], "partition": pdf["partition"]})

    rows = topitions.select(*TOPITION).join(heard, "topic").repartition(1).sortWithinPartitions(*TOPITION)
    return rows.mapInPandas(run, "member string, topic string, partition int")


def assigned_by(strategy: str, topitions: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """An assignment by the strategy's name; uniform and cooperative-sticky deal as roundrobin does."""
    if strategy == "range":
        return range_assignment(topitions, subscriptions)
    if strategy in ("roundrobin", "uniform", "cooperative-sticky"):
        return round_robin_by_subscription(topitions, subscriptions)
    raise ValueError(f"unknown strategy {strategy}")


def lag(marks: DataFrame, committed: DataFrame) -> DataFrame:
    """Records that each group has not read yet."""
    return committed.join(marks.select(*TOPITION, "high"), TOPITION).select("group_id", *TOPITION, "committed", "high", (F.col("high") - F.col("committed")).alias("lag"))


def states(groups: DataFrame) -> DataFrame:
    """groups (group_id, formed, members) -> the state that a listing shows."""
    state = F.when(F.col("members") == 0, "Empty").when(F.col("formed"), "Stable").otherwise("PreparingRebalance")
    return groups.withColumn("state", state)


def commit_verdicts(commits: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """commits (group_id, member, generation): whether each may commit."""
    known = members.select("group_id", "member").withColumn("known", F.lit(True))
    rows = commits.join(groups, "group_id", "left").join(known, ["group_id", "member"], "left")
    anonymous = (F.col("member") == "") & (F.coalesce("members", F.lit(0)) == 0)
    verdict = F.when(anonymous, "NONE").when(F.col("known").isNull(), "UNKNOWN_MEMBER_ID").when(F.col("formed") & (F.col("generation") != F.col("current")), "ILLEGAL_GENERATION").otherwise("NONE")
    return rows.withColumn("verdict", verdict).select(*commits.columns, "verdict")


def evicted(beats: DataFrame, timeout_s: int, group: list[str], now: Column | None = None) -> DataFrame:
    """Spells of silence longer than the timeout in each member's heartbeats (columns of group, ts): last beat and seconds until the next, or until now."""
    later = F.lead("ts").over(Window.partitionBy(*group).orderBy("ts"))
    later = later if now is None else F.coalesce(later, now)
    gap = F.unix_seconds(F.col("next").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return beats.withColumn("next", later).withColumn("silent_s", gap).where(F.col("silent_s") > timeout_s).select(*group, "ts", "silent_s")


def paused(beats: DataFrame, rejoins: DataFrame, pause_s: int = 3) -> DataFrame:
    """rejoins (group_id, instance, ts) of static members: whether each comes within the pause after the instance's last beat, so that its assignment is kept."""
    key = ["group_id", "instance"]
    both = rejoins.select(*key, "ts", F.lit(None).cast(dict(beats.dtypes)["ts"]).alias("_beat")).unionByName(beats.select(*key, "ts", F.col("ts").alias("_beat")))
    before = Window.partitionBy(*key).orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("beat", F.max("_beat").over(before)).where("_beat is null").drop("_beat")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("beat").cast("timestamp"))) / 1_000_000
    return own.withColumn("kept", F.coalesce(gap <= pause_s, F.lit(False)))
