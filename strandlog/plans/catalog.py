"""Named queries over the driver's tables, and their equals in DuckDB.

Tables hold no transactions, groups, settings or producers, so those come as small literal relations in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions import json_schema, scalar
from strandlog.operators import groups, lake, log, maintenance, metrics, transactions
from strandlog.sources.tables import EVENTS_SQL, events, events_store, relation, relation_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CONFIG = "topic string, policy string, retention_ms long", [("click", "compact", None), ("view", "delete, compact", 86_400_000), ("purchase", "delete", 3_600_000), ("login", "compacted", None)]
TXNS = "txn string, status string, topic string, partition int, offset_start long, offset_end long", [
    ("t1", "BEGIN", "click", 0, 40, 60), ("t2", "PREPARE_COMMIT", "click", 0, 30, 50), ("t3", "COMMITTED", "click", 1, 5, 9), ("t4", "ABORTED", "view", 2, 10, 20),
    ("t5", "PREPARE_ABORT", "view", 2, 60, 70), ("t6", "ABORTED", "purchase", 3, 0, 4), ("t7", "PREPARE_COMMIT", "view", 2, 40, 65),
]
COMMITS = "group_id string, topic string, partition int, committed long, seq long", [("g1", "click", 0, 10, 1), ("g1", "click", 0, 25, 2), ("g1", "view", 1, 3, 3), ("g2", "click", 0, 0, 4), ("g2", "purchase", 3, 7, 5), ("g1", "view", 1, 2, 6)]
MEMBERS = "topic string, member string", [("click", "m1"), ("click", "m2"), ("click", "m3"), ("view", "m2"), ("view", "m3"), ("purchase", "m1")]
ALL_MEMBERS = "member string", [("m1",), ("m2",), ("m3",)]
GROUPS = "group_id string, formed boolean, members int, current int", [("g1", True, 2, 5), ("g2", False, 1, 1), ("g3", False, 0, 0)]
GROUP_MEMBERS = "group_id string, member string", [("g1", "a"), ("g1", "b"), ("g2", "c")]
GROUP_COMMITS = "group_id string, member string, generation int", [("g1", "a", 5), ("g1", "b", 4), ("g1", "x", 5), ("g2", "c", 9), ("g3", "", -1), ("g1", "", 5), ("g9", "", 0)]
SETTINGS = "name string, value string, operation string, change string", [("a", "x,y", "APPEND", "y,z"), ("b", "x,y", "SUBTRACT", "y"), ("c", None, "SET", "q"), ("d", "x", "DELETE", None), ("e", None, "APPEND", "k")]
NAMES = "name string", [("orders",), (".",), ("..",), ("a b",), ("a-b_c.9",), ("",), ("x" * 249,), ("x" * 250,), ("é",)]
EPOCHS = "producer_id long, epoch int", [(1, 0), (1, 1), (2, 0), (3, None)]


def query(sql: str | None = None):
    """Register a function under its name; sql has `log` as the event log."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"with log as ({EVENTS_SQL}){sql}"
        return f

    return put


def _with(**relations: tuple[str, list[tuple]]) -> str:
    return "".join(f", {name} as ({relation_sql(*r)})" for name, r in relations.items())


@query(""", f as (select *, strlen(k) + strlen(v) as size, sum(strlen(k) + strlen(v)) over (partition by topic, "partition" order by offset_id) as spent from log where offset_id >= 10)
select topic, "partition", offset_id, k, v, cast(size as bigint) as size from f where spent < 4096""")
def fetch(spark, sf):
    own = events_store(spark, sf)
    return log.fetch(own.log, 10, 4096, marks=own.marks).select("topic", "partition", "offset_id", "k", "v", "size")


@query(""", f as (select *, coalesce(sum(strlen(k) + strlen(v)) over (partition by topic, "partition" order by offset_id rows between unbounded preceding and 1 preceding), 0) as spent from log where offset_id >= 0 and offset_id < 500)
select topic, "partition", offset_id from f where spent < 5""")
def fetch_at_least_one(spark, sf):
    return log.fetch(events(spark, sf), 0, 5, end=500, at_least_one=True).select("topic", "partition", "offset_id")


@query(""", f as (select *, sum(strlen(k) + strlen(v)) over (partition by topic, "partition" order by offset_id) as spent from log where k = '7')
select topic || '/7' as topic, "partition", offset_id, v from f where topic = 'click' and spent < 200""")
def fetch_keyed(spark, sf):
    return log.fetch(log.virtual(events(spark, sf), "click", "7"), 0, 200).select("topic", "partition", "offset_id", "v")


@query(""", a as (select *, strlen(k) + strlen(v) as size, sum(strlen(k) + strlen(v)) over (partition by topic, "partition" order by offset_id) as own from log),
f as (select topic, "partition" from log order by all limit 1), c as (select * from a where own < 1000 or (topic, "partition") in (select (topic, "partition") from f) and own < 5000),
b as (select *, sum(size) over (order by topic, "partition", offset_id) as spent from c)
select topic, "partition", offset_id from b where spent < 5000""")
def fetch_across(spark, sf):
    return log.fetch_across(events(spark, sf), 0, 5000, 1000).select("topic", "partition", "offset_id")


@query(""" select topic, "partition", min(offset_id) as low, max(offset_id) + 1 as high from log group by all""")
def watermarks(spark, sf):
    return log.watermarks(events(spark, sf))


def _tops(spark, sf):
    return log.watermarks(events(spark, sf))


@query(""" select topic, "partition", min(offset_id) as offset_id, arg_min(ts, offset_id) as ts from log group by all""")
def offsets_earliest(spark, sf):
    return log.offsets_at(events(spark, sf), _tops(spark, sf), log.EARLIEST)


@query(""" select topic, "partition", max(offset_id) + 1 as offset_id, arg_max(ts, offset_id) as ts from log group by all""")
def offsets_latest(spark, sf):
    return log.offsets_at(events(spark, sf), _tops(spark, sf), log.LATEST)


@query(""", mid as (select min(ts) + (max(ts) - min(ts)) / 2 as t from log), f as (select topic, "partition", min(offset_id) as o, arg_min(ts, offset_id) as ts from log, mid where ts >= t group by all)
select distinct l.topic, l."partition", coalesce(f.o, 0) as offset_id, f.ts from log l left join f using (topic, "partition")""")
def offsets_by_time(spark, sf):
    rows = events(spark, sf)
    lo, hi = rows.agg(F.min("ts"), F.max("ts")).first()
    return log.offsets_at(rows, log.watermarks(rows), F.lit(lo + (hi - lo) / 2))


@query(""", p as (select distinct topic, "partition" from log) select * from p where (topic, "partition") > ('login', 1) order by 1, 2 limit 5""")
def describe_page(spark, sf):
    return log.page(_tops(spark, sf).select("topic", "partition"), ("login", 1), 5)


@query(""", a as (select topic, "partition", offset_id + 100 as offset_id, k from log) select topic, "partition", min(offset_id) as low, max(offset_id) as high, count(*) as records from a group by all""")
def append_after(spark, sf):
    rows = events(spark, sf)
    high = log.watermarks(rows).withColumn("high", F.lit(100).cast("long"))
    out = log.append(None, rows.drop("offset_id"), ["ts", "event_id"], high)
    return out.groupBy("topic", "partition").agg(F.min("offset_id").alias("low"), F.max("offset_id").alias("high"), F.count("*").alias("records"))


@query(""", r as (select *, case when k = lag(k) over (partition by topic, "partition" order by offset_id) then 0 else 1 end as new from log),
b as (select *, sum(new) over (partition by topic, "partition" order by offset_id) as batch from r)
select topic, "partition", cast(batch as bigint) as batch, k, min(offset_id) as base_offset, count(*) as records, max(ts) as max_ts from b group by all""")
def batches(spark, sf):
    return log.batches(events(spark, sf), ["k"])


@query(""", h as (select topic, "partition", max(offset_id) // 2 + "partition" as gap from log group by topic, "partition"), s as (select log.* from log join h using (topic, "partition") where offset_id <> gap), n as (select *, row_number() over (partition by topic, "partition" order by offset_id) - 1 as place from s)
select topic, "partition", count(*) as records from n where place = offset_id group by all""")
def contiguous(spark, sf):
    own = events_store(spark, sf)
    gap = own.marks.select("topic", "partition", (F.floor((F.col("high") - 1) / 2) + F.col("partition")).alias("offset_id"))
    return log.contiguous(own.log.join(gap, ["topic", "partition", "offset_id"], "left_anti")).groupBy("topic", "partition").agg(F.count("*").alias("records"))


@query(""", h as (select topic, "partition", offset_id, 'type' as hk, topic as hv from log where offset_id % 2 = 0 union all select topic, "partition", offset_id, 'user', k from log where offset_id % 3 = 0)
select l.topic, l."partition", l.offset_id, count(hk) as headers, min(hk) as first_header from log l left join h using (topic, "partition", offset_id) group by all""")
def headers(spark, sf):
    rows = events(spark, sf)
    own = rows.where("offset_id % 2 = 0").select("topic", "partition", "offset_id", F.lit(0).alias("place"), F.lit("type").alias("hk"), F.col("topic").alias("hv"))
    own = own.unionByName(rows.where("offset_id % 3 = 0").select("topic", "partition", "offset_id", F.lit(1).alias("place"), F.lit("user").alias("hk"), F.col("k").alias("hv")))
    out = log.with_headers(rows, own)
    return out.select("topic", "partition", "offset_id", F.coalesce(F.size("headers"), F.lit(0)).cast("long").alias("headers"), F.try_element_at(F.col("headers.hk"), F.lit(1)).alias("first_header"))


@query(""" select topic, "partition", offset_id, k, v from log qualify offset_id = max(offset_id) over (partition by topic, "partition", k)""")
def compaction(spark, sf):
    return maintenance.compact(events(spark, sf)).select("topic", "partition", "offset_id", "k", "v")


@query(""" select topic, "partition", k, max(offset_id) as last_offset, count(k) as records from log group by all having count(k) > 1""")
def duplicated_keys(spark, sf):
    return maintenance.duplicated_keys(events(spark, sf))


@query(""" select topic, "partition", offset_id from log, (select max(ts) as now from log) where epoch_us(now) - epoch_us(ts) <= 86400000000""")
def retention_rows(spark, sf):
    rows = events(spark, sf)
    return maintenance.retain(rows, F.lit(rows.agg(F.max("ts")).first()[0]), 86_400_000, prefix=False).select("topic", "partition", "offset_id")


@query(""", f as (select topic, "partition", min(offset_id) as first from log, (select max(ts) as now from log) where epoch_us(now) - epoch_us(ts) <= 86400000000 group by all)
select topic, "partition", offset_id from log join f using (topic, "partition") where offset_id >= first""")
def retention_prefix(spark, sf):
    rows = events(spark, sf)
    return maintenance.retain(rows, F.lit(rows.agg(F.max("ts")).first()[0]), 86_400_000).select("topic", "partition", "offset_id")


@query(""" select topic, "partition", min(offset_id) as low, count(*) as records from log where offset_id >= 20 + "partition" group by all""")
def delete_records(spark, sf):
    rows = events(spark, sf)
    targets = log.watermarks(rows).select("topic", "partition", (F.lit(20) + F.col("partition")).alias("before"))
    return maintenance.delete_before(rows, targets).groupBy("topic", "partition").agg(F.min("offset_id").alias("low"), F.count("*").alias("records"))


@query(_with(config=CONFIG) + """, c as (select l.*, policy, retention_ms from log l left join config using (topic)), now as (select max(ts) as now from log),
d as (select topic, "partition", min(offset_id) as first from c, now where policy like '%delete%' and epoch_us(now) - epoch_us(ts) <= retention_ms * 1000 group by all),
kept as (select c.* from c left join d using (topic, "partition") where coalesce(policy, '') not like '%delete%' or offset_id >= first)
select topic, "partition", offset_id from kept qualify coalesce(policy, '') not in ('compact', 'delete, compact') or offset_id = max(offset_id) over (partition by topic, "partition", k)""")
def maintenance_job(spark, sf):
    rows = events(spark, sf)
    return maintenance.maintained(rows, relation(spark, *CONFIG), F.lit(rows.agg(F.max("ts")).first()[0])).select("topic", "partition", "offset_id")


@query(_with(txns=TXNS) + """, w as (select topic, "partition", min(offset_id) as low, max(offset_id) + 1 as high from log group by all),
s as (select topic, "partition", min(offset_start) as stable from txns where status in ('BEGIN', 'PREPARE_COMMIT', 'PREPARE_ABORT') group by all)
select topic, "partition", low, coalesce(stable, high) as stable, high from w left join s using (topic, "partition")""")
def watermark_view(spark, sf):
    return transactions.stable_offsets(log.watermarks(events(spark, sf)), relation(spark, *TXNS))


@query(_with(txns=TXNS) + """ select o.txn, o.status, o.topic, o."partition", o.offset_start, o.offset_end from txns o join txns t on o.topic = t.topic and o."partition" = t."partition" and t.txn = 't5' and o.txn <> 't5'
where o.offset_start < t.offset_end and o.status in ('BEGIN', 'PREPARE_COMMIT', 'PREPARE_ABORT')""")
def overlapping_transactions(spark, sf):
    return transactions.overlapping(relation(spark, *TXNS), "t5")


@query(_with(txns=TXNS) + """, near as (select distinct o.txn, o.status from txns o join txns t on o.topic = t.topic and o."partition" = t."partition" and t.txn = 't5' and o.txn <> 't5' where o.offset_start < t.offset_end and o.status in ('BEGIN', 'PREPARE_COMMIT', 'PREPARE_ABORT')),
w as (select coalesce(bool_or(status = 'BEGIN'), false) as waits from near)
select txn, case when txn = 't5' then case when waits then 'PREPARE_COMMIT' else 'COMMITTED' end when txn in (select txn from near) and not waits then replace(replace(status, 'PREPARE_COMMIT', 'COMMITTED'), 'PREPARE_ABORT', 'ABORTED') else status end as status, topic, "partition", offset_start, offset_end from txns, w""")
def end_transaction(spark, sf):
    return transactions.end(relation(spark, *TXNS), "t5", commit=True)


@query(_with(e=EPOCHS) + " select producer_id, cast(coalesce(max(epoch) + 1, 0) as integer) as epoch from e group by all")
def next_epochs(spark, sf):
    return transactions.next_epochs(relation(spark, *EPOCHS))


_COMMITTED = _with(c=COMMITS) + ', u as (select group_id, topic, "partition", arg_max(committed, seq) as committed, max(seq) as seq from c group by all)'


@query(_COMMITTED + ' select group_id, topic, "partition", committed, seq from u')
def commit_upsert(spark, sf):
    c = relation(spark, *COMMITS)
    return maintenance.upsert(c.where("seq <= 3"), c.where("seq > 3"), ["group_id", "topic", "partition"], "seq")


@query(_COMMITTED + """, w as (select topic, "partition", max(offset_id) + 1 as high from log group by all) select group_id, topic, "partition", committed, high, high - committed as lag from u join w using (topic, "partition")""")
def consumer_lag(spark, sf):
    c = relation(spark, *COMMITS)
    return groups.lag(log.watermarks(events(spark, sf)), maintenance.upsert(c.where("seq <= 3"), c.where("seq > 3"), ["group_id", "topic", "partition"], "seq"))


@query(""" select topic, "partition", cast(sum(n) as bigint) as records, min(low) as low, max(high) as high from (
select topic, "partition", count(*) as n, min(offset_id) as low, max(offset_id) as high from log group by all) group by all""")
def accumulated(spark, sf):
    rows = events(spark, sf)

    def part(cond: str) -> DataFrame:
        return rows.where(cond).groupBy("topic", "partition").agg(F.count("*").alias("records"), F.min("offset_id").alias("low"), F.max("offset_id").alias("high"))

    return maintenance.accumulated(part("offset_id < 9"), part("offset_id >= 9"), ["topic", "partition"], add=["records"], low=["low"], high=["high"])


@query(""" select topic, "partition", count(*) as records from log where topic <> 'click' group by all""")
def drop_topic(spark, sf):
    return maintenance.drop_topic({"log": events(spark, sf)}, "click")["log"].groupBy("topic", "partition").agg(F.count("*").alias("records"))


@query(_with(m=MEMBERS) + """, t as (select distinct topic, "partition" from log), p as (select *, row_number() over (partition by topic order by "partition") - 1 as place, count(*) over (partition by topic) as parts from t),
n as (select *, row_number() over (partition by topic order by member) - 1 as pos, count(*) over (partition by topic) as members from m)
select member, topic, "partition" from p join n using (topic) where place >= pos * (parts // members) + least(pos, parts % members) and place < (pos + 1) * (parts // members) + least(pos + 1, parts % members)""")
def assign_range(spark, sf):
    return groups.range_assignment(_tops(spark, sf).select("topic", "partition"), relation(spark, *MEMBERS))


@query(""", t as (select topic, "partition", row_number() over (order by topic, "partition") - 1 as n from (select distinct topic, "partition" from log)) select 'm' || (n % 3 + 1) as member, topic, "partition" from t""")
def assign_round_robin(spark, sf):
    return groups.round_robin_assignment(_tops(spark, sf).select("topic", "partition"), relation(spark, *ALL_MEMBERS))


@query(_with(g=GROUPS) + " select *, case when members = 0 then 'Empty' when formed then 'Stable' else 'PreparingRebalance' end as state from g")
def group_states(spark, sf):
    return groups.states(relation(spark, *GROUPS))


@query(_with(g=GROUPS, m=GROUP_MEMBERS, c=GROUP_COMMITS) + """ select c.group_id, c.member, c.generation, case when c.member = '' and coalesce(members, 0) = 0 then 'NONE' when m.member is null then 'UNKNOWN_MEMBER_ID'
when formed and generation <> current then 'ILLEGAL_GENERATION' else 'NONE' end as verdict from c left join g using (group_id) left join m on m.group_id = c.group_id and m.member = c.member""")
def commit_fencing(spark, sf):
    return groups.commit_verdicts(relation(spark, *GROUP_COMMITS), relation(spark, *GROUPS), relation(spark, *GROUP_MEMBERS))


def _nested(spark, sf):
    return events(spark, sf).select(lake.meta(F.col("partition"), F.col("ts")).alias("meta"), F.col("k").alias("key"), F.struct(F.col("event_id"), F.struct("value", "v").alias("body")).alias("value"))


@query(""" select "partition" as meta_partition, ts as meta_timestamp, cast(year(ts) as integer) as meta_year, cast(month(ts) as integer) as meta_month, cast(day(ts) as integer) as meta_day, k as "key", event_id as value_event_id, value as value_body_value, v as value_body_v from log""")
def flattened(spark, sf):
    return lake.flatten(_nested(spark, sf), "_")


@query(""" select event_id, cast(cast(ts as date) as varchar) as "date", cast(round(value) as integer) as whole from log""")
def generated_columns(spark, sf):
    out = lake.generate(_nested(spark, sf), {"date": "cast(cast(meta.timestamp as date) as string)", "whole": "cast(round(value.body.value) as int)"})
    return out.select("value.event_id", "date", "whole")


@query(""" select event_id, case when topic in ('click', 'error') then null else k end as k, case when topic in ('view', 'purchase') then value end as value from log""")
def added_columns(spark, sf):
    rows = events(spark, sf)
    steps = (F.col("topic").isin("click", "error"), F.col("topic").isin("view", "purchase"))
    return lake.merged([rows.where(steps[0]).select("event_id"), rows.where(~steps[0] & ~steps[1]).select("event_id", "k"), rows.where(steps[1]).select("event_id", "k", "value")])


@query(""" select event_id, cast(list_sum([(((event_id % 16) >> b) & 1) * (1 << (2 * b)) + ((("partition") >> b) & 1) * (1 << (2 * b + 1)) for b in range(4)]) as bigint) as z from log""")
def z_order(spark, sf):
    rows = events(spark, sf).withColumn("low", F.col("event_id") % 16)
    return rows.select("event_id", lake.z_value(["low", "partition"], 4).alias("z"))


SCHEMA = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 10, "multipleOf": 2}}, "required": ["k"]}


@query(""" select event_id, cast(v->>'k' as bigint) >= 10 and cast(v->>'k' as bigint) % 2 = 0 as valid from log""")
def validation(spark, sf):
    return events(spark, sf).select("event_id", json_schema.valid(F.col("v"), SCHEMA).alias("valid"))


@query(""", x as (select topic, "partition", event_id, cast(v->>'k' as bigint) >= 2 as ok from log) select topic, "partition", bool_and(ok) as accepted, cast(count_if(not ok) as bigint) as rejected from x group by all""")
def batch_verdicts(spark, sf):
    ok = json_schema.valid(F.col("v"), {"type": "object", "properties": {"k": {"minimum": 2}}})
    return events(spark, sf).select("topic", "partition", ok.alias("ok")).groupBy("topic", "partition").agg(F.every("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))


@query(""" select event_id, cast(v->>'k' as bigint) as k from log""")
def json_decode(spark, sf):
    return json_schema.decoded(events(spark, sf).select("event_id", "v"), "v").select("event_id", "v.k")


@query(_with(n=NAMES) + """ select name, regexp_full_match(name, '[a-zA-Z0-9._-]{1,249}') and name not in ('.', '..') as ok from n""")
def topic_names(spark, sf):
    return relation(spark, *NAMES).select("name", scalar.topic_name_ok(F.col("name")).alias("ok"))


@query(_with(s=SETTINGS) + """, l as (select *, list_filter(string_split(coalesce(value, ''), ','), lambda x: x <> '') as own, list_filter(string_split(coalesce(change, ''), ','), lambda x: x <> '') as more from s)
select name, case operation when 'SET' then change when 'DELETE' then null when 'APPEND' then array_to_string(list_concat(own, list_filter(more, lambda x: not list_contains(own, x))), ',') when 'SUBTRACT' then array_to_string(list_filter(own, lambda x: not list_contains(more, x)), ',') end as value from l""")
def alter_settings(spark, sf):
    return relation(spark, *SETTINGS).select("name", scalar.altered(F.col("value"), F.col("operation"), F.col("change")).alias("value"))


@query(""", x as (select k, topic, count(*) as records, cast(sum(strlen(v)) as bigint) as bytes, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::double as seconds, min(value)::double as least, cast(sum(cast(value as decimal(18, 6))) as double) / count(value) as mean, max(value)::double as greatest from log group by all)
select *, records / greatest(seconds, 1.0) as records_per_s, bytes / greatest(seconds, 1.0) as bytes_per_s from x""")
def load_report(spark, sf):
    return metrics.load(events(spark, sf), ["k", "topic"], F.octet_length("v"), F.col("value"), F.col("ts"))


@query(""" select topic, "partition", offset_id, 0 as place, 'type' as hk, topic as hv from log union all select topic, "partition", offset_id, 1, 'user', k from log where offset_id % 3 = 0""")
def appended_headers(spark, sf):
    rows = events(spark, sf)
    first, second = F.struct(F.lit("type").alias("hk"), F.col("topic").alias("hv")), F.struct(F.lit("user").alias("hk"), F.col("k").alias("hv"))
    return log.headers_of(rows.withColumn("headers", F.when(F.col("offset_id") % 3 == 0, F.array(first, second)).otherwise(F.array(first))))


@query(""" select distinct topic || '/' || k as name, topic as base, k as "key" from log union select topic, topic, null from log""")
def virtual_topics(spark, sf):
    rows = events(spark, sf)
    names = rows.select(F.concat_ws("/", "topic", "k").alias("name")).union(rows.select("topic")).distinct()
    return names.select("name", scalar.split_virtual(F.col("name")).alias("s")).select("name", "s.base", "s.key")


@query(""", x as (select topic, "partition", offset_id, ts, floor(epoch_us(ts) / 600000000) as slot from log), y as (select *, row_number() over (partition by topic, "partition", slot order by offset_id) - 1 as n from x)
select topic, "partition", cast(slot as bigint) as slot, cast(n // 3 as bigint) as batch, min(offset_id) as base_offset, count(*) as records from y group by all""")
def produce_batching(spark, sf):
    rows = log.timed_batches(events(spark, sf), 600_000, 3)
    return rows.groupBy("topic", "partition", "slot", "batch").agg(F.min("offset_id").alias("base_offset"), F.count("*").alias("records"))
