"""Queries on transactions, appending, maintenance and the catalog whose relations are made from the event log, so that they grow with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.scalar import uuid5
from strandlog.operators import groups, lake, log, maintenance, produce, relations, transactions
from strandlog.sources.tables import EVENTS_SQL, events_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The event log with its producers, seven that take turns in every topition.
LOG_SQL = f"log as (select *, cast(k as bigint) % 7 as producer_id, 0 as epoch from ({EVENTS_SQL}))"
#: Runs of 50 offsets in which each producer's records are one transaction.
RUNS_SQL = """, runs as (select topic, "partition", producer_id, 0 as epoch, offset_id // 50 as run, min(offset_id) as offset_start, max(offset_id) as offset_end from log group by all),
txns as (select *, 't' || producer_id || '-' || run as txn, case when producer_id = 3 and run = max(run) over (partition by topic, "partition") then 'BEGIN' when (producer_id + run) % 4 = 0 then 'ABORTED' else 'COMMITTED' end as status from runs),
marks as (select topic, "partition", min(offset_id) as low, max(offset_id) + 1 as high from log group by all),
stable as (select topic, "partition", min(offset_start) as stable from txns where status = 'BEGIN' group by all)"""


def query(sql: str | None = None):
    """Register a function under its name; sql goes on after `with log as (...)`."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"with {LOG_SQL}{sql}"
        return f

    return put


def _log(spark, sf) -> tuple[DataFrame, DataFrame]:
    own = events_store(spark, sf)
    return own.log.withColumns({"producer_id": F.col("k").cast("long") % 7, "epoch": F.lit(0)}), own.marks


def _txns(rows: DataFrame) -> DataFrame:
    run = F.floor(F.col("offset_id") / 50)
    runs = rows.groupBy("topic", "partition", "producer_id", "epoch", run.alias("run")).agg(F.min("offset_id").alias("offset_start"), F.max("offset_id").alias("offset_end"))
    last = rows.groupBy("topic", "partition").agg(F.floor(F.max("offset_id") / 50).alias("last"))
    status = F.when((F.col("producer_id") == 3) & (F.col("run") == F.col("last")), "BEGIN").when((F.col("producer_id") + F.col("run")) % 4 == 0, "ABORTED").otherwise("COMMITTED")
    return runs.join(last, ["topic", "partition"]).withColumns({"txn": F.format_string("t%d-%d", "producer_id", "run"), "status": status}).drop("last")


@query(RUNS_SQL + """ select l.topic, l."partition", l.offset_id from log l join txns t on l.topic = t.topic and l."partition" = t."partition" and l.producer_id = t.producer_id and l.offset_id // 50 = t.run
left join stable s on l.topic = s.topic and l."partition" = s."partition" where t.status <> 'ABORTED' and (stable is null or l.offset_id < stable)""")
def read_committed(spark, sf):
    rows, marks = _log(spark, sf)
    return transactions.read_committed(rows, marks, _txns(rows)).select("topic", "partition", "offset_id")


@query(RUNS_SQL + ' select topic, "partition", offset_id from log left join stable using (topic, "partition") where stable is null or offset_id < stable')
def read_committed_compat(spark, sf):
    rows, marks = _log(spark, sf)
    return transactions.read_committed(rows, marks, _txns(rows), hide_aborted=False).select("topic", "partition", "offset_id")


@query(RUNS_SQL + """ select m.topic, m."partition", coalesce(stable, high) as offset_id, l.ts from marks m left join stable s on m.topic = s.topic and m."partition" = s."partition"
left join log l on l.topic = m.topic and l."partition" = m."partition" and l.offset_id = case when stable < high then stable else high - 1 end""")
def list_offsets_committed(spark, sf):
    rows, marks = _log(spark, sf)
    return log.list_offsets(rows, marks, log.LATEST, transactions.stable_offsets(marks, _txns(rows)))


@query(""" select topic, "partition", max(offset_id) + 1 as offset_id, arg_max(ts, offset_id) as ts from log group by all""")
def list_offsets_uncommitted(spark, sf):
    return log.list_offsets(*_log(spark, sf), log.LATEST)


@query(""", m as (select max(ts) as now from log), g as (select topic, "partition", max(offset_id) + 1 as high, max(ts) as last from log group by all)
select topic, "partition", high as offset_id, case when last >= now - interval 1 day then last end as ts from (select g.topic, g."partition", high, now, (select arg_max(ts, offset_id) from log l where l.topic = g.topic and l."partition" = g."partition") as last from g, m)""")
def latest_after_retention(spark, sf):
    """The latest offsets once all that is older than a day before the last record is deleted, whole topitions included."""
    rows, marks = _log(spark, sf)
    kept = maintenance.retain(rows, F.lit(rows.agg(F.max("ts")).first()[0]), 86_400_000, prefix=False)
    return log.list_offsets(kept, maintenance.low_after(marks, kept), log.LATEST)


@query(""", n as (select max(ts) + interval 30 day as now from log) select topic, "partition", max(offset_id) + 1 as offset_id, cast(null as timestamp) as ts, max(offset_id) + 1 as low from log group by all""")
def latest_of_an_empty_log(spark, sf):
    rows, marks = _log(spark, sf)
    kept = maintenance.retain(rows, F.expr(f"timestamp '{rows.agg(F.max('ts')).first()[0]}' + interval 30 day"))
    left = maintenance.low_after(marks, kept)
    return log.list_offsets(kept, left, log.LATEST).join(left.select("topic", "partition", "low"), ["topic", "partition"])


@query(""" select distinct topic, "partition", cast(0 as bigint) as offset_id, cast(null as timestamp) as ts from log""")
def latest_of_an_empty_log_compat(spark, sf):
    """As engines that look the last record up report it."""
    rows, marks = _log(spark, sf)
    return log.list_offsets(rows.where("false"), marks, log.LATEST, compat=True)


@query(""", head as (select distinct topic, "partition", k from log where topic = 'click' and offset_id % 3 = 0), d as (select * from log anti join head using (topic, "partition", k))
select topic, "partition", offset_id, k from d qualify offset_id = max(offset_id) over (partition by topic, "partition", k)""")
def compaction_below_head(spark, sf):
    """Keys that come again in one topic's head don't touch those of another."""
    rows, _ = _log(spark, sf)
    return maintenance.compact(rows, head=rows.where("topic = 'click' and offset_id % 3 = 0")).select("topic", "partition", "offset_id", "k")


@query(""", n as (select max(ts) as now from log), b as (select topic, "partition", offset_id // 25 as batch, max(ts) as ts, min(offset_id) as base from log group by all),
f as (select topic, "partition", min(base) as first from b, n where epoch_us(now) - epoch_us(ts) <= 86400000000 group by all) select topic, "partition", offset_id from log join f using (topic, "partition") where offset_id >= first""")
def retention_of_batches(spark, sf):
    rows, _ = _log(spark, sf)
    rows = rows.withColumn("batch", F.floor(F.col("offset_id") / 25))
    return maintenance.retain_batches(rows, "batch", F.lit(rows.agg(F.max("ts")).first()[0]), 86_400_000).select("topic", "partition", "offset_id")


_KEPT = """, a as (select *, case when offset_id % 11 = 0 then 32 else 0 end as attributes, case when offset_id % 5 = 0 then null else k end as key from log),
kept as (select * from a qualify attributes = 32 or key is null or offset_id = max(case when attributes = 0 and key is not null then offset_id end) over (partition by topic, "partition", key))"""


def _controls(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"attributes": F.when(F.col("offset_id") % 11 == 0, 32).otherwise(0), "k": F.when(F.col("offset_id") % 5 != 0, F.col("k")), "batch": F.floor(F.col("offset_id") / 20)})


@query(_KEPT + """ select topic, "partition", offset_id // 20 as batch, min(offset_id) as base_offset, count(*) as records from kept group by all""")
def batch_compaction(spark, sf):
    rows, marks = _log(spark, sf)
    return maintenance.compacted_batches(_controls(rows), marks, "batch")[1]


@query(_KEPT + """ select topic, "partition", min(offset_id) as low, (select max(offset_id) + 1 from log l where l.topic = kept.topic and l."partition" = kept."partition") as high from kept group by all""")
def batch_compaction_marks(spark, sf):
    rows, marks = _log(spark, sf)
    return maintenance.compacted_batches(_controls(rows), marks, "batch")[2]


@query(""" select distinct topic, "partition", k from log""")
def distinct_keys(spark, sf):
    return maintenance.distinct_keys(_log(spark, sf)[0])


@query(""", m as (select max(ts) as now from log), n as (select k, ts, coalesce(lead(ts) over (partition by k order by ts), (select now from m)) as next from log)
select k, ts, cast(floor(epoch_us(next) / 1e6) - floor(epoch_us(ts) / 1e6) as bigint) as silent_s from n where floor(epoch_us(next) / 1e6) - floor(epoch_us(ts) / 1e6) > 45""")
def session_eviction(spark, sf):
    """Members (keys) that are silent for over 45 s, those that never come back included."""
    rows, _ = _log(spark, sf)
    return groups.evicted(rows.select("k", "ts"), 45, ["k"], F.lit(rows.agg(F.max("ts")).first()[0]))


@query(""", j as (select k as group_id, topic as instance, ts from log where event_id % 2 = 0), b as (select k as group_id, topic as instance, ts as beat from log where event_id % 2 = 1),
r as (select j.group_id, j.instance, j.ts, max(b.beat) as beat from j left join b on j.group_id = b.group_id and j.instance = b.instance and b.beat <= j.ts group by all)
select *, coalesce(epoch_us(ts) - epoch_us(beat) <= 3600000000, false) as kept from r""")
def static_members(spark, sf):
    rows = _log(spark, sf)[0].select(F.col("k").alias("group_id"), F.col("topic").alias("instance"), "ts", "event_id")
    return groups.paused(rows.where("event_id % 2 = 1"), rows.where("event_id % 2 = 0").select("group_id", "instance", "ts"), 3600)


#: What a producer sends: its records in runs of up to three, every 13th run again and, after every 17th, one from further on.
_SENT = """, r as (select topic, "partition", producer_id, event_id, row_number() over (partition by topic, "partition", producer_id order by offset_id) - 1 as n from log),
b as (select topic, "partition", producer_id, n // 3 as run, count(*) as records from r group by all),
s as (select topic, "partition", producer_id, producer_id % 3 as epoch, run * 3 as arrival, run * 3 as base_sequence, records, 'NONE' as verdict from b
union all select topic, "partition", producer_id, producer_id % 3, run * 3 + 1, run * 3, records, 'DUPLICATE_SEQUENCE_NUMBER' from b where run % 13 = 0
union all select topic, "partition", producer_id, producer_id % 3, run * 3 + 2, run * 3 + 1000000, records, 'OUT_OF_ORDER_SEQUENCE_NUMBER' from b where run % 17 = 0)"""


def _sent(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("topic", "partition", "producer_id").orderBy("offset_id")) - 1
    runs = rows.select("topic", "partition", "producer_id", F.floor(n / 3).alias("run")).groupBy("topic", "partition", "producer_id", "run").agg(F.count("*").alias("records"))
    base = F.col("run") * 3
    def part(cond: str, more: int, skip: int) -> DataFrame:
        return runs.where(cond).select("topic", "partition", "producer_id", (F.col("producer_id") % 3).cast("int").alias("epoch"), (base + more).alias("arrival"), (base + skip).alias("base_sequence"), "records")

    return part("true", 0, 0).unionByName(part("run % 13 = 0", 1, 0)).unionByName(part("run % 17 = 0", 2, 1_000_000))


@query(_SENT + """ select topic, "partition", producer_id, epoch, arrival, base_sequence, records,
case when producer_id = 6 then 'UNKNOWN_PRODUCER_ID' when producer_id = 5 then 'PRODUCER_FENCED' when producer_id = 4 then 'INVALID_PRODUCER_EPOCH' else verdict end as verdict from s""")
def idempotence(spark, sf):
    rows, _ = _log(spark, sf)
    known = spark.range(6).select(F.col("id").alias("producer_id"), (F.col("id") % 3 + F.when(F.col("id") == 5, 1).when(F.col("id") == 4, -1).otherwise(0)).cast("int").alias("epoch"))
    return transactions.sequence_check(_sent(rows), known)


#: A coordinator's relations: a transaction for every second key, whose producer has had 1 to 3 epochs, the last one open for every fourth key.
_COORDINATOR = """, u as (select distinct cast(k as bigint) as u from log),
producers as (select u as producer_id, cast(e as integer) as epoch from u, range(3) r(e) where e <= u % 3 and u % 2 = 0),
txns as (select 't' || producer_id as txn, producer_id, epoch, case when epoch = producer_id % 3 and producer_id % 4 = 0 then 'BEGIN' else 'COMMITTED' end as status, cast(null as timestamp) as started_at from producers),
asked as (select u as request, case when u % 5 = 4 then null when u % 2 = 1 then 'n' || u % 10 else 't' || u end as txn from u)"""


def _coordinator(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    users = rows.select(F.col("k").cast("long").alias("u")).distinct()
    epochs = users.where("u % 2 = 0").select(F.col("u").alias("producer_id"), F.explode(F.sequence(F.lit(0), (F.col("u") % 3).cast("int"))).alias("epoch"))
    status = F.when((F.col("epoch") == F.col("producer_id") % 3) & (F.col("producer_id") % 4 == 0), "BEGIN").otherwise("COMMITTED")
    txns = epochs.select(F.format_string("t%d", "producer_id").alias("txn"), "producer_id", "epoch", status.alias("status"), F.lit(None).cast("timestamp").alias("started_at"))
    name = F.when(F.col("u") % 5 == 4, F.lit(None)).when(F.col("u") % 2 == 1, F.concat(F.lit("n"), (F.col("u") % 10).cast("string"))).otherwise(F.format_string("t%d", "u"))
    return epochs, txns, users.select(F.col("u").alias("request"), name.alias("txn"))


@query(_COORDINATOR + """, known as (select txn, max(producer_id) as producer_id, max(epoch) + 1 as epoch from txns group by txn),
fresh as (select coalesce(a.txn, '?' || request) as name, min(request) as first from asked a anti join known k on a.txn = k.txn group by 1),
new as (select name, (select max(producer_id) from producers) + row_number() over (order by first) as producer_id from fresh)
select request, a.txn, coalesce(k.producer_id, n.producer_id) as producer_id, cast(coalesce(k.epoch, 0) as integer) as epoch from asked a left join known k on a.txn = k.txn left join new n on n.name = coalesce(a.txn, '?' || request)""")
def init_producers(spark, sf):
    producers, txns, asked = _coordinator(_log(spark, sf)[0])
    return transactions.init_producers(producers, txns, asked)[0]


@query(_COORDINATOR + """, again as (select distinct txn from asked where txn in (select txn from txns))
select txn, producer_id, epoch, case when status = 'BEGIN' and txn in (select txn from again) then 'ABORTED' else status end as status from txns
union all select txn, max(producer_id), cast(max(epoch) + 1 as integer), null from txns where txn in (select txn from again) group by txn
union all select * from (with known as (select distinct txn from txns), fresh as (select coalesce(a.txn, '?' || request) as name, any_value(a.txn) as txn, min(request) as first from asked a anti join known k on a.txn = k.txn group by 1)
select txn, (select max(producer_id) from producers) + row_number() over (order by first) as producer_id, 0 as epoch, null as status from fresh) where txn is not null""")
def transactions_after_init(spark, sf):
    producers, txns, asked = _coordinator(_log(spark, sf)[0])
    return transactions.init_producers(producers, txns, asked)[2].drop("started_at")


#: Requests of each key's producer for the topitions that it wrote to, in its last epoch but for every seventh key.
_ADDED = _COORDINATOR + """, req as (select distinct 't' || k as txn, cast(k as bigint) as producer_id, cast(case when cast(k as bigint) % 7 = 0 then 9 else cast(k as bigint) % 3 end as integer) as epoch, topic, "partition" from log),
said as (select r.*, case when p.producer_id is null then 'UNKNOWN_PRODUCER_ID' when p.epoch <> r.epoch then 'INVALID_PRODUCER_EPOCH' else 'NONE' end as verdict from req r left join (select producer_id, max(epoch) as epoch from producers group by 1) p using (producer_id))"""


def _requests(rows: DataFrame) -> DataFrame:
    u = F.col("k").cast("long")
    return rows.select(F.concat(F.lit("t"), "k").alias("txn"), u.alias("producer_id"), F.when(u % 7 == 0, 9).otherwise(u % 3).cast("int").alias("epoch"), "topic", "partition").distinct()


def _no_ranges(rows: DataFrame) -> DataFrame:
    return rows.limit(0).select(F.lit("").alias("txn"), "producer_id", F.lit(0).alias("epoch"), "topic", "partition", F.col("offset_id").alias("offset_start"), F.col("offset_id").alias("offset_end"))


@query(_ADDED + " select * from said")
def add_partitions(spark, sf):
    rows, _ = _log(spark, sf)
    producers, txns, _ = _coordinator(rows)
    return transactions.add_partitions(producers, txns, _no_ranges(rows), _requests(rows), F.lit(None).cast("timestamp"))[0]


@query(_ADDED + """ select t.txn, t.producer_id, t.epoch, t.status, case when exists (select 1 from said s where s.verdict = 'NONE' and s.txn = t.txn and s.epoch = t.epoch) then timestamp '2024-01-01 00:00:00' end as started_at from txns t""")
def transactions_begun(spark, sf):
    rows, _ = _log(spark, sf)
    producers, txns, _ = _coordinator(rows)
    return transactions.add_partitions(producers, txns, _no_ranges(rows), _requests(rows), F.expr("timestamp '2024-01-01 00:00:00'"))[1]


#: What each accepted transaction wrote, and the topitions' ends.
_WROTE = _ADDED + """, w as (select s.txn, s.producer_id, s.epoch, s.topic, s."partition", min(offset_id) as offset_start, max(offset_id) as offset_end from said s join log l on l.topic = s.topic and l."partition" = s."partition" and l.k = cast(s.producer_id as varchar) where verdict = 'NONE' group by all),
marks as (select topic, "partition", max(offset_id) + 1 as high from log group by all), ended as (select distinct txn, producer_id, epoch, case when producer_id % 4 = 0 then 'COMMITTED' else 'ABORTED' end as status from w)"""


def _written(spark, sf):
    rows, marks = _log(spark, sf)
    producers, txns, _ = _coordinator(rows)
    verdicts, txns, ranges = transactions.add_partitions(producers, txns, _no_ranges(rows), _requests(rows), F.lit(None).cast("timestamp"))
    own = rows.select(F.concat(F.lit("t"), "k").alias("txn"), F.col("k").cast("long").alias("producer_id"), "topic", "partition", "offset_id").join(ranges.drop("offset_start", "offset_end"), ["txn", "producer_id", "topic", "partition"])
    wrote = own.groupBy("txn", "producer_id", "epoch", "topic", "partition").agg(F.min("offset_id").alias("offset_start"), F.max("offset_id").alias("offset_end"))
    ranges = transactions.produced(ranges, wrote)
    ended = ranges.select("txn", "producer_id", "epoch").distinct().withColumn("status", F.when(F.col("producer_id") % 4 == 0, "COMMITTED").otherwise("ABORTED"))
    return rows, marks, producers, ranges, ended


@query(_WROTE + " select * from w")
def produced_ranges(spark, sf):
    return _written(spark, sf)[3]


@query(_WROTE + """ select w.topic, w."partition", high + row_number() over (partition by w.topic, w."partition" order by w.producer_id, w.epoch) - 1 as offset_id, w.producer_id, w.epoch, 32 as attributes, case status when 'COMMITTED' then 1 else 0 end as marker
from w join ended e using (txn, producer_id, epoch) join marks m on m.topic = w.topic and m."partition" = w."partition" """)
def end_markers(spark, sf):
    _, marks, _, ranges, ended = _written(spark, sf)
    return transactions.markers(ended, ranges, ended, marks, F.current_timestamp()).drop("ts")


_PENDING = _WROTE + """, stored as (select 'g' || cast(k as bigint) % 5 as group_id, topic, "partition", cast(0 as bigint) as committed from log group by all),
offered as (select s.txn, s.producer_id, s.epoch, 'g' || s.producer_id % 3 as group_id, s.topic, s."partition", s.producer_id * 10 as committed, verdict from said s)"""


def _offered(spark, sf):
    rows, _, producers, _, ended = _written(spark, sf)
    requests = _requests(rows).withColumns({"group_id": F.concat(F.lit("g"), (F.col("producer_id") % 3).cast("string")), "committed": F.col("producer_id") * 10})
    none = requests.limit(0)
    stored = rows.select(F.concat(F.lit("g"), (F.col("k").cast("long") % 5).cast("string")).alias("group_id"), "topic", "partition", F.lit(0).cast("long").alias("committed")).distinct()
    return stored, ended, transactions.commit_offsets(producers, none, requests)


@query(_PENDING + " select * from offered")
def transaction_offsets(spark, sf):
    return _offered(spark, sf)[2][0]


@query(_PENDING + """, new as (select group_id, o.topic, o."partition", max(o.committed) as committed from offered o join ended e using (txn, producer_id, epoch) where verdict = 'NONE' and status = 'COMMITTED' and epoch = (select max(epoch) from offered x join ended y using (txn, producer_id, epoch) where x.verdict = 'NONE' and y.status = 'COMMITTED' and x.group_id = o.group_id and x.topic = o.topic and x."partition" = o."partition") group by all)
select * from new union all select * from stored s where not exists (select 1 from new n where n.group_id = s.group_id and n.topic = s.topic and n."partition" = s."partition")""")
def offsets_after_commit(spark, sf):
    stored, ended, (_, pending) = _offered(spark, sf)
    return transactions.applied(stored, ended, pending)[0]


#: Requests of 5 records of a topition each; topics have options, click a schema that values below 3 fail, view none of its own log.
CONFIG = [("click", "schema.validation", "true"), ("view", "lake.sink", "true"), ("view", "message.timestamp.type", "LogAppendTime"), ("signup", "schema.validation", "false"), ("error", "batch", "true"), ("error", "batch.timeout_ms", "2000"), ("purchase", "batch", "true"), ("purchase", "batch.max_records", "7"), ("click", "lake.generate.day", "cast(ts as date)")]
SCHEMAS = {t: (None, {"type": "object", "properties": {"k": {"type": "integer", "minimum": 3}}}) for t in ("click", "signup")} | {"view": (None, {"type": "object"})}
_REQUESTS = """, r as (select *, offset_id // 5 as n, topic || '/' || "partition" || '/' || (offset_id // 5) as batch, case when offset_id % 23 = 0 then 32 else 0 end as attributes, (offset_id // 5) % 4 = 0 as plain from log),
v as (select batch, topic, "partition", n, bool_and(topic <> 'click' or attributes = 32 or cast(v->>'k' as bigint) >= 3) as ok, any_value(plain) as plain, count(*) as records from r group by all),
s as (select *, sum(case when plain or not ok then 0 else records end) over (partition by topic, "partition" order by n rows between unbounded preceding and 1 preceding) as before from v),
b as (select *, case when plain then case when ok then 'NONE' else 'INVALID_RECORD' end when not ok then 'INVALID_RECORD' else 'NONE' end as verdict from s),
t as (select r.*, row_number() over (partition by r.topic, r."partition" order by offset_id) - 1 + 1000 as new_id from r join b using (batch) where verdict = 'NONE')"""


def _produced(spark, sf) -> produce.Produced:
    from pyspark.sql import Window

    rows, _ = _log(spark, sf)
    n = F.floor(F.col("offset_id") / 5)
    rows = rows.withColumns({"n": n, "batch": F.concat_ws("/", "topic", "partition", n), "attributes": F.when(F.col("offset_id") % 23 == 0, 32).otherwise(0)})
    # every fourth request has no producer; the others' sequences go on from the valid ones before
    ok = F.every((F.col("topic") != "click") | (F.col("attributes") == 32) | (F.get_json_object("v", "$.k").cast("long") >= 3))
    sizes = rows.groupBy("topic", "partition", "n").agg(F.count("*").alias("own"), ok.alias("ok"))
    before = Window.partitionBy("topic", "partition").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.when((F.col("n") % 4 == 0) | ~F.col("ok"), 0).otherwise(F.col("own"))).over(before), F.lit(0))
    rows = rows.join(sizes.select("topic", "partition", "n", base.alias("base_sequence")), ["topic", "partition", "n"])
    plain = F.col("n") % 4 == 0
    rows = rows.select("batch", F.col("n").alias("arrival"), F.col("offset_id").alias("place"), "topic", "partition", F.when(~plain, F.lit(1)).cast("long").alias("producer_id"), F.when(~plain, F.lit(0)).alias("epoch"), F.when(~plain, F.col("base_sequence")).alias("base_sequence"), "attributes", "ts", "k", "v")
    marks = rows.select("topic", "partition", F.lit(0).cast("long").alias("low"), F.lit(1000).cast("long").alias("high")).distinct()
    config = spark.createDataFrame(CONFIG, "topic string, name string, value string")
    known = spark.createDataFrame([(1, 0)], "producer_id long, epoch int")
    return produce.produce(rows, marks, known, produce.options(config, marks), SCHEMAS, F.expr("timestamp '2030-01-01 00:00:00'"))


@query(_REQUESTS + " select batch, verdict from b")
def produce_verdicts(spark, sf):
    return _produced(spark, sf).verdicts


@query(_REQUESTS + """ select topic, "partition", new_id as offset_id, ts, k, v, case when not plain then 1::bigint end as producer_id, case when not plain then 0 end as epoch, attributes from t where topic <> 'view'""")
def produce_log(spark, sf):
    return _produced(spark, sf).log


@query(_REQUESTS + """ select topic, "partition", new_id as offset_id, case when topic = 'view' then timestamp '2030-01-01 00:00:00' else ts end as ts, k, v from t where attributes = 0 and topic in ('click', 'signup', 'view')""")
def produce_lake(spark, sf):
    return _produced(spark, sf).lake.select("topic", "partition", "offset_id", "ts", "k", "v")


@query(_REQUESTS + """ select l.topic, l."partition", cast(0 as bigint) as low, coalesce(max(new_id) + 1, 1000) as high from (select distinct topic, "partition" from log) l left join t on t.topic = l.topic and t."partition" = l."partition" group by all""")
def produce_marks(spark, sf):
    return _produced(spark, sf).marks


@query(""", c(topic, name, value) as (values """ + ", ".join(f"('{t}', '{n}', '{v}')" for t, n, v in CONFIG) + """), t as (select distinct topic from log)
select t.topic, """ + ", ".join(f"coalesce(max(case when name = '{n}' then value end), '{v}') as {n.replace('.', '_')}" for n, v in produce.OPTIONS.items()) + " from t left join c using (topic) group by all")
def topic_options(spark, sf):
    return produce.options(spark.createDataFrame(CONFIG, "topic string, name string, value string"), _log(spark, sf)[1])


@query(""" select cast(2000 as bigint) as timeout_ms, cast(7 as bigint) as max_records from (select distinct topic from log where topic in ('error', 'purchase')) having count(*) = 2""")
def batch_options(spark, sf):
    return produce.batching(produce.options(spark.createDataFrame(CONFIG, "topic string, name string, value string"), _log(spark, sf)[1]))


@query(""", p as (select *, offset_id // 4 as request, offset_id % 4 as place from log), x as (select topic, "partition", producer_id, offset_id // 40 as batch, row_number() over (partition by topic, "partition", producer_id, offset_id // 40 order by request, place) - 1 as delta, event_id, ts from p)
select topic, "partition", producer_id, batch, count(*) as n, max(ts) as max_ts, string_agg(cast(event_id as varchar), ',' order by delta) as event_ids from x group by all""")
def combined_batches(spark, sf):
    rows = _log(spark, sf)[0].withColumn("batch", F.floor(F.col("offset_id") / 40))
    same = ["topic", "partition", "producer_id", "batch"]
    requests = rows.groupBy(*same, F.floor(F.col("offset_id") / 4).alias("arrival")).agg(F.sort_array(F.collect_list(F.struct("offset_id", "event_id"))).alias("r"), F.max("ts").alias("max_ts"))
    out = log.combined(requests.withColumn("records", F.col("r.event_id")), same)
    return out.select(*same, "n", "max_ts", F.array_join(F.transform("records.record", lambda x: x.cast("string")), ",").alias("event_ids"))


@query()
def flushed_queues(spark, sf):
    """Requests queued for each topition and producer, flushed past 60 bytes or after an hour; each depends on the one before, so no SQL: tests follow them one by one."""
    rows = _log(spark, sf)[0].select("topic", "partition", "producer_id", F.col("offset_id").alias("arrival"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), log.byte_size("k", "v").alias("size"))
    return log.flushes(rows, 60, 3_600_000, ["topic", "partition", "producer_id"])


#: A catalog of the log's own topics, with a group for each key modulo 9.
def _catalog(spark, sf) -> dict[str, DataFrame]:
    rows, marks = _log(spark, sf)
    zero = F.lit(0).cast("long")
    user = F.col("k").cast("long")
    held = rows.select(F.concat(F.lit("g"), (user % 9).cast("string")).alias("group_id"), "topic", "partition").distinct()
    return {
        "topic": marks.groupBy("topic").agg(F.count("*").cast("int").alias("partitions")).withColumn("replication_factor", F.lit(1)),
        "topition": marks.select("topic", "partition"),
        "watermark": marks,
        "topic_configuration": spark.createDataFrame([(t, n, v) for t, n, v in CONFIG], "topic string, name string, value string"),
        "consumer_offset": held.withColumn("committed", zero),
        "consumer_group_detail": held.select("group_id").distinct().withColumns({"e_tag": F.concat(F.lit("e"), "group_id"), "detail": F.lit("{}"), "members": (F.expr("cast(substr(group_id, 2) as int)") % 3)}),
    }


_CATALOG = """, topition as (select distinct topic, "partition" from log), topic as (select topic, cast(count(*) as integer) as partitions from topition group by 1), offsets as (select distinct 'g' || cast(k as bigint) % 9 as group_id, topic, "partition" from log)"""


def _wanted(spark):
    return spark.createDataFrame([("orders", 3, 1, {"a": "b"}), ("orders", 2, 1, None), ("click", 1, 1, None), ("bad name", 1, 1, None), ("none", 0, 1, None), (None, 1, 1, None), ("ünder", 1, 1, None)], "topic string, partitions int, replication_factor int, configs map<string, string>")


@query(_CATALOG + """, w(topic, partitions) as (values ('orders', 3), ('click', 1), ('bad name', 1), ('none', 0), (null, 1), ('ünder', 1))
select w.topic, case when w.topic is null or not regexp_full_match(w.topic, '[a-zA-Z0-9._-]{1,249}') then 'INVALID_TOPIC_EXCEPTION' when t.topic is not null then 'TOPIC_ALREADY_EXISTS' when w.partitions < 1 then 'INVALID_PARTITIONS' else 'NONE' end as verdict from w left join topic t using (topic)""")
def create_topics(spark, sf):
    return relations.create_topics(_catalog(spark, sf), _wanted(spark))[0]


@query(_CATALOG + """ select topic, "partition", low, high from (select topic, "partition", min(offset_id) as low, max(offset_id) + 1 as high from log group by all) union all select 'orders', cast(p as integer), 0, 0 from range(3) r(p)""")
def watermarks_after_create(spark, sf):
    return relations.create_topics(_catalog(spark, sf), _wanted(spark))[1]["watermark"]


@query(_CATALOG + """ select topic, coalesce((select 'NONE' from topic t where t.topic = n.topic), 'UNKNOWN_TOPIC_OR_PARTITION') as verdict from (values ('click'), ('nope')) n(topic)""")
def delete_topics(spark, sf):
    return relations.delete_topics(_catalog(spark, sf), spark.createDataFrame([("click",), ("nope",), ("click",)], "topic string"))[0]


@query(_CATALOG + """ select 'topition' as relation, count(*) as n from topition where topic <> 'click' union all select 'watermark', count(*) from topition where topic <> 'click' union all select 'consumer_offset', count(*) from offsets where topic <> 'click'
union all select 'topic', count(*) from topic where topic <> 'click' union all select 'topic_configuration', 7 union all select 'consumer_group_detail', count(distinct group_id) from offsets""")
def relations_after_delete(spark, sf):
    left = relations.delete_topics(_catalog(spark, sf), spark.createDataFrame([("click",), ("nope",)], "topic string"))[1]
    out = None
    for name, rows in left.items():
        own = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = own if out is None else out.unionByName(own)
    return out


@query(_CATALOG + """, n(group_id) as (values ('g0'), ('g1'), ('g3'), ('g77')) select group_id, case when group_id not in (select group_id from offsets) then 'GROUP_ID_NOT_FOUND' when cast(substr(group_id, 2) as integer) % 3 > 0 then 'NON_EMPTY_GROUP' else 'NONE' end as verdict from n""")
def delete_groups(spark, sf):
    return relations.delete_groups(_catalog(spark, sf), spark.createDataFrame([(g,) for g in ("g0", "g1", "g3", "g77")], "group_id string"))[0]


@query(_CATALOG + """ select group_id, count(*) as n from offsets where group_id not in ('g0', 'g3') group by all""")
def offsets_after_delete(spark, sf):
    left = relations.delete_groups(_catalog(spark, sf), spark.createDataFrame([(g,) for g in ("g0", "g1", "g3", "g77")], "group_id string"))[1]
    return left["consumer_offset"].groupBy("group_id").agg(F.count("*").alias("n"))


@query(RUNS_SQL + """ select topic, "partition", count(*) as n from txns where not (producer_id = 2 and run % 2 = 0) group by all""")
def delete_transactions(spark, sf):
    rows, _ = _log(spark, sf)
    own = _txns(rows)
    gone = own.where("producer_id = 2 and run % 2 = 0").select("txn", "producer_id", "epoch")
    left = relations.delete_transactions({"ranges": own, "txns": own}, gone)
    return left["ranges"].groupBy("topic", "partition").agg(F.count("*").alias("n"))


@query(""" select topic, name, value from (values """ + ", ".join(f"('{t}', '{n}', '{v}')" for t, n, v in CONFIG if (t, n) != ("view", "lake.sink")) + ") c(topic, name, value) where (select count(*) from log) >= 0")
def delete_setting(spark, sf):
    gone = spark.createDataFrame([("view", "lake.sink"), ("view", "nope")], "topic string, name string")
    return relations.delete_setting(_catalog(spark, sf), gone)["topic_configuration"]


#: Two proposals for each second event of a group: each expects the tag of the group, an old one or none.
_PROPOSALS = """, stored as (select distinct k as group_id, 'e' || k as e_tag, 'd' || k as detail from log where cast(k as bigint) % 4 <> 0),
p as (select k as group_id, event_id as seq, case event_id % 3 when 0 then 'e' || k when 1 then null else 'old' end as expected, 'n' || event_id as new_tag, 'v' || event_id as detail from log where event_id % 2 = 0),
f as (select p.*, s.e_tag, s.detail as now from p left join stored s using (group_id)), w as (select group_id, min(seq) as seq from f where expected is not distinct from e_tag group by 1)"""


def _proposals(spark, sf):
    rows, _ = _log(spark, sf)
    stored = rows.where("cast(k as long) % 4 <> 0").select(F.col("k").alias("group_id"), F.concat(F.lit("e"), "k").alias("e_tag"), F.concat(F.lit("d"), "k").alias("detail")).distinct()
    asked = rows.where("event_id % 2 = 0").select(F.col("k").alias("group_id"), F.col("event_id").alias("seq"), F.expr("case event_id % 3 when 0 then 'e' || k when 1 then null else 'old' end").alias("expected"), F.expr("'n' || event_id").alias("new_tag"), F.expr("'v' || event_id").alias("detail"))
    return relations.compare_and_set(stored, asked)


@query(_PROPOSALS + """ select f.group_id, f.seq, case when f.seq = w.seq then 'OK' else 'OUTDATED' end as answer, coalesce(x.new_tag, f.e_tag) as current_tag, coalesce(x.detail, f.now) as current from f left join w using (group_id) left join f x on x.group_id = w.group_id and x.seq = w.seq""")
def compare_and_set(spark, sf):
    return _proposals(spark, sf)[0]


@query(_PROPOSALS + """ select group_id, new_tag as e_tag, detail from f join w using (group_id, seq) union all select * from stored where group_id not in (select group_id from w)""")
def groups_after_set(spark, sf):
    return _proposals(spark, sf)[1]


@query(_CATALOG + """, n(topic) as (values ('click'), ('fresh'), ('a b'), ('.')) select n.topic, case when n.topic in ('a b', '.') then 'INVALID_TOPIC_EXCEPTION' else 'NONE' end as verdict, case when n.topic = 'fresh' then 4 else t.partitions end as partitions from n left join topic t using (topic)""")
def metadata_creates(spark, sf):
    return relations.metadata(_catalog(spark, sf), spark.createDataFrame([("click",), ("fresh",), ("a b",), (".",)], "topic string"))[0]


@query(_CATALOG + """, c(topic, name, value) as (values """ + ", ".join(f"('{t}', '{n}', '{v}')" for t, n, v in CONFIG) + """)
select topic, 'NONE' as verdict, name, value from c where topic = 'click' and exists (select 1 from topic t where t.topic = 'click') union all select 'view', 'NONE', n, (select value from c where topic = 'view' and name = n) from (values ('lake.sink'), ('nope')) x(n)
union all select 'gone', 'UNKNOWN_TOPIC_OR_PARTITION', null, null""")
def describe_configs(spark, sf):
    asked = spark.createDataFrame([("click", None), ("view", ["lake.sink", "nope"]), ("gone", None)], "topic string, names array<string>")
    return relations.describe_configs(_catalog(spark, sf), asked)


@query(""", b as (select distinct "partition" + 100 as node from log) select 'main' as cluster, node, 'h' || node as host, 9000 + node as port, node = min(node) over () as controller from b""")
def describe_cluster(spark, sf):
    return relations.describe_cluster(_brokers(_log(spark, sf)[1]), "main")


def _brokers(marks: DataFrame) -> DataFrame:
    node = (F.col("partition") + 100).alias("node")
    return marks.select(node).distinct().select("node", F.concat(F.lit("h"), "node").alias("host"), (F.col("node") + 9000).alias("port"))


@query()
def find_coordinators(spark, sf):
    """No SQL has the checksum that deals groups to brokers; tests follow it."""
    rows, marks = _log(spark, sf)
    return relations.find_coordinator(_brokers(marks), rows.select(F.col("k").alias("key")).distinct())


_STATES = _CATALOG + """, g as (select distinct group_id from offsets), s as (select group_id, case cast(substr(group_id, 2) as integer) % 3 when 0 then 'Empty' when 1 then 'Stable' else 'PreparingRebalance' end as state from g)"""


def _states(spark, sf) -> DataFrame:
    held = _catalog(spark, sf)["consumer_group_detail"].select("group_id", "members")
    return groups.states(held.withColumn("formed", F.col("members") == 1))


@query(_STATES + " select group_id, state from s where state in ('Empty', 'Stable')")
def list_groups(spark, sf):
    return relations.list_groups(_states(spark, sf), ["Empty", "Stable"])


@query(_STATES + """ select n.group_id, case when s.group_id is null then 'GROUP_ID_NOT_FOUND' else 'NONE' end as verdict, coalesce(state, 'Dead') as state,
coalesce((select string_agg(distinct l.k, ',' order by l.k) from log l where 'g' || cast(l.k as bigint) % 9 = s.group_id), '') as members from (values ('g1'), ('g2'), ('nope')) n(group_id) left join s using (group_id)""")
def describe_groups(spark, sf):
    rows, _ = _log(spark, sf)
    members = rows.select(F.concat(F.lit("g"), (F.col("k").cast("long") % 9).cast("string")).alias("group_id"), F.col("k").alias("member")).distinct()
    out = relations.describe_groups(_states(spark, sf), members, spark.createDataFrame([("g1",), ("g2",), ("nope",)], "group_id string"))
    return out.withColumn("members", F.array_join("members", ","))


@query(""" select distinct 'u-' || topic as uuid, topic as name from log union all select distinct cast(null as varchar), topic || '/' || k from log""")
def topic_names_by_id(spark, sf):
    """Ids of virtual topics are checked against the library's in tests; here only their names are."""
    rows, _ = _log(spark, sf)
    out = relations.topic_ids(rows.select("topic", F.concat(F.lit("u-"), "topic").alias("uuid")), rows.select("topic", F.col("k").alias("key")).distinct(), uuid5)
    return out.select(F.when(F.col("uuid").startswith("u-"), F.col("uuid")).alias("uuid"), "name")


@query(""", m as (select *, case when offset_id % 9 = 0 then 32 else 0 end as attributes from log) select topic, count(*) as n from m where attributes = 0 and topic in ('click', 'view') group by all""")
def reaches_the_lake(spark, sf):
    rows = _log(spark, sf)[0].withColumn("attributes", F.when(F.col("offset_id") % 9 == 0, 32).otherwise(0))
    return lake.for_lake(rows, ["click", "view"]).groupBy("topic").agg(F.count("*").alias("n"))


@query(_COORDINATOR + " select producer_id, cast(max(epoch) as integer) as epoch from producers group by all")
def current_epochs(spark, sf):
    return transactions.current_epochs(_coordinator(_log(spark, sf)[0])[0])


@query(_CATALOG + """ select 'offsets' as relation, group_id as name, topic, "partition" from offsets where group_id = 'g3' and topic = 'view' union all select 'topition', null, topic, "partition" from topition where "partition" = 2""")
def lookups(spark, sf):
    """Rows of relations by the values of some columns."""
    own = _catalog(spark, sf)
    found = relations.lookup(own, "consumer_offset", group_id="g3", topic="view").select(F.lit("offsets").alias("relation"), F.col("group_id").alias("name"), "topic", "partition")
    return found.unionByName(relations.lookup(own, "topition", partition=2).select(F.lit("topition").alias("relation"), F.lit(None).cast("string").alias("name"), "topic", "partition"))


@query(""" select topic || '/' || k as topic, "partition", offset_id from log where topic = 'view' and k = '7'""")
def enabled_virtual_topics(spark, sf):
    """A virtual topic of a topic that allows them, and none of one that doesn't."""
    rows, marks = _log(spark, sf)
    own = produce.options(spark.createDataFrame([("view", "virtual", "true")], "topic string, name string, value string"), marks)
    return log.virtual_if_enabled(rows, own, "view", "7").unionByName(log.virtual_if_enabled(rows, own, "click", "7")).select("topic", "partition", "offset_id")


@query(""" select event_id, epoch_us(ts) // 1000 as ms, make_timestamp(epoch_us(ts) // 1000 * 1000) as back from log""")
def times_in_ms(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return _log(spark, sf)[0].select("event_id", ms.alias("ms"), F.timestamp_millis(ms).cast("timestamp_ntz").alias("back"))


@query(""", now as (select max(ts) as now from log), marks as (select topic, "partition", max(offset_id) + 1 as high from log group by all),
d as (select topic, "partition", min(offset_id) as first from log, now where topic in ('view', 'purchase') and epoch_us(now) - epoch_us(ts) <= case topic when 'view' then 86400000000 else 3600000000 end group by all),
a as (select l.* from log l left join d using (topic, "partition") where topic not in ('view', 'purchase') or offset_id >= first),
kept as (select * from a qualify topic not in ('click', 'view') or offset_id = max(offset_id) over (partition by topic, "partition", k))
select m.topic, m."partition", coalesce(min(offset_id), high) as low, high from marks m left join kept k on k.topic = m.topic and k."partition" = m."partition" group by m.topic, m."partition", high""")
def marks_after_maintenance(spark, sf):
    rows, marks = _log(spark, sf)
    config = spark.createDataFrame([("click", "compact", None), ("view", "delete, compact", 86_400_000), ("purchase", "delete", 3_600_000)], "topic string, policy string, retention_ms long")
    done: list[str] = []
    after = maintenance.maintain(rows, marks, config, F.lit(rows.agg(F.max("ts")).first()[0]), lambda: done.append("lake"))[1]
    assert done == ["lake"]
    return after


@query(""", c as (select topic, "partition", k, offset_id, row_number() over (partition by topic, "partition" order by offset_id) - 1 as place from log) select topic, "partition", k, place // 100 as second, count(*) as n from c group by all""")
def rate_limit(spark, sf):
    """How many records of each key go out in each second, at a hundred a second and topition."""
    from strandlog.streaming import ingest

    rows = ingest.limited(_log(spark, sf)[0], 100, ["offset_id"])
    return rows.groupBy("topic", "partition", "k", "second").agg(F.count("*").alias("n"))
