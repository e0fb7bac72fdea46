"""Queries on codecs, sources, sinks, lake tables, groups' requests and made-up records."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions import codecs
from strandlog.functions.scalar import uuid5
from strandlog.operators import coordinator, groups, lake, log, maintenance, produce
from strandlog.sources import generator, lake_writer, proxy_log, records, storage
from strandlog.sources.schemas import Registry
from strandlog.sources.store import shared_dir
from strandlog.sources.table import LakeTable
from strandlog.sources.tables import CONVERSATIONS_SQL, EVENTS_SQL, conversations_store, events, events_store

from .catalog_state import LOG_SQL, RUNS_SQL, _log, _txns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name; sql goes on after `with log as (...)`."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"with log as ({EVENTS_SQL}){sql}"
        return f

    return put


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/out-{uuid.uuid4().hex}"


EVENT = {"type": "record", "name": "Event", "fields": [{"name": "event_id", "type": "long"}, {"name": "topic", "type": {"type": "enum", "name": "Topic", "symbols": ["click", "error", "purchase", "signup", "view"]}}, {"name": "user", "type": ["null", "string"]}, {"name": "tags", "type": {"type": "array", "items": "string"}}, {"name": "at", "type": {"type": "long", "logicalType": "timestamp-micros"}}]}
AVRO = json.dumps({"type": "record", "name": "Record", "fields": [{"name": "key", "type": "string"}, {"name": "value", "type": EVENT}]})
PROTO = """syntax = "proto3";
message Key { string id = 1; }
message Value { int64 event_id = 1; double value = 2; enum Topic { none = 0; click = 1; error = 2; purchase = 3; signup = 4; view = 5; } Topic topic = 3; repeated string tags = 4; message Home { string city = 1; } Home home = 5; }"""
FILES = {"avro.avsc": AVRO, "proto.proto": PROTO, "json.json": json.dumps({"properties": {"value": {"type": "object", "properties": {"k": {"type": "integer"}}, "required": ["k"]}}}), "notes.txt": "no schema"}


def _avro_text() -> Column:
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.to_json(F.struct("event_id", "topic", F.when(F.col("event_id") % 3 != 0, F.col("k")).alias("user"), F.array("k", "topic").alias("tags"), at.alias("at")), {"ignoreNullFields": "false"})


@query(""" select event_id, topic, case when event_id % 3 <> 0 then k end as user, k || ',' || topic as tags, ts as at from log""")
def avro_round_trip(spark, sf):
    """JSON to Avro bytes and back."""
    value = json.dumps(EVENT)
    rows = events(spark, sf).select(codecs.avro_to_json(codecs.json_to_avro(_avro_text(), value), value).alias("x"))
    own = rows.select(F.from_json("x", "event_id long, topic string, user string, tags array<string>, at string").alias("x")).select("x.*")
    return own.withColumns({"tags": F.array_join("tags", ","), "at": F.to_timestamp_ntz("at")})


@query(""" select event_id, topic, case when event_id % 3 <> 0 then k end as user, "partition" as meta_partition, cast(year(ts) as integer) as meta_year, k as "key" from log""")
def avro_rows(spark, sf):
    """Avro records as typed rows of key, value and meta."""
    schema = Registry(spark, FILES)["avro"]
    own = events(spark, sf).withColumns({"v": codecs.json_to_avro(_avro_text(), json.dumps(EVENT)), "k": codecs.json_to_avro(F.to_json(F.array("k")).substr(F.lit(2), F.length(F.to_json(F.array("k"))) - 2), '"string"')})
    out = schema.rows(own)
    assert out.columns == ["key", "value", "meta"]
    return out.select("value.event_id", "value.topic", "value.user", F.col("meta.partition").alias("meta_partition"), F.col("meta.year").alias("meta_year"), "key")


def _proto_text() -> Column:
    return F.to_json(F.struct("event_id", "value", "topic", F.array("k").alias("tags"), F.struct(F.concat(F.lit("c"), "k").alias("city")).alias("home")))


@query(""" select event_id, value, topic, k as tags, 'c' || k as city from log""")
def protobuf_round_trip(spark, sf):
    """JSON to Protobuf bytes and back; numbers of 64 bits are text in its JSON."""
    schema = Registry(spark, FILES)["proto"]
    rows = events(spark, sf).select(schema.json(schema.encoded(_proto_text(), "value"), "value").alias("x"))
    return rows.select(F.from_json("x", "event_id string, value double, topic string, tags array<string>, home struct<city: string>").alias("x")).select(F.coalesce(F.col("x.event_id").cast("long"), F.lit(0).cast("long")).alias("event_id"), F.coalesce("x.value", F.lit(0.0)).alias("value"), "x.topic", F.array_join("x.tags", ",").alias("tags"), "x.home.city")


@query(""" select "partition" as meta_partition, event_id, case topic when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end as topic, 'c' || k as city from log where event_id % 10 <> 0""")
def protobuf_rows(spark, sf):
    """Readable Protobuf records as rows of meta and value; every tenth is broken."""
    schema = Registry(spark, FILES)["proto"]
    own = events(spark, sf)
    own = own.withColumn("v", F.when(own.event_id % 10 == 0, F.lit(b"\xff\xff")).otherwise(schema.encoded(_proto_text(), "value")))
    out = codecs.protobuf_rows(own, PROTO, None, "Value")
    return out.select(F.col("meta.partition").alias("meta_partition"), "value.event_id", "value.topic", "value.home.city")


@query(""" select event_id, case when event_id % 4 = 0 then false else true end as valid from log""")
def validation_by_topic(spark, sf):
    """Records against the schema of a topic, found by its name."""
    own = events(spark, sf).withColumn("v", F.expr("case event_id % 4 when 0 then '{\"k\": 1.5}' when 1 then '{\"k\": 2.0}' else v end"))
    return own.select("event_id", Registry(spark, FILES)["json"].valid(F.col("k"), F.col("v")).alias("valid"))


@query(""", v as (select event_id, cast(v->>'k' as bigint) as n from log) select event_id, n >= 2 and n < 9 as bounds, n in (1, 3, 5) as listed, (n % 2 = 0) <> (n % 3 = 0) as one, not (n = 4) as no_four, n <> 7 and n >= 0 as closed from v""")
def schema_keywords(spark, sf):
    from strandlog.functions.json_schema import valid

    def k(rule) -> Column:
        return valid(F.col("v"), {"type": "object", "properties": {"k": rule}, "required": ["k"]})

    return events(spark, sf).select(
        "event_id", k({"allOf": [{"minimum": 2}, {"exclusiveMaximum": 9}]}).alias("bounds"), k({"anyOf": [{"const": 1}, {"enum": [3, 5.0]}]}).alias("listed"), k({"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}).alias("one"),
        k({"not": {"const": 4}}).alias("no_four"), valid(F.col("v"), {"properties": {"k": {"$ref": "#/$defs/n"}}, "additionalProperties": False, "$defs": {"n": {"type": "integer", "minimum": 0, "not": {"enum": [7]}}}}).alias("closed"),
    )


@query(""", u as (select distinct topic || '/' || k as name from log), h as (select name, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(name)) as d from u)
select name, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || lower(to_hex((('0x' || substr(d, 17, 2))::int & 63) | 128)) || substr(d, 19, 2) || '-' || substr(d, 21, 12) as id from h""")
def name_ids(spark, sf):
    name = F.concat_ws("/", "topic", "k")
    return events(spark, sf).select(name.alias("name")).distinct().select("name", uuid5(F.col("name")).alias("id"))


@query(""" select event_id, topic, cast(ts as date) as day, cast(round(value) as integer) as whole from log""")
def lake_table(spark, sf):
    """Events stored in two steps, the second with a column more, as a table of generated columns and partitions, on a z curve, and read back."""
    root, rows = _scratch(spark), events(spark, sf).select("event_id", "topic", "ts", "value")
    day = {"day": "cast(ts as date)"}
    lake.store(rows.where("event_id % 2 = 0"), root, "db", "events", partition="topic", generated=day, compression="zstd")
    lake.store(rows.where("event_id % 2 = 1"), root, "db", "events", partition="topic", generated=day | {"whole": "cast(round(value) as int)"}, z_order="event_id, value")
    return lake.load(spark, root, "db", "events").select("event_id", "topic", "day", F.coalesce("whole", F.round("value").cast("int")).alias("whole"))


@query(""" select topic, event_id, "partition", cast(ts as date) as day, case topic when 'click' then k end as user from log where topic in ('click', 'view') and event_id % 8 <> 0""")
def lake_by_options(spark, sf):
    """Two topics, one of Avro, flat and on a z curve, one of JSON, with a generated partition, written as their options say; every eighth record is a control record, one topic has no schema."""
    root = _scratch(spark)
    own = events(spark, sf).where("topic in ('click', 'view', 'signup')").withColumn("attributes", F.when(F.col("event_id") % 8 == 0, 32).otherwise(0))
    avro = json.dumps({"type": "record", "name": "R", "fields": [{"name": "value", "type": {"type": "record", "name": "V", "fields": [{"name": "event_id", "type": "long"}, {"name": "user", "type": "string"}]}}]})
    registry = Registry(spark, {"click.avsc": avro, "view.json": '{"properties": {"value": {"type": "object"}}}'})
    said = registry["click"].encoded(F.to_json(F.struct("event_id", F.col("k").alias("user"))), "value")
    own = own.withColumn("v", F.when(F.col("topic") == "click", said).otherwise(F.to_json(F.struct("event_id")).cast("binary")))
    config = spark.createDataFrame([("click", "lake.normalize", "true"), ("click", "lake.normalize.separator", "_"), ("click", "lake.z_order", "value_event_id, meta_timestamp"), ("view", "lake.generate.day", "cast(meta.timestamp as date)"), ("view", "lake.partition", "day")], "topic string, name string, value string")
    paths = lake_writer.write(own, produce.options(config, own), produce.generated(config), registry, root)
    click = spark.read.parquet(paths["click"]).select(F.lit("click").alias("topic"), F.col("value_event_id").alias("event_id"), F.col("meta_partition").alias("partition"), F.col("meta_timestamp").cast("date").alias("day"), F.col("value_user").alias("user"))
    view = spark.read.parquet(paths["view"]).select(F.lit("view").alias("topic"), "value.event_id", "meta.partition", "day", F.lit(None).cast("string").alias("user"))
    return click.unionByName(view)


@query(""" select topic, event_id, cast(ts as date) as day, case when event_id % 3 = 2 then value end as value from log where topic <> 'error'""")
def lake_versions(spark, sf):
    """Events written in three steps, each twice under one name, the last with a column more and a topic of its own that the read passes; then compacted."""
    own, rows = LakeTable(spark, _scratch(spark)), events(spark, sf).withColumn("day", F.col("ts").cast("date"))
    for step in (0, 1, 2, 1):
        some = rows.where(F.col("event_id") % 3 == step).select("topic", "event_id", "day", *(["value"] if step == 2 else []))
        own.append(some, ["topic"], key=f"step-{step}")
    own.compact(3, ["event_id"], ["topic"])
    out = None
    for topic in ("click", "purchase", "signup", "view"):
        part = own.read(where={"topic": topic})
        out = part if out is None else out.unionByName(part)
    return out.select("topic", "event_id", "day", "value")


@query(""" select cast(-1 as bigint) as shift, count(*) as n from log where event_id % 8 <> 0 and topic = 'click'""")
def lake_writes_once(spark, sf):
    """A topic's records written twice under one name are in its table once."""
    root = _scratch(spark)
    own = events(spark, sf).withColumns({"attributes": F.when(F.col("event_id") % 8 == 0, 32).otherwise(0), "v": F.to_json(F.struct("event_id"))})
    registry = Registry(spark, {"click.json": '{"properties": {"value": {"type": "object"}}}'})
    config = spark.createDataFrame([("click", "lake.generate.shift", "cast(-1 as bigint)")], "topic string, name string, value string")
    for _ in range(2):
        paths = lake_writer.write(own, produce.options(config, own), produce.generated(config), registry, root, key="batch-1")
    return LakeTable(spark, paths["click"]).read().groupBy("shift").agg(F.count("*").alias("n"))


@query(""" select count(*) as n, 4 as files, count(distinct event_id) as ids, max(event_id) as greatest from log""")
def lake_compaction(spark, sf):
    """A table of many files as four files on a z curve of a number, a time and a text, stored as a snapshot."""
    root, rows = _scratch(spark), events(spark, sf).select("event_id", "topic", "ts", "value")
    at = lake.store(rows.repartition(12), root, "db", "events")
    own = storage.snapshot(lake.compacted(spark, at, 4, ["value", "ts", "topic"]), at)
    own = own.withColumn("file", F.input_file_name())
    return own.agg(F.count("*").alias("n"), F.count_distinct("file").cast("int").alias("files"), F.count_distinct("event_id").alias("ids"), F.max("event_id").alias("greatest"))


@query(""" select topic || '/' || lpad(cast("partition" as varchar), 10, '0') || '/' || lpad(cast(min(offset_id) as varchar), 20, '0') || '.parquet' as file, count(*) as records from log where topic = 'signup' group by topic, "partition", offset_id // 100""")
def batch_files(spark, sf):
    """Batches of a hundred records as files of exact names."""
    root, rows = _scratch(spark), events(spark, sf).where("topic = 'signup'")
    base = rows.withColumn("base_offset", (F.floor(F.col("offset_id") / 100) * 100).cast("long"))
    storage.put_batches(base.select("topic", "partition", "base_offset", "offset_id", "k", "v"), root)
    back = spark.read.option("recursiveFileLookup", "true").parquet(root)
    return back.groupBy(F.regexp_extract(F.input_file_name(), r"([^/]+/[^/]+/[^/]+)$", 1).alias("file")).agg(F.count("*").alias("records"))


@query(""" select topic, "partition", min(offset_id) as low, max(offset_id) + 1 as high from log group by all""")
def stored_by_scheme(spark, sf):
    """Watermarks of a log that went through a storage named by its URL."""
    rows = events(spark, sf).drop("offset_id")
    storage.Storage(spark, "null://x").put(rows, ["ts", "event_id"])
    place = storage.Storage(spark, f"memory://{uuid.uuid4().hex}")
    place.put(rows, ["ts", "event_id"])
    return log.watermarks(place.open().log)


@query()
def json_files(spark, sf):
    """Records written as JSON lines and read back as keys and values; items with neither key nor value are left out. SQL: see json_file_rows."""
    at = _scratch(spark)
    rows = events(spark, sf)
    rows.select(F.to_json(F.struct(F.when(rows.event_id % 5 != 0, F.col("k")).alias("key"), F.when(rows.event_id % 5 != 1, F.col("event_id")).alias("value"))).alias("value")).write.text(at)
    return records.json_records(spark, at, array=False)


ORACLE_SQL["json_files"] = f"""with log as ({EVENTS_SQL}) select case when event_id % 5 <> 0 then k end as "key", case when event_id % 5 <> 1 then cast(event_id as varchar) end as value from log"""


@query()
def console_lines(spark, sf):
    rows, marks = _log(spark, sf)
    return storage.console(rows, marks, _txns(rows), "view", 10)


ORACLE_SQL["console_lines"] = f"""with {LOG_SQL}{RUNS_SQL} select l."partition", l.offset_id, '{{"partition":' || l."partition" || ',"offset":' || l.offset_id || ',"key":"' || l.k || '","value":' || cast(to_json(l.v) as varchar) || '}}' as line
from log l join txns t on l.topic = t.topic and l."partition" = t."partition" and l.producer_id = t.producer_id and l.offset_id // 50 = t.run left join stable s on l.topic = s.topic and l."partition" = s."partition"
where l.topic = 'view' and l.offset_id >= 10 and t.status <> 'ABORTED' and (stable is null or l.offset_id < stable)"""


#: In every group one member joins, is told its id, joins with it, syncs as its leader, beats, leaves, and beats once more.
STEPS = [("join", "", None, None), ("join", "m", None, None), ("sync", "m", 0, ["m=0"]), ("heartbeat", "m", 0, None), ("commit", "m", 0, None), ("commit", "m", 7, None), ("leave", "m", None, None), ("heartbeat", "m", 1, None), ("commit", "", -1, None)]
_ANSWERS = [("MEMBER_ID_REQUIRED", 0, False, 1), ("NONE", 0, False, 1), ("NONE", 0, True, 1), ("NONE", 0, True, 1), ("NONE", 0, True, 1), ("ILLEGAL_GENERATION", 0, True, 1), ("NONE", 1, False, 0), ("UNKNOWN_MEMBER_ID", 1, False, 0), ("NONE", 1, False, 0)]


@query(""", s(seq, error, generation, formed, members) as (values """ + ", ".join(f"({i}, '{e}', {g}, {str(f).lower()}, {m})" for i, (e, g, f, m) in enumerate(_ANSWERS)) + """)
select g.k as group_id, cast(s.seq as bigint) as seq, error, generation, formed, members from (select distinct k from log) g, s""")
def group_requests(spark, sf):
    """A group for each key; the answers of one life of a group, by hand, for all of them."""
    steps = F.from_json(F.lit(json.dumps([dict(zip(("seq", "kind", "member", "generation", "assigned"), (i, *s), strict=True)) for i, s in enumerate(STEPS)])), "array<struct<seq: long, kind: string, member: string, generation: int, assigned: array<string>>>")
    own = events(spark, sf).select(F.col("k").alias("group_id")).distinct().select("group_id", F.inline(steps))
    member = F.when(F.col("member") == "m", F.concat(F.lit("member-"), "group_id", F.lit("-0"))).otherwise(F.col("member"))
    asked = own.select("group_id", "seq", F.col("seq").alias("at_ms"), "kind", member.alias("member"), F.lit(None).cast("string").alias("instance"), "generation", F.when(F.col("kind") == "join", F.array(F.lit("range"))).alias("protocols"), F.lit("a").alias("metadata"), F.transform("assigned", lambda x: F.concat(F.lit("member-"), "group_id", F.lit("-0=0"))).alias("assigned"))
    return coordinator.answers(asked).select("group_id", "seq", "error", "generation", "formed", "members")


@query(""", l as (select *, epoch_us(ts) as us from log), r as (select event_id, k, us, us + 1000 * (event_id % 97) + 5 as ended from l where event_id % 4 <> 0)
select event_id, 5 as api_key, cast(event_id % 7 as integer) as api_version, ended - us as elapsed_us from r where event_id % 3 <> 0 union all select event_id, 5, cast(event_id % 7 as integer), null from r where event_id % 3 = 0""")
def proxy_calls(spark, sf):
    """Latency of calls in a proxy's text log of one request for most events and a response for two thirds of them."""
    at, rows = _scratch(spark), events(spark, sf).where("event_id % 4 <> 0")
    name = F.format_string("%021d", "event_id")
    def line(us, kind: str, data) -> Column:
        return F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(' DEBUG req{id="'), name, F.lit('"}: ' + kind + "=["), data, F.lit("]"))

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    asked = rows.select(line(us, "request", F.concat(F.lit("0, 0, 0, 9, 0, 5, 0, "), (F.col("event_id") % 7).cast("string"))).alias("value"))
    said = rows.where("event_id % 3 <> 0").select(line(us + 1000 * (F.col("event_id") % 97) + 5, "response", F.lit("0, 1")).alias("value"))
    asked.unionByName(said).write.text(at)
    calls = proxy_log.calls(proxy_log.frames(spark.read.text(at)))
    return calls.select(F.col("id").cast("long").alias("event_id"), F.col("api_key").cast("int").alias("api_key"), F.col("api_version").cast("int").alias("api_version"), "elapsed_us")


@query()
def assign_by_subscription(spark, sf):
    """Round robin over members that hear different topics; each choice depends on the one before, so tests follow them instead of SQL."""
    marks = events_store(spark, sf).marks
    heard = marks.select("topic").distinct().select("topic", F.explode(F.array(*map(F.lit, ("m1", "m2c", "m3v", "m4s")))).alias("member"))
    heard = heard.where((F.col("member") == "m1") | F.col("topic").startswith(F.substring("member", 3, 1)))
    return groups.assigned_by("roundrobin", marks.select("topic", "partition"), heard.select("topic", "member"))


@query(""" select cast(5000 as bigint) as n, cast(5000 as bigint) as emails, true as in_bounds, cast(5000 as bigint) as skipped, 3 as items, 1 as flag, 'abc' as note from (select count(*) as c from log) where c > 0""")
def generated_records(spark, sf):
    """Made-up records of a Protobuf message: what options say holds for all of them."""
    text = 'syntax = "proto3"; message Value { string email = 1; double fare = 2; string note = 3; int32 gone = 4; repeated string trades = 5; enum F { a = 0; b = 1; } F flag = 6; message H { string city = 1; } H home = 7; }'
    options = {"email": {"make": "safe_email"}, "fare": {"make": "5 + pmod(xxhash64(id), 1000) / 10"}, "gone": {"skip": True}, "trades": {"repeated": {"len": 3}, "make": "industry"}, "home.city": {"make": "city_name"}}
    rows = generator.from_message(spark, 5000, text, "Value", options)
    fine = F.every((F.col("fare") >= 5) & (F.col("fare") < 105) & F.col("home.city").isin(*records.CITIES) & F.forall("trades", lambda x: x.isin(*records.INDUSTRIES)))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("email").alias("emails"), fine.alias("in_bounds"), F.count_if(F.col("gone").isNull()).alias("skipped"), F.max(F.size("trades")).alias("items"), F.min("flag").alias("flag"), F.min("note").alias("note"))


@query(""" select cast(4000 as bigint) as n, true as valid from (select count(*) as c from log) where c > 0""")
def generated_by_schema(spark, sf):
    """Made-up records of a JSON Schema are valid by it."""
    from strandlog.functions.json_schema import valid

    schema = {"type": "object", "properties": {"id": {"type": "integer", "minimum": 10, "maximum": 99}, "half": {"type": "number", "multipleOf": 0.5, "minimum": 0, "maximum": 4}, "kind": {"type": "string", "enum": ["a", "it's"]}, "home": {"type": "object", "properties": {"no": {"type": "integer", "minimum": 1, "maximum": 3}}}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["id", "half", "kind", "home"]}
    rows = generator.from_json_schema(spark, 4000, schema)
    return rows.select(F.to_json(F.struct("*")).alias("v")).select(valid(F.col("v"), schema).alias("ok")).agg(F.count("*").alias("n"), F.every("ok").alias("valid"))


@query()
def conversation_turns(spark, sf):
    """The last turn of each conversation and role in the log of conversations, with the bytes of all."""
    own = conversations_store(spark, sf)
    size = own.log.groupBy("topic", "partition", "k").agg(F.sum(log.byte_size("v")).alias("bytes"))
    last = maintenance.compact(own.log).select("topic", "partition", "k", "offset_id", "turn")
    return last.join(size, ["topic", "partition", "k"])


ORACLE_SQL["conversation_turns"] = f"""with log as ({CONVERSATIONS_SQL}) select topic, "partition", k, max(offset_id) as offset_id, arg_max(turn, offset_id) as turn, cast(sum(coalesce(strlen(v), 0)) as bigint) as bytes from log group by topic, "partition", k"""


@query()
def conversation_fetch(spark, sf):
    """What a fetch of 2,000 bytes from offset 3 reads of each topition of that log."""
    own = conversations_store(spark, sf)
    return log.fetch(own.log, 3, 2000, marks=own.marks).select("topic", "partition", "offset_id")


ORACLE_SQL["conversation_fetch"] = f"""with log as ({CONVERSATIONS_SQL}), f as (select *, sum(strlen(k) + coalesce(strlen(v), 0)) over (partition by topic, "partition" order by offset_id) as spent from log where offset_id >= 3) select topic, "partition", offset_id from f where spent < 2000"""
