"""Stored logs, transactions, appending, codecs, schemas, made-up records and schedules: by hand, by brute force, or as a round trip."""

import base64
import datetime as dt
import json
import random
import uuid
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlog.functions import avro, codecs, protobuf, scalar
from strandlog.operators import groups, lake, log, maintenance, produce, relations, transactions
from strandlog.sources import generator, storage, store
from strandlog.sources.schemas import Registry
from strandlog.sources.table import Conflict, LakeTable
from strandlog.streaming import ingest

T0 = dt.datetime(2024, 1, 1)
LOG = "topic string, partition int, offset_id long, ts timestamp, k string, v string, producer_id long, epoch int, attributes int"


def test_numbers_by_ranges_as_by_windows(spark):
    draw = random.Random(1)
    rows = spark.createDataFrame([(draw.choice(("hot", "hot", "hot", "a", None)), draw.randrange(3), i) for i in range(3000)], "topic string, partition int, n long").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = log.numbered(rows, ["n"], store.written).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for r in sorted(got, key=lambda r: r.n):
        assert r.offset_id == want.get((r.topic, r.partition), 0)
        want[r.topic, r.partition] = r.offset_id + 1
    assert len(got) == 3000 and log.numbered(rows.where("false"), ["n"], store.written).count() == 0


def test_a_stored_log_reads_what_it_needs(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("t"), F.col("id") % 2).alias("topic"), (F.col("id") % 3).cast("int").alias("partition"), "id", F.lit(T0).alias("ts"), F.lit("k").alias("k"), F.lit("v" * 30).alias("v"))
    own = store.store(rows, ["id"], str(tmp_path / "log"))
    got = log.fetch(own.log.where("topic = 't1' and partition = 2"), 10, 200, marks=own.marks.where("topic = 't1' and partition = 2"))
    assert [r.offset_id for r in got.orderBy("offset_id").collect()] == list(range(10, 16))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(topic" in plan and "GreaterThanOrEqual(offset_id,10)" in plan and "LessThan(offset_id,1034)" in plan
    assert {(r.topic, r.partition, r.low) for r in own.marks.collect()} == {(f"t{t}", p, 0) for t in (0, 1) for p in range(3)}
    empty = rows.withColumns({"k": F.lit(None).cast("string"), "v": F.when(F.col("id") > 4900, F.lit("x" * 50))})
    odd = store.store(empty, ["id"], str(tmp_path / "odd"))
    assert log.fetch(odd.log, 0, 120, marks=odd.marks).count() == log.fetch(odd.log, 0, 120).count()  # records without a byte cost nothing


def by_hand(spark, rows):
    """rows (producer, attributes) of one topition as a log."""
    return spark.createDataFrame([("t", 0, i, T0 + dt.timedelta(seconds=i), "k", str(i), p, 0 if p else None, a) for i, (p, a) in enumerate(rows)], LOG)


def test_reads_keep_what_others_wrote_between(spark):
    rows = by_hand(spark, [(1, 0), (2, 0), (1, 0), (2, 0), (None, 0), (1, 0), (1, 32), (2, 32), (3, 0), (2, 0)])
    marks = spark.createDataFrame([("t", 0, 0, 10)], "topic string, partition int, low long, high long")
    txns = spark.createDataFrame([("a", 1, 0, "ABORTED", "t", 0, 0, 5), ("b", 2, 0, "COMMITTED", "t", 0, 1, 3), ("c", 3, 0, "BEGIN", "t", 0, 8, 8)], "txn string, producer_id long, epoch int, status string, topic string, partition int, offset_start long, offset_end long")
    assert sorted(r.offset_id for r in transactions.read_committed(rows, marks, txns).collect()) == [1, 3, 4]
    assert sorted(r.offset_id for r in transactions.read_committed(rows, marks, txns, hide_aborted=False).collect()) == list(range(8))
    assert log.list_offsets(rows, marks, log.LATEST, transactions.stable_offsets(marks, txns)).first()["offset_id"] == 8
    assert log.list_offsets(rows, marks, log.LATEST).first()["offset_id"] == 10
    gone = log.list_offsets(rows.where("false"), marks, log.LATEST).first()
    assert gone["offset_id"] == 10 and gone["ts"] is None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 6), st.integers(1, 3)), max_size=14))
def test_sequences_as_followed_one_by_one(spark, sent):
    rows = [(p, 0, "t", 0, i, base, n) for i, (p, base, n) in enumerate(sent)]
    df = spark.createDataFrame(rows, "producer_id long, epoch int, topic string, partition int, arrival long, base_sequence long, records long")
    known = spark.createDataFrame([(0, 0), (1, 0)], "producer_id long, epoch int")
    want, expected = {}, {}
    for p, _, _, _, i, base, n in rows:
        at = expected.get(p, 0)
        want[i] = "UNKNOWN_PRODUCER_ID" if p == 2 else "NONE" if base == at else "DUPLICATE_SEQUENCE_NUMBER" if at > base else "OUT_OF_ORDER_SEQUENCE_NUMBER"
        if want[i] == "NONE":
            expected[p] = at + n
    assert {r.arrival: r.verdict for r in transactions.sequence_check(df, known).collect()} == want


def test_the_life_of_a_transaction(spark):
    producers = spark.createDataFrame([(7, 0)], "producer_id long, epoch int")
    txns = spark.createDataFrame([("a", 7, 0, "BEGIN", None)], "txn string, producer_id long, epoch int, status string, started_at timestamp")
    asked = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "a")], "request long, txn string")
    answers, producers, txns = transactions.init_producers(producers, txns, asked)
    got = {r.request: (r.producer_id, r.epoch) for r in answers.collect()}
    assert got[1] == got[4] == (7, 1) and {got[2], got[3]} == {(8, 0), (9, 0)}
    assert {(r.txn, r.epoch): r.status for r in txns.collect()} == {("a", 0): "ABORTED", ("a", 1): None, ("b", 0): None}
    none = spark.createDataFrame([], "txn string, producer_id long, epoch int, topic string, partition int, offset_start long, offset_end long")
    add = spark.createDataFrame([("a", 7, 1, "t", 0), ("a", 7, 0, "t", 1), ("x", 99, 0, "t", 0)], "txn string, producer_id long, epoch int, topic string, partition int")
    said, txns, ranges = transactions.add_partitions(producers, txns, none, add, F.lit(T0))
    assert {(r.producer_id, r.epoch): r.verdict for r in said.collect()} == {(7, 1): "NONE", (7, 0): "INVALID_PRODUCER_EPOCH", (99, 0): "UNKNOWN_PRODUCER_ID"}
    assert {(r.txn, r.epoch): (r.status, r.started_at) for r in txns.collect()}["a", 1] == ("BEGIN", T0)
    assert transactions.add_partitions(producers, txns, ranges, add, F.lit(T0))[2].count() == 1
    wrote = spark.createDataFrame([("a", 7, 1, "t", 0, 5, 6), ("a", 7, 1, "t", 0, 9, 9)], none.schema)
    ranges = transactions.produced(ranges, wrote)
    assert [tuple(r)[-2:] for r in ranges.collect()] == [(5, 9)]
    offer = spark.createDataFrame([("a", 7, 1, "g", "t", 0, 4), ("a", 7, 0, "g", "t", 0, 8)], "txn string, producer_id long, epoch int, group_id string, topic string, partition int, committed long")
    _, pending = transactions.commit_offsets(producers, offer.limit(0), offer)
    stored = spark.createDataFrame([("g", "t", 0, 1), ("h", "t", 0, 2)], "group_id string, topic string, partition int, committed long")
    assert {tuple(r) for r in transactions.applied(stored, txns, pending)[0].collect()} == {("g", "t", 0, 1), ("h", "t", 0, 2)}
    done = txns.withColumn("status", F.when(F.col("epoch") == 1, "COMMITTED").otherwise(F.col("status")))
    offsets, left = transactions.applied(stored, done, pending)
    assert {tuple(r) for r in offsets.collect()} == {("g", "t", 0, 4), ("h", "t", 0, 2)} and left.count() == 0
    marks = spark.createDataFrame([("t", 0, 0, 10)], "topic string, partition int, low long, high long")
    mark = transactions.markers(done, ranges, done.where("status = 'COMMITTED'").select("txn", "producer_id", "epoch", "status"), marks, F.lit(T0)).collect()
    assert [(m.offset_id, m.attributes, m.marker) for m in mark] == [(10, 32, 1)]


def test_appending(spark):
    """A bad record takes its whole batch, which moves no offset and no sequence; a sink-only topic has offsets but no log."""
    rows = [("b1", 0, 0, "t", 0, 1, 0, 0, 0, T0, "k", '{"n": 1}'), ("b1", 0, 1, "t", 0, 1, 0, 0, 0, T0, "k", '{"n": 2}'), ("b2", 1, 0, "t", 0, 1, 0, 2, 0, T0, "k", '{"n": "x"}'), ("b3", 2, 0, "t", 0, 1, 0, 2, 0, T0, "k", '{"n": 3}'), ("b4", 3, 0, "t", 0, 1, 0, 2, 0, T0, "k", '{"n": 3}'),
            ("c1", 0, 0, "s", 0, None, None, None, 0, T0, "k", "{}"), ("c2", 1, 0, "s", 0, None, None, None, 32, T0, None, None), ("d1", 0, 0, "free", 0, None, None, None, 0, T0, None, "no schema")]
    df = spark.createDataFrame(rows, "batch string, arrival long, place long, topic string, partition int, producer_id long, epoch int, base_sequence long, attributes int, ts timestamp, k string, v string")
    marks = spark.createDataFrame([("t", 0, 3, 10), ("s", 0, 0, 0)], "topic string, partition int, low long, high long")
    own = produce.options(spark.createDataFrame([("s", "lake.sink", "true")], "topic string, name string, value string"), df)
    schemas = {"t": (None, {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}), "s": (None, {"type": "object"})}
    out = produce.produce(df, marks, spark.createDataFrame([(1, 0)], "producer_id long, epoch int"), own, schemas, F.lit(T0))
    assert {r.batch: r.verdict for r in out.verdicts.collect()} == {"b1": "NONE", "b2": "INVALID_RECORD", "b3": "NONE", "b4": "DUPLICATE_SEQUENCE_NUMBER", "c1": "NONE", "c2": "NONE", "d1": "NONE"}
    assert sorted((r.topic, r.offset_id) for r in out.log.collect()) == [("free", 0), ("t", 10), ("t", 11), ("t", 12)]
    assert sorted((r.topic, r.offset_id) for r in out.lake.collect()) == [("s", 0), ("t", 10), ("t", 11), ("t", 12)]
    assert {(r.topic, r.low, r.high) for r in out.marks.collect()} == {("t", 3, 13), ("s", 0, 2), ("free", 0, 1)}
    more = produce.generated(spark.createDataFrame([("t", "lake.generate.day", "cast(ts as date)"), ("t", "x", "y")], "topic string, name string, value string"))
    assert [tuple(r) for r in more.collect()] == [("t", "day", "cast(ts as date)")]


def test_queues_are_flushed_one_after_the_other(spark):
    draw = random.Random(4)
    rows = [(f"q{i % 3}", i, 100 * i + draw.randrange(90), draw.randrange(50)) for i in range(300)]
    got = log.flushes(spark.createDataFrame(rows, "q string, arrival long, at_ms long, size int").repartition(5), 60, 1500, ["q"]).collect()
    for q in ("q0", "q1", "q2"):
        flush, held, first = 0, 0, None
        for r in sorted((r for r in got if r.q == q), key=lambda r: r.arrival):
            if first is not None and (held > 60 or r.at_ms - first >= 1500):
                flush, held, first = flush + 1, 0, None
            first = r.at_ms if first is None else first
            held += r["size"]
            assert r.flush == flush
        assert flush > 10


def test_maintenance_in_one_pass_as_in_two(spark):
    draw = random.Random(9)
    rows = spark.createDataFrame([(t, 0, i, T0 + dt.timedelta(hours=draw.randrange(200)), draw.choice(("a", "b", None)), "v", None, None, 32 if draw.random() < 0.1 else 0) for t in ("both", "old", "keys", "none") for i in range(60)], LOG)
    config = spark.createDataFrame([("both", "delete,compact", 100 * 3_600_000), ("old", "delete", None), ("keys", "compact", None)], "topic string, policy string, retention_ms long")
    now = F.lit(T0 + dt.timedelta(hours=220))
    got = {(r.topic, r.offset_id) for r in maintenance.maintained(rows, config, now).collect()}
    want = set()
    for topic, ms, compacts in (("both", 100 * 3_600_000, True), ("old", maintenance.WEEK_MS, False), ("keys", None, True), ("none", None, False)):
        own = rows.where(F.col("topic") == topic)
        own = own if ms is None else maintenance.retain(own, now, ms)
        want |= {(r.topic, r.offset_id) for r in (maintenance.compact(own) if compacts else own).collect()}
    assert got == want


def test_silent_members_without_another_beat(spark):
    beats = spark.createDataFrame([("g", "a", T0), ("g", "a", T0 + dt.timedelta(seconds=10)), ("g", "b", T0 + dt.timedelta(seconds=50))], "group_id string, member string, ts timestamp")
    now = F.lit(T0 + dt.timedelta(seconds=60))
    assert [(r.member, r.silent_s) for r in groups.evicted(beats, 45, ["group_id", "member"], now).collect()] == [("a", 50)]
    assert groups.evicted(beats, 45, ["group_id", "member"]).count() == 0


def test_brokers_and_ids(spark):
    brokers = spark.createDataFrame([(3, "h", 1), (5, "i", 2)], "node int, host string, port int")
    keys = ["a", "b", "é", ""]
    got = {r.key: r.node for r in relations.find_coordinator(brokers, spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    assert got == {k: (3, 5)[zlib.crc32(k.encode()) % 2] for k in keys}
    assert relations.find_coordinator(brokers.where("false"), spark.createDataFrame([("a",)], "key string")).first()["verdict"] == "COORDINATOR_NOT_AVAILABLE"
    topics = spark.createDataFrame([("t", "u1")], "topic string, uuid string")
    ids = {r.name: r.uuid for r in relations.topic_ids(topics, spark.createDataFrame([("t", "k")], "topic string, key string"), scalar.uuid5).collect()}
    assert ids == {"t": "u1", "t/k": str(uuid.uuid5(uuid.NAMESPACE_URL, "virtual:t:k"))}
    rows = relations.lookup({"x": topics.unionByName(spark.createDataFrame([("n", None)], topics.schema))}, "x", uuid=None)
    assert [r.topic for r in rows.collect()] == ["n"]


AVRO = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string", "double"]}, {"name": "c", "type": {"type": "map", "values": "bytes"}}, {"name": "d", "type": {"type": "int", "logicalType": "date"}}, {"name": "e", "type": {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}}, {"name": "t", "type": {"type": "long", "logicalType": "timestamp-millis"}}]}


def test_json_through_avro_and_protobuf(spark):
    value = {"a": -5, "b": 1.5, "c": {"k": "ÿ\x00"}, "d": "1973-10-17", "e": "12.30", "t": "2009-02-13T23:31:30.500"}
    rows = spark.createDataFrame([(json.dumps(value),), (json.dumps(value | {"b": None}),), ('{"a": "x"}',), ("no json",), (None,)], "v string").coalesce(1)
    schema = json.dumps(AVRO)
    got = [r[0] for r in rows.select(codecs.avro_to_json(codecs.json_to_avro(F.col("v"), schema), schema)).collect()]
    assert json.loads(got[0]) == value | {"t": "2009-02-13T23:31:30.500000"} and json.loads(got[1])["b"] is None and got[2:] == [None] * 3
    text = 'syntax = "proto3"; message Value { int64 id = 1; repeated string industry = 2; }'
    rows = spark.createDataFrame([('{"id": 12321, "industry": ["abc", "def", "pqr"]}',), ('{"nope": 1}',), (None,)], "v string").coalesce(1)
    data = codecs.json_to_protobuf(F.col("v"), text, "Value")
    got = rows.select(codecs.protobuf_to_json(data, text, "Value").alias("j"), protobuf.decode(data, text, "Value").alias("r")).collect()
    assert json.loads(got[0].j) == {"id": "12321", "industry": ["abc", "def", "pqr"]} and got[1].j is None and got[2].j is None
    assert got[0].r.value.id == 12321 and got[0].r.value.industry == ["abc", "def", "pqr"]


TAXI = """syntax = "proto3"; enum Flag { N = 0; Y = 1; }
message Value { int64 vendor_id = 1; int64 trip_id = 2; float trip_distance = 3; double fare_amount = 4; Flag store_and_fwd = 5; }"""


def taxi(spark):
    """One trip of fixed values in partition 32123 at 119731017000 ms."""
    data = protobuf.encode(TAXI, "Value", {"vendor_id": 1, "trip_id": 1000371, "trip_distance": 1.8, "fare_amount": 15.32, "store_and_fwd": "N"})
    rows = spark.createDataFrame([("taxi", 32123, 0, None, data)], "topic string, partition int, offset_id long, k binary, v binary").withColumn("ts", F.timestamp_millis(F.lit(119731017000)))
    return Registry(spark, {"taxi.proto": TAXI})["taxi"].rows(rows)


@pytest.mark.parametrize(("options", "columns", "last"), [
    ({}, ["meta", "value"], None),
    ({"normalize": True}, ["meta.partition", "meta.timestamp", "meta.year", "meta.month", "meta.day", "value.vendor_id", "value.trip_id", "value.trip_distance", "value.fare_amount", "value.store_and_fwd"], 0),
    ({"normalize": True, "separator": "_"}, ["meta_partition", "meta_timestamp", "meta_year", "meta_month", "meta_day", "value_vendor_id", "value_trip_id", "value_trip_distance", "value_fare_amount", "value_store_and_fwd"], 0),
    ({"normalize": True, "partition": "value.vendor_id"}, ["meta.partition", "meta.timestamp", "meta.year", "meta.month", "meta.day", "value.trip_id", "value.trip_distance", "value.fare_amount", "value.store_and_fwd", "value.vendor_id"], 1),
    ({"generated": {"date": "cast(meta.timestamp as date)"}}, ["meta", "value", "date"], dt.date(1973, 10, 17)),
    ({"generated": {"date": "cast(meta.timestamp as date)"}, "partition": "date"}, ["meta", "value", "date"], dt.date(1973, 10, 17)),
    ({"generated": {"year": "cast(meta.year as integer)", "month": "cast(meta.month as integer)", "day": "cast(meta.day as integer)", "vendor_id": "cast(value.vendor_id as integer)"}, "partition": "year,month,day,vendor_id"}, ["meta", "value", "year", "month", "day", "vendor_id"], 1),
])
def test_a_trip_in_a_lake_table(spark, tmp_path, options, columns, last):
    back = spark.read.parquet(lake.store(taxi(spark), str(tmp_path), "db", "taxi", **options))
    assert back.columns == columns
    row = back.first()
    if last is not None:
        assert row[-1] == last
    if "meta" in columns:
        assert (row.meta.partition, row.meta.timestamp, row.meta.year, row.value.trip_id, round(row.value.trip_distance, 6), row.value.store_and_fwd) == (32123, dt.datetime(1973, 10, 17, 18, 36, 57), 1973, 1000371, 1.8, 0)
    with pytest.raises(ValueError, match=r"no column value\.vendor_id"):
        lake.store(taxi(spark), str(tmp_path), "db", "other", partition="value.vendor_id")


def test_avro_numbers_in_a_lake_table(spark, tmp_path):
    schema = json.dumps({"type": "record", "name": "m", "fields": [{"name": "value", "type": {"type": "record", "name": "v", "fields": [{"name": "b", "type": "boolean"}, {"name": "c", "type": "int"}, {"name": "d", "type": "long"}, {"name": "e", "type": "float"}, {"name": "f", "type": "double"}, {"name": "h", "type": "string"}]}}]})
    own = Registry(spark, {"x.avsc": schema})["x"]
    value = {"b": False, "c": 2**31 - 1, "d": 2**63 - 1, "e": 3.4028234663852886e38, "f": 1.7976931348623157e308, "h": "pqr"}
    data = avro.write(avro.parse(own.part("value")), value)
    rows = spark.createDataFrame([("x", 7, 0, None, data)], "topic string, partition int, offset_id long, k binary, v binary").withColumn("ts", F.timestamp_millis(F.lit(1234567890000)))
    back = spark.read.parquet(lake.store(own.rows(rows), str(tmp_path), "db", "x", generated={"date": "cast(meta.timestamp as date)"})).first()
    assert back.value.asDict() == value and back.date == dt.date(2009, 2, 13) and back.meta.timestamp == dt.datetime(2009, 2, 13, 23, 31, 30)


def test_json_records_as_rows(spark, tmp_path):
    """meta, key and value; whole numbers long, the time as text, fields by name; rows that don't fit are left out."""
    schema = {"properties": {"key": {"type": "string", "pattern": "^\\d{3}-\\d{2}-\\d{4}$"}, "value": {"type": "object", "properties": {"last": {"type": "string"}, "first": {"type": "string"}, "test1": {"type": "number"}, "grade": {"type": "string"}}}}}
    own = Registry(spark, {"grade.json": json.dumps(schema)})["grade"]
    said = [(f'"{100 + i}-{i:02d}-{1000 + i}"', json.dumps({"last": f"L{i}", "first": f"F{i}", "test1": i + 0.5, "grade": "A"})) for i in range(16)]
    rows = spark.createDataFrame([("grade", 32123, i, k, v) for i, (k, v) in enumerate([*said, ('"x"', said[0][1])])], "topic string, partition int, offset_id long, k string, v string").withColumn("ts", F.timestamp_millis(F.lit(1234567890000)))
    out = own.rows(rows)
    assert out.columns == ["meta", "key", "value"] and out.schema["value"].dataType.fieldNames() == ["first", "grade", "last", "test1"]
    got = out.collect()
    assert len(got) == 16 and {tuple(r.meta) for r in got} == {(13, 2, 32123, "2009-02-13T23:31:30+00:00", 2009)}
    assert {r.key for r in got} == {k.strip('"') for k, _ in said} and dict(out.select("meta.*").dtypes) == {"day": "bigint", "month": "bigint", "partition": "bigint", "timestamp": "string", "year": "bigint"}


def test_avro_union_with_null(spark):
    own = Registry(spark, {"u.avsc": json.dumps({"type": "record", "name": "m", "fields": [{"name": "value", "type": ["null", "float"]}]})})["u"]
    parsed = avro.parse(own.part("value"))
    data = [avro.write(parsed, x) for x in (1.5, None, -2.25)]
    rows = spark.createDataFrame([("u", 0, i, None, x) for i, x in enumerate(data)], "topic string, partition int, offset_id long, k binary, v binary").withColumn("ts", F.lit(T0)).coalesce(1)
    assert [r.value for r in own.rows(rows).collect()] == [1.5, None, -2.25]


def test_a_table_whose_schema_grows(spark, tmp_path):
    steps = ["string email = 1;", "string email = 1; string full_name = 2;", "string email = 1; string full_name = 2; message Home { string no = 1; string city = 2; } Home home = 3; repeated string trade = 4;"]
    values = [{"email": "a@x"}, {"email": "b@x", "full_name": "B"}, {"email": "c@x", "full_name": "C", "home": {"no": "1", "city": "Y"}, "trade": ["p", "q", "r"]}]
    for text, value in zip(steps, values, strict=True):
        text = f'syntax = "proto3"; message Value {{ {text} }}'
        rows = spark.createDataFrame([("t", 0, 0, None, protobuf.encode(text, "Value", value))], "topic string, partition int, offset_id long, k binary, v binary").withColumn("ts", F.lit(T0))
        lake.store(Registry(spark, {"t.proto": text})["t"].rows(rows), str(tmp_path), "db", "t", normalize=True, separator="_")
    back = lake.load(spark, str(tmp_path), "db", "t").orderBy("value_email")
    assert [(r.value_email, r.value_full_name, r.value_home_city, r.value_trade) for r in back.collect()] == [("a@x", None, None, None), ("b@x", "B", None, None), ("c@x", "C", "Y", ["p", "q", "r"])]


def test_fetch_from_the_middle_of_a_batch(spark):
    rows = by_hand(spark, [(None, 0)] * 4)
    marks = spark.createDataFrame([("t", 0, 0, 4)], "topic string, partition int, low long, high long")
    for start in (1, 3):
        assert sorted(r.offset_id for r in log.fetch(rows, start, 1000, marks=marks).collect()) == list(range(start, 4))


def test_default_retention_is_a_week(spark):
    rows, marks = by_hand(spark, [(None, 0)] * 3), spark.createDataFrame([("t", 0, 0, 3)], "topic string, partition int, low long, high long")
    config = spark.createDataFrame([("t", "delete", None)], "topic string, policy string, retention_ms long")
    assert maintenance.maintain(rows, marks, config, F.lit(T0 + dt.timedelta(days=6)))[0].count() == 3
    kept, after = maintenance.maintain(rows, marks, config, F.lit(T0 + dt.timedelta(days=7, hours=1)))
    assert kept.count() == 0 and [(r.low, r.high) for r in after.collect()] == [(3, 3)]
    assert log.offsets_at(kept, marks, F.lit(T0)).first()[2:] == (0, None)


def test_registry(spark, tmp_path):
    (tmp_path / "person.json").write_text('{"properties": {"key": {"type": "string", "pattern": "^[0-9]+$"}, "value": {"type": "object", "properties": {"age": {"type": "integer", "minimum": 0}}}}}')
    (tmp_path / "other.txt").write_text("x")
    own = Registry(spark, str(tmp_path))
    assert list(own) == ["person"] and own.get("nobody") is None
    rows = spark.createDataFrame([('"12"', '{"age": 3}'), ('"x"', '{"age": 3}'), ('"1"', '{"age": -1}'), (None, '{"age": 1}'), ('"1"', None)], "k string, v string")
    assert [r[0] for r in rows.select(own["person"].valid(F.col("k"), F.col("v"))).collect()] == [True, False, False, False, False]
    for name, text in (("a.json", "{"), ("a.avsc", '{"type": "record", "fields": [{"name": "value", "type": {"type": "record"}}]}'), ("a.proto", "message Value { int64 = 1; }")):
        with pytest.raises((ValueError, KeyError)):
            Registry(spark, {name: text})


def test_made_up_records_do_not_depend_on_partitions(spark):
    kind = 'syntax = "proto3"; message Value { int64 id = 1; bool ok = 2; repeated int32 some = 3; map<string, int32> m = 4; bytes raw = 5; }'
    rows = generator.from_message(spark, 200, kind, "Value", {"some": {"repeated": {"range": [1, 4]}}}, seed=3)
    again = generator.from_message(spark, 200, kind, "Value", {"some": {"repeated": {"range": [1, 4]}}}, seed=3).repartition(9)
    got = sorted(map(str, rows.collect()))
    assert got == sorted(map(str, again.collect())) and got != sorted(map(str, generator.from_message(spark, 200, kind, "Value", seed=4).collect()))
    assert {r[0] for r in rows.select(F.size("some")).distinct().collect()} == {1, 2, 3, 4}


def test_storage(spark, tmp_path):
    rows = spark.createDataFrame([("t", 0, i) for i in range(5)], "topic string, partition int, n long")
    for url in (str(tmp_path / "a"), f"file://{tmp_path}/b", "memory://x"):
        place = storage.Storage(spark, url)
        assert place.open() is None
        place.put(rows, ["n"])
        assert place.open().marks.first()["high"] == 5
    assert storage.Storage(spark, "null://").put(rows, ["n"]) is None
    with pytest.raises(ValueError, match="postgres"):
        storage.Storage(spark, "postgres://x")
    batch = rows.withColumn("base_offset", F.lit(4).cast("long"))
    assert [f.rsplit("/", 3)[1:] for f in storage.put_batches(batch, str(tmp_path / "q"))] == [["t", "0000000000", "00000000000000000004.parquet"]]
    with pytest.raises(FileExistsError):
        storage.put_batches(batch, str(tmp_path / "q"))
    assert sorted(p.name for p in (tmp_path / "q").iterdir()) == ["t"]
    for n in (3, 2):
        assert storage.snapshot(spark.range(n), str(tmp_path / "s")).count() == n
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("s.")] == []


def test_z_values_stay_inside(spark):
    rows = spark.createDataFrame([(-5, 3), (70000, 0), (None, 1), (1, 1)], "a long, b long").coalesce(1)
    assert [r[0] for r in rows.select(lake.z_value(["a", "b"], 2)).collect()] == [10, 5, 2, 3]


def test_offsets_in_order_of_arrival_whatever_the_arrow_batch(spark, tmp_path):
    order = list(range(1000))
    random.Random(2).shuffle(order)
    spark.createDataFrame([("t", 0, i, str(i)) for i in order], "topic string, partition int, arrival long, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        stream = spark.readStream.schema("topic string, partition int, arrival long, v string").parquet(str(tmp_path / "in"))
        q = ingest.assigned(stream).writeStream.foreachBatch(ingest.to_lake(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r.offset_id == r.arrival for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_sequences_of_a_stream_as_of_a_table(spark, tmp_path):
    draw = random.Random(6)
    kinds = "producer_id long, epoch int, topic string, partition int, arrival long, base_sequence long, records long"
    rows, at = [], {}
    for i in range(60):
        p, t, n = draw.randrange(4), draw.choice("ab"), draw.randint(1, 3)
        base = at.get((p, t), 0) + draw.choice((0, 0, 0, -1, 2))
        if base == at.get((p, t), 0):
            at[p, t] = base + n
        rows.append((p, 0, t, 0, i, base, n))
    known = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "producer_id long, epoch int")
    for k in range(0, 60, 20):
        spark.createDataFrame(rows[k : k + 20], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.sequenced(stream, known).writeStream.foreachBatch(ingest.to_lake(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r.arrival: r.verdict for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.arrival: r.verdict for r in transactions.sequence_check(spark.createDataFrame(rows, kinds), known).collect()}
    assert got == want and len(set(got.values())) == 5


def test_schedule_deadline_and_limit(spark):
    now, runs = [0.0], []

    def job():
        runs.append(now[0])
        now[0] += 25 if len(runs) == 2 else 1

    done = ingest.scheduled(job, 10, lambda: now[0] >= 60, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert runs == [0, 10, 40, 50, 60][: len(runs)] and done == len(runs) >= 4  # the slow run skips 20 and 30
    rows = spark.createDataFrame([("t", 0, i, "k", "v" * 9) for i in range(5)], "topic string, partition int, n long, k string, v string")
    now[0], reads = 0.0, []

    def read():
        reads.append(now[0])
        return rows.limit(len(reads))

    assert ingest.polled(read, 30, 5, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s), every_s=1).count() == 3
    reads.clear()
    assert ingest.polled(read, 10_000, 2, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s), every_s=1).count() == 3
    assert [r.second for r in ingest.limited(rows, 2, ["n"]).orderBy("n").collect()] == [0, 0, 1, 1, 2]


def test_bytes_stay_bytes(spark):
    own = Registry(spark, {"x.json": "{}"})["x"]
    got = spark.createDataFrame([("é",)], "v string").select(F.base64(own.encoded(F.col("v"), "value"))).first()[0]
    assert base64.b64decode(got) == "é".encode()


def test_versions_of_a_lake_table(spark, tmp_path):
    own = LakeTable(spark, str(tmp_path / "t"))
    assert own.version().number == -1 and own.read().count() == 0
    first = spark.createDataFrame([(1, "a/b"), (2, None), (3, "c")], "id long, part string")
    assert own.append(first, ["part"], key="t/0/0") == 0 and own.append(first, ["part"], key="t/0/0") == 0
    assert own.append(spark.createDataFrame([(4, "c", 1.5)], "id long, part string, more double"), ["part"]) == 1
    assert sorted((r.id, r.part, r.more) for r in own.read().collect()) == [(1, "a/b", None), (2, None, None), (3, "c", None), (4, "c", 1.5)]
    assert own.read(0).columns == ["id", "part"] and own.read(0).count() == 3
    some = own.read(where={"part": "c"})
    assert sorted(r.id for r in some.collect()) == [3, 4] and len(some.inputFiles()) == 2
    assert [r.id for r in own.read(where={"part": None}).collect()] == [2] and [r.id for r in own.read(where={"id": "1"}).collect()] == [1]
    with pytest.raises(ValueError, match="column id is bigint, not string"):
        own.append(spark.createDataFrame([("x",)], "id string"))
    with pytest.raises(ValueError, match="no column x"):
        own.append(first, ["x"])
    with pytest.raises(ValueError, match="no version 9"):
        own.read(9)
    assert own.compact(1, ["id", "part"]) == 2
    assert sorted(r.id for r in own.read().collect()) == [1, 2, 3, 4] and len(own.read().inputFiles()) == 1 and own.read(1).count() == 4
    assert own.vacuum() == 2 and own.read().count() == 4 and own.append(first, ["part"], key="t/0/0") == 2


def test_two_writers_of_a_lake_table(spark, tmp_path):
    """A commit that another writer has made first is tried again as the next one; files that another has replaced are a conflict."""
    rows = spark.range(5)
    one, two = LakeTable(spark, str(tmp_path / "t")), LakeTable(spark, str(tmp_path / "t"))
    one.append(rows)
    create = two._create
    two._create = lambda n, own: (one.append(rows.selectExpr("id + 10 as id")), setattr(two, "_create", create), create(n, own))[2]
    assert two.append(rows.selectExpr("id + 20 as id")) == 2 and two.read().count() == 15
    two._create = lambda n, own: (one.append(rows.selectExpr("id + 30 as id")), setattr(two, "_create", create), create(n, own))[2]
    assert two.compact(1) == 4 and two.read().count() == 20
    two._create = lambda n, own: (one.compact(1), setattr(two, "_create", create), create(n, own))[2]
    with pytest.raises(Conflict):
        two.compact(2)
    assert one.read().count() == 20
    two._create = lambda n, own: (one.append(rows, key="k"), setattr(two, "_create", create), create(n, own))[2]
    assert two.append(rows, key="k") == one.version().number and one.read().count() == 25
