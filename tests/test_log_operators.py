import datetime as dt
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlog.functions import avro, json_schema, protobuf, scalar
from strandlog.operators import lake, log, maintenance
from strandlog.sources import records

LOG = "topic string, partition int, offset_id long, ts timestamp, k string, v string"
T0 = dt.datetime(2024, 1, 1)


def records_of(spark, *kv):
    return spark.createDataFrame([("t", 0, i, T0 + dt.timedelta(hours=i), k, v) for i, (k, v) in enumerate(kv)], LOG)


def test_compaction_keeps_the_last_of_a_key(spark):
    rows = records_of(spark, ("sensor-7", "19C"), (None, "boot"), ("sensor-9", "4C"), ("sensor-7", "21C"), (None, "halt"), ("sensor-7", None))
    kept = maintenance.compact(rows)
    assert sorted((r.offset_id, r.v) for r in kept.collect()) == [(1, "boot"), (2, "4C"), (4, "halt"), (5, None)]
    assert sorted(map(str, maintenance.compact(kept).collect())) == sorted(map(str, kept.collect()))
    head = records_of(spark, ("sensor-9", "5C"))
    assert [r.offset_id for r in maintenance.compact(rows, head=head).orderBy("offset_id").collect()] == [1, 4, 5]
    assert maintenance.compact(rows, head=head.withColumn("topic", F.lit("other"))).count() == 4


def test_retention_by_row_and_by_prefix(spark):
    rows = spark.createDataFrame([("t", 0, i, T0 + dt.timedelta(hours=h), "k", "v") for i, h in enumerate((0, 5, 1, 6))], LOG)
    now = F.lit(T0 + dt.timedelta(hours=7))
    assert [r.offset_id for r in maintenance.retain(rows, now, 3 * 3_600_000, prefix=False).orderBy("offset_id").collect()] == [1, 3]
    kept = maintenance.retain(rows, now, 3 * 3_600_000)
    assert [r.offset_id for r in kept.orderBy("offset_id").collect()] == [1, 2, 3]
    assert maintenance.low_after(log.watermarks(rows), kept).first()["low"] == 1
    assert maintenance.retain(rows, F.lit(T0 + dt.timedelta(days=9))).count() == 0


def test_fetch_pages_make_the_whole_log(spark):
    rows = records_of(spark, *[(str(i), "v" * (i % 7)) for i in range(40)])
    at, seen = 0, []
    while at < 40:
        page = [r.offset_id for r in log.fetch(rows, at, 12, at_least_one=True).orderBy("offset_id").collect()]
        seen += page
        at = page[-1] + 1
    assert seen == list(range(40))
    assert log.fetch(rows, 0, 1).count() == 0


def test_flatten_partition_and_merge(spark, tmp_path):
    df = spark.range(3).select(F.struct(F.col("id").alias("vendor_id"), F.lit(T0).alias("timestamp")).alias("meta"))
    assert lake.flatten(df).columns == ["meta.vendor_id", "meta.timestamp"]
    with pytest.raises(ValueError, match="no column meta.vendor_id to partition by"):
        lake.partition_columns(df, "meta.vendor_id")
    at = lake.store(df, str(tmp_path), "db", "taxi", normalize=True, partition="meta.vendor_id", generated={"date": "cast(meta.timestamp as date)"})
    back = spark.read.parquet(at)
    assert back.columns == ["meta.timestamp", "date", "meta.vendor_id"] and back.count() == 3
    lake.store(spark.range(1).select(F.lit(1).alias("a")), str(tmp_path), "db", "grow")
    lake.store(spark.range(1).select(F.lit(1).alias("a"), F.lit("x").alias("b")), str(tmp_path), "db", "grow")
    assert sorted(map(tuple, lake.load(spark, str(tmp_path), "db", "grow").collect()), key=str) == [(1, "x"), (1, None)]
    with pytest.raises(ValueError, match="column a"):
        lake.merged([spark.range(1).select(F.lit(1).alias("a")), spark.range(1).select(F.lit("1").alias("a"))])
    assert lake.z_ordered(spark.range(64).selectExpr("id % 8 as x", "id div 8 as y"), ["x", "y"], 4).count() == 64


def test_json_validation_and_types(spark):
    person = {"type": "object", "properties": {"firstName": {"type": "string"}, "age": {"type": "integer", "minimum": 0}}, "required": ["age"]}
    df = spark.createDataFrame([('{"firstName": "a", "age": 1}',), ('{"age": -1}',), ('{"firstName": 2, "age": 1}',), ("{}",), ("x",), (None,), ('{"age": 1.5}',)], "v string")
    assert [r[0] for r in df.select(json_schema.valid(F.col("v"), person)).collect()] == [True, False, False, False, False, False, False]
    with pytest.raises(json_schema.NoCommonType):
        json_schema.decoded(spark.createDataFrame([('{"a": 1}',), ('{"a": "x"}',)], "v string"), "v")
    with pytest.raises(ValueError, match="dependentRequired"):
        json_schema.valid(F.col("v"), {"dependentRequired": {}})


AVRO = '{"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}, {"name": "c", "type": {"type": "array", "items": "double"}}, {"name": "d", "type": {"type": "map", "values": "int"}}, {"name": "e", "type": {"type": "enum", "name": "u", "symbols": ["X", "Y"]}}, {"name": "t", "type": {"type": "long", "logicalType": "timestamp-micros"}}]}'


@settings(max_examples=60, deadline=None)
@given(st.fixed_dictionaries({"a": st.integers(-(2**63), 2**63 - 1), "b": st.none() | st.text(), "c": st.lists(st.floats(allow_nan=False)), "d": st.dictionaries(st.text(), st.integers(-(2**31), 2**31 - 1)), "e": st.sampled_from("XY"), "t": st.datetimes(dt.datetime(1960, 1, 1), dt.datetime(2200, 1, 1))}))
def test_avro_round_trip(value):
    s = avro.parse(AVRO)
    assert avro.read(s, avro.write(s, value))[0] == value


def test_avro_column(spark):
    s = avro.parse('{"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}]}')
    df = spark.createDataFrame([(avro.write(s, {"a": 5, "b": "x"}),), (avro.write(s, {"a": 6, "b": None}),), (b"",), (None,)], "x binary")
    got = [r[0] for r in df.select(avro.decode(F.col("x"), '{"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}]}')).collect()]
    assert [(r.valid, r.value.a if r.value else None) for r in got] == [(True, 5), (True, 6), (False, None), (False, None)]


PROTO = """syntax = "proto3"; // a comment
message Value { int64 vendor_id = 1; double fare = 2; enum Flag { N = 0; Y = 1; } Flag flag = 3; repeated string tags = 4;
  message Home { string city = 1; } Home home = 5; map<string, int32> counts = 6; }"""


def test_protobuf_column(spark):
    data = protobuf.encode(PROTO, "Value", {"vendor_id": 7, "fare": 1.5, "flag": "Y", "tags": ["a", "b"], "home": {"city": "X"}, "counts": {"k": 3}})
    got = spark.createDataFrame([(data,), (b"\xff",)], "x binary").select(protobuf.decode(F.col("x"), PROTO, "Value").alias("r")).collect()
    v = got[0].r.value
    assert (v.vendor_id, v.fare, v.flag, v.tags, v.home.city, v.counts) == (7, 1.5, 1, ["a", "b"], "X", {"k": 3})
    assert not got[1].r.valid
    assert '"vendor_id": "7"' in protobuf.to_json(PROTO, "Value", data)


def test_uuid5_and_sources(spark, tmp_path):
    names = ["a", "tag:x:virtual:t:k", "é", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(scalar.uuid5(F.col("n"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    (tmp_path / "x.json").write_text('[{"key": "1", "value": {"a": 1}}, {"other": 2}, {"value": 3}]')
    assert records.json_records(spark, str(tmp_path / "x.json")).collect() == [("1", '{"a":1}'), (None, "3")]
    (tmp_path / "y.json").write_text('[{"key": null, "value": null}, {"key": [1, "é"], "value": {"b": {"c": null}, "a": "x y"}},\n {"key": "k\\"q", "value": true}]')
    assert records.json_records(spark, str(tmp_path / "y.json")).collect() == [('[1,"é"]', '{"a":"x y","b":{"c":null}}'), ('k"q', "true")]
    assert records.customers(spark, 5).collect() == records.customers(spark, 5).collect()
    assert records.trips(spark, 9).where("trip_distance between 0 and 20").count() == 9


def test_offsets_and_lake_in_a_stream(spark, tmp_path):
    from strandlog.streaming import ingest

    schema = "topic string, partition int, arrival long, v string"
    for i in range(3):
        spark.createDataFrame([("t", p, 10 * i + j, f"{i}{j}") for p in (0, 1) for j in range(4)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.assigned(stream).writeStream.foreachBatch(ingest.to_lake(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.partition, r.offset_id) for r in out.collect()) == [(p, i) for p in (0, 1) for i in range(12)]
