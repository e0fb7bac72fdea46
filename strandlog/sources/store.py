"""Stored logs: records with offsets in files by topic and partition, sorted by offset, and their watermarks beside them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators.log import TOPITION, numbered, watermarks

_kept: dict[tuple, LogStore] = {}


@dataclass
class LogStore:
    """log: the records; marks: topic, partition, low and high as stored, which deletion of records does not move back."""

    log: DataFrame
    marks: DataFrame
    path: str


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir says; a local one only where executors are threads of the driver."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="strandlog-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    at = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def opened(spark: SparkSession, path: str, schema) -> LogStore:
    """A store by its folder. Filters on topic and partition choose files, those on offset_id choose row groups."""
    log = spark.read.schema(schema).parquet(f"{path}/records").select(*schema.fieldNames())
    return LogStore(log, spark.read.parquet(f"{path}/marks"), path)


def store(rows: DataFrame, order: list[str], path: str) -> LogStore:
    """rows (topic, partition, ...) with offsets in `order`, written at path. The log is dealt by ranges, so one large topition is no single task."""
    log = numbered(rows, order, written)
    log.sortWithinPartitions(*TOPITION, "offset_id").write.partitionBy(*TOPITION).parquet(f"{path}/records")
    own = rows.sparkSession.read.schema(log.schema).parquet(f"{path}/records").select(*log.columns)
    watermarks(own).coalesce(1).write.parquet(f"{path}/marks")
    return opened(rows.sparkSession, path, log.schema)


def _version(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of a table's files, by whatever store holds them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)))


def kept(spark: SparkSession, path: str, make: Callable[[], DataFrame], order: list[str]) -> LogStore:
    """The stored log of a table, made once in an application for each state of the table's files."""
    key = (spark.sparkContext.applicationId, path, _version(spark, path))
    if key not in _kept:
        _kept[key] = store(make(), order, f"{shared_dir(spark)}/log-{uuid.uuid4().hex}")
    return _kept[key]
