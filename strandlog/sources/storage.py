"""Where logs are kept, by URL scheme; batches as Parquet files of exact names; snapshots; records as JSON lines."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators import transactions
from strandlog.operators.lake import batch_path
from strandlog.operators.log import TOPITION

from .store import LogStore, opened, shared_dir, store

#: Schemes of paths that Spark reads and writes itself.
PATHS = frozenset(("", "file", "hdfs", "viewfs", "s3", "s3a", "gs", "abfs", "abfss"))
_memory: dict[tuple[str, str], str] = {}


class Storage:
    """A place for records (topic, partition, ...): put() numbers and stores them, open() gives the log and its watermarks, None before anything is stored."""

    def __init__(self, spark: SparkSession, url: str):
        self.spark, self.scheme, self.url = spark, urlsplit(url).scheme, url
        if self.scheme == "memory":  # of this application only
            self.path = _memory.setdefault((spark.sparkContext.applicationId, url), f"{shared_dir(spark)}/memory-{uuid.uuid4().hex}")
        elif self.scheme in PATHS:
            self.path = url.rstrip("/")
        elif self.scheme == "null":
            self.path = ""
        else:
            raise ValueError(f"no storage for {self.scheme}: {', '.join(sorted(PATHS - {''}))}, memory, null")
        self.schema = None

    def put(self, rows: DataFrame, order: list[str]) -> LogStore | None:
        if not self.path:  # everything is accepted, nothing is stored
            rows.write.format("noop").mode("overwrite").save()
            return None
        own = store(rows, order, self.path)
        self.schema = own.log.schema
        return own

    def open(self) -> LogStore | None:
        return opened(self.spark, self.path, self.schema) if self.schema is not None else None


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def put_batches(rows: DataFrame, root: str, base: str = "base_offset") -> list[str]:
    """Each batch (topic, partition, base) as one file root/topic/partition/offset.parquet, all or none of them; a file that is there already is an error.

    Spark writes a folder for each batch beside the root; the driver then renames a file of each, as many as there are batches.
    """
    spark = rows.sparkSession
    beside = f"{root}/_{uuid.uuid4().hex}"
    keys = [*TOPITION, base]
    named = rows.withColumns({f"_{c}": F.col(c) for c in keys})
    named.repartition(*keys).write.partitionBy(*[f"_{c}" for c in keys]).parquet(beside)
    fs, at = _fs(spark, beside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    batches = [(r.topic, r.partition, r[base]) for r in rows.select(*keys).distinct().collect()]  # one a batch
    moves = []
    for topic, partition, offset in batches:
        own = path(f"{beside}/_topic={topic}/_partition={partition}/_{base}={offset}")
        files = [s.getPath() for s in fs.listStatus(own) if s.getPath().getName().endswith(".parquet")]
        to = path(batch_path(root, topic, partition, offset))
        if len(files) != 1 or fs.exists(to):
            fs.delete(at, True)
            raise FileExistsError(str(to)) if len(files) == 1 else ValueError(f"{len(files)} files of {own}")
        moves.append((files[0], to))
    for of, to in moves:
        fs.mkdirs(to.getParent())
        if not fs.rename(of, to):
            raise FileExistsError(str(to))
    fs.delete(at, True)
    return sorted(str(to) for _, to in moves)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """df as a table at path, which is either the old one or the whole new one: it is written beside it and renamed."""
    spark = df.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(beside)
    fs, at = _fs(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{beside}.old")
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), at)
    fs.delete(old, True)
    return spark.read.schema(df.schema).parquet(path)


def console(log: DataFrame, marks: DataFrame, txns: DataFrame, topic: str, start: int = 0) -> DataFrame:
    """What a consumer of committed records sees of a topic: a JSON line for each, in order of partition and offset."""
    rows = transactions.read_committed(log.where((F.col("topic") == topic) & (F.col("offset_id") >= start)), marks, txns)
    line = F.to_json(F.struct("partition", F.col("offset_id").alias("offset"), F.col("k").alias("key"), F.col("v").alias("value")))
    return rows.select("partition", "offset_id", line.alias("line")).orderBy("partition", "offset_id")
