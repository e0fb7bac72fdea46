"""What the operators of this package share: tables, scratch tables, columns in Arrow batches, samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that part words: [\x20\x09-\x0D]. bytes.split() without arguments parts at exactly these.
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def every(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """df.mapInArrow(run) with df's own columns, whatever characters their names hold; batches have other names."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def beside_text(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: str) -> DataFrame:
    """df's columns but text, then those of `more` (as DDL), which replace columns of the same names. run gets the text last and puts the new columns in its place."""
    new = [x.split(" ")[0] for x in more.split(", ")]
    rest = [(x, c) for x, c in zip(every(df), df.columns, strict=True) if c != "text" and c.lower() not in new]
    rows = df.select(*[x for x, _ in rest], F.col("text").cast("string")).toDF(*[f"c{i}" for i in range(len(rest))], "text")
    kinds = "".join(f"{c} {t}, " for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, kinds + more).toDF(*[c for _, c in rest], *new)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset and all executors are threads of this machine's driver, a local one that is then set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="strandlog-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, computes df once."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/strandlog-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._strandlog_path = at
    if _scratch:
        _scratch[-1].append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that written() makes within are deleted at the end, but for those given to the function that this yields, which go to the block around it."""
    own: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _scratch.append(own)
    try:
        yield keep
    finally:
        _scratch.remove(own)
        for df in own:
            if not any(df is x for x in kept):
                discard(df)
            elif _scratch:
                _scratch[-1].append(df)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing will read it again."""
    at = getattr(df, "_strandlog_path", None)
    if at:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer long texts in each Arrow batch, on both sides, where several stages share the executors' memory. A smaller setting stays."""
    own = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if own <= 0 or own > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows where it is 2 are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def sampled(df: DataFrame, key: Column, most: int) -> DataFrame:
    """About `most` rows at most, picked by a hash of the key: the same rows in every run. Bounds what training collects.

    The key should tell rows apart, text and all: rows that share it are taken all or none.
    """
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(20231)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def small(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that working arrays stay small whatever the batch size is."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), for hashed features."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def ngram_slots(chars: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash slots (below 2**bits) of the character n-grams of one text."""
    m = len(chars) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    c = chars.astype(np.uint64)
    h = np.full(m, n * 0x9E3779B9, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + c[k : k + m]
    return (mixed(h) >> np.uint64(64 - bits)).astype(np.int64)
