"""Lake tables: flattening, generated columns, partition checks, added columns, order on a z curve, Parquet files with exact names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as top-level columns whose names are their paths."""

    def walk(fields: list[T.StructField], path: tuple[str, ...]) -> list[Column]:
        out: list[Column] = []
        for f in fields:
            own = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType.fields, own)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in own)).alias(separator.join(own)))
        return out

    return df.select(*walk(df.schema.fields, ()))


def generate(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Columns made by SQL expressions."""
    return df.select("*", *[F.expr(e).alias(name) for name, e in expressions.items()])


def partition_columns(df: DataFrame, setting: str) -> list[str]:
    """The names in a comma list; each must be a column."""
    names = [x.strip() for x in setting.split(",") if x.strip()]
    for name in names:
        if name not in df.columns:
            raise ValueError(f"no column {name} to partition by: the table has {', '.join(df.columns)}")
    return names


def meta(partition: Column, ts: Column) -> Column:
    return F.struct(partition.cast("int").alias("partition"), ts.alias("timestamp"), F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"))


def json_meta(partition: Column, ts: Column) -> Column:
    """meta as JSON has it: whole numbers are long, the time is text with its offset, fields stand in order of name."""
    at = F.regexp_replace(F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0*$", "")
    at = F.when(F.unix_micros(ts.cast("timestamp")) % 1_000_000 == 0, F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")).otherwise(at)
    return F.struct(F.dayofmonth(ts).cast("long").alias("day"), F.month(ts).cast("long").alias("month"), partition.cast("long").alias("partition"), F.concat(at, F.lit("+00:00")).alias("timestamp"), F.year(ts).cast("long").alias("year"))


def merged(tables: list[DataFrame]) -> DataFrame:
    """Tables of growing schemas as one: columns are added by name, older rows are null there; a changed type is an error."""
    out = tables[0]
    for t in tables[1:]:
        for c, kind in t.dtypes:
            if c in out.columns and dict(out.dtypes)[c] != kind:
                raise ValueError(f"column {c} is {dict(out.dtypes)[c]}, not {kind}")
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def z_value(columns: list[str], bits: int = 16) -> Column:
    """Interleaved bits of whole-number columns. What lies outside [0, 2**bits), or is null, counts as the nearest number inside (null as 0)."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for i, c in enumerate(columns):
            inside = F.greatest(F.lit(0).cast("long"), F.least(F.lit((1 << bits) - 1).cast("long"), F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))))
            bit = F.shiftright(inside, b).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, b * len(columns) + i))
    return out


def z_ordered(df: DataFrame, columns: list[str], files: int) -> DataFrame:
    """df in files of neighbours on the z curve."""
    return df.withColumn("_z", z_value(columns)).repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z")


def batch_path(root: str, topic: str, partition: int, offset: int) -> str:
    return f"{root}/{topic}/{partition:010d}/{offset:020d}.parquet"


#: Codecs of lake files by the names that batches have for them.
COMPRESSION = {"none": "uncompressed", "gzip": "gzip", "snappy": "snappy", "lz4": "lz4", "zstd": "zstd"}


def for_lake(log: DataFrame, topics: list[str] | None = None) -> DataFrame:
    """What reaches lake tables: no control records, and where topics with a schema are named, only theirs."""
    rows = log.where(F.coalesce(F.col("attributes"), F.lit(0)).bitwiseAND(32) == 0) if "attributes" in log.columns else log
    return rows if topics is None else rows.where(F.col("topic").isin(*topics))


def ranked(df: DataFrame, columns: list[str], bits: int = 16) -> DataFrame:
    """df with _z0, _z1, ...: for each column the place of its value's quantile among 2**bits, so that columns of any ordered type have a z value."""
    out = df
    for i, c in enumerate(columns):
        kinds = dict(df.dtypes)
        number = F.col(f"`{c}`").cast("double") if kinds[c] not in ("timestamp", "timestamp_ntz", "date") else F.unix_micros(F.col(f"`{c}`").cast("timestamp")).cast("double")
        if kinds[c] == "string":
            number = F.conv(F.rpad(F.substring(F.hex(F.col(f"`{c}`").cast("binary")), 1, 12), 12, "0"), 16, 10).cast("double")
        low, high = df.agg(F.min(number), F.max(number)).first()
        span = (high - low) or 1.0 if low is not None else 1.0
        out = out.withColumn(f"_z{i}", F.floor((number - F.lit(low or 0.0)) / span * ((1 << bits) - 1)))
    return out


def compacted(spark: SparkSession, at: str, files: int, z_order: list[str] | None = None) -> DataFrame:
    """The rows of a table in `files` files of like size, in order of the z curve where columns for one are named; the caller stores it as a snapshot."""
    df = spark.read.option("mergeSchema", "true").parquet(at)
    if not z_order:
        return df.repartition(files)
    own = ranked(df, z_order)
    names = [f"_z{i}" for i in range(len(z_order))]
    return own.withColumn("_z", z_value(names)).repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z", *names)


def prepared(df: DataFrame, normalize: bool = False, separator: str = ".", partition: str = "", generated: dict[str, str] | None = None, z_order: str = "") -> tuple[DataFrame, list[str]]:
    """(rows as a table has them, columns that part it), by a topic's options. z_order: columns of whose z curve each file gets a run."""
    out = generate(df, generated or {})
    if normalize:
        out = flatten(out, separator)
    names = partition_columns(out, partition)
    order = [x.strip() for x in z_order.split(",") if x.strip()]
    if order:
        own = [f"_z{i}" for i in range(len(order))]
        out = ranked(out, order).withColumn("_z", z_value(own)).repartitionByRange("_z").sortWithinPartitions("_z").drop("_z", *own)
    return out, names


def store(df: DataFrame, root: str, database: str, topic: str, mode: str = "append", compression: str = "snappy", **options) -> str:
    """Write to the table at root/database.topic, which is created where it is absent; gives its path. options: as of prepared(); mode: append, or ignore (only create)."""
    out, names = prepared(df, **options)
    at = f"{root}/{database}.{topic}"
    out.write.mode(mode).option("compression", COMPRESSION[compression]).partitionBy(*names).parquet(at)
    return at


def load(spark: SparkSession, root: str, database: str, topic: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/{database}.{topic}")
