"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected copies (target / size of the source), so the prefix sum of
expected copies is rate * rank. One random offset u in [0, 1) is added, and a document is taken once for each whole number that its
interval [u + rate * rank, u + rate * (rank + 1)) crosses. Documents stand in order of size, so that neighbours are alike and the
words taken come within about one large document of the target.

Rows: a null text has size 0; a null source is a source of its own, last; repeated rows are ranked like others;
a source without words has target 0 and gives nothing. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import every, raw, small, table, written

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Sources that the driver gets, a name and three numbers each; more are an error, as a column of that many values names no feeds.
MOST_SOURCES = 500_000


def sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns and size: words of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole):
                size = np.array([len(x.split()) for x in raw(batch.column(batch.num_columns - 1))], np.int64)
                yield pa.record_batch([*batch.columns[:-1], pa.array(size)], names=[*batch.schema.names[:-1], "size"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "_text") + ", size long")


def filled(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Targets by weight that sum to share * sum(sizes); none above most * its size, the excess goes to the others by weight."""
    total, caps = share * sum(sizes), [most * x for x in sizes]
    own = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = (total - sum(out[i] for i in range(len(sizes)) if i not in open_)) / sum(own[i] for i in open_)
        over = {i for i in open_ if own[i] * level > caps[i]}
        if not over:
            for i in open_:
                out[i] = own[i] * level
            break
        for i in over:
            out[i] = caps[i]
        open_ -= over
    return out


def offset(seed: int, source: str | None) -> float:
    """The source's random offset in [0, 1): the same in every run."""
    said = hashlib.sha256(f"{seed}:{'' if source is None else 'S' + source}".encode()).digest()
    return int.from_bytes(said[:6], "big") / float(1 << 48)


def mixed_counts(sizes: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (doc_id, source, size, ...), a written table -> its columns and source_size, target, copies. Ties go by the further columns.

    The driver gets one row per source (sources are named feeds, not documents). Ranks come from one range partitioning: the
    place in the sorted partition, less the source's first place there, plus the source's rows in earlier partitions.
    """
    by_source = written(sizes.groupBy("source").agg(F.sum("size").alias("n")))
    if by_source.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals = sorted(by_source.collect(), key=lambda r: (r.source is None, [ord(c) for c in r.source or ""]))
    targets = filled([r.n for r in totals], weights, share, most)
    plan = [(r.source, r.n, t, t / r.n if r.n else 0.0, offset(seed, r.source)) for r, t in zip(totals, targets, strict=True)]
    plan = sizes.sparkSession.createDataFrame(plan, "source string, source_size long, target double, rate double, u double")
    key = [F.col("source"), F.col("size").desc(), F.col("doc_id"), *(F.col(c) for c in sizes.columns if c not in ("doc_id", "source", "size"))]
    ranked = sizes.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("place", F.monotonically_increasing_id())
    ranked = written(ranked.withColumn("part", F.shiftright("place", 33)))
    runs = ranked.groupBy("source", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    runs = runs.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n"))
    runs = runs.join(plan, runs.source.eqNullSafe(plan.source), "left").drop(plan.source)
    runs = runs.withColumnsRenamed({"source": "_source", "part": "_part"}).drop("n")
    out = ranked.join(runs, ranked.source.eqNullSafe(F.col("_source")) & (ranked.part == F.col("_part")))
    rank = F.col("place") - F.col("first") + F.col("before")
    copies = F.floor(F.col("u") + F.col("rate") * (rank + 1)) - F.floor(F.col("u") + F.col("rate") * rank)
    return out.withColumn("copies", copies).select(*sizes.columns, "source_size", "target", "copies")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(sized(table(spark, sf_dir, "documents"), ["doc_id", "source"]))
    return mixed_counts(sizes).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def oracle(seed: int = 17) -> str:
    """The same rows in DuckDB."""
    return f"""
with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
offs as (select distinct source, ('0x' || substr(sha256('{seed}:' || coalesce('S' || source, '')), 1, 12))::bigint / 281474976710656.0::double as u from documents),
s as (select source, sum(size)::bigint as n, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w from d group by source),
l(step, level) as (
  select 0, 1.5 * sum(n) / sum(w) from s
  union all
  select step + 1, (select (1.5 * sum(n) - sum(case when w * level > 2.0 * n then 2.0 * n else 0 end)) / nullif(sum(case when w * level > 2.0 * n then 0 else w end), 0) from s)
  from l where step < (select count(*) from s)),
t as (select source, n, least(2.0 * n, w * coalesce((select max(level) from l), 1e300))::double as target from s),
r as (select d.*, row_number() over (partition by source order by size desc, doc_id) - 1 as k from d)
select r.doc_id, r.size, t.n as source_size, t.target,
  r.size * (floor(u + (case when n > 0 then target / n else 0 end) * (k + 1)) - floor(u + (case when n > 0 then target / n else 0 end) * k))::bigint as taken
from r join t on r.source is not distinct from t.source join offs on r.source is not distinct from offs.source"""


def mixture(docs: DataFrame, seed: int = 17) -> DataFrame:
    """docs with each row as often as the mix takes it. Columns as in docs.

    The rows' copies are a written table of keys, so Catalyst knows its size: below the broadcast threshold no text is shuffled but those of
    rows that repeat, above it texts are joined by key. Rows are told apart by 128 bits of hash over all columns that Spark can hash (all but maps), and over which of them are null.
    """
    told = [x for x, (_, t) in zip(every(docs), docs.dtypes, strict=True) if "map<" not in t]
    told += [x.isNull() for x in told]
    keys = [F.xxhash64(*told).alias("_key"), F.xxhash64(F.lit(1), *told).alias("_key2")]
    rows = docs.select(F.struct(*every(docs)).alias("_row"), *keys, "doc_id", "source", "text")
    counts = mixed_counts(written(sized(rows.drop("_row"), ["doc_id", "source", "_key", "_key2"])), seed)
    counts = written(counts.groupBy("_key", "_key2").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0"))
    rows = rows.select("_row", "_key", "_key2")
    taken = rows.join(counts.where("rows = 1"), ["_key", "_key2"]).select("_row", "copies")
    again = counts.where("rows > 1")
    if not again.isEmpty():  # equal rows are one row with the sum of their copies
        once = rows.join(again.select("_key", "_key2"), ["_key", "_key2"], "left_semi").dropDuplicates(["_key", "_key2"])
        taken = taken.union(once.join(again, ["_key", "_key2"]).select("_row", "copies"))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
