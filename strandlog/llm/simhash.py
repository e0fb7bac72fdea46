"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits, one row per distinct fingerprint is indexed. For radius r every bit position gets a
fixed vector of r + 1 bits; table v (each non-zero vector of r + 1 bits) keeps the positions whose vector has an odd
product with v. The positions in which two fingerprints within the radius differ span at most r dimensions, so some v is
orthogonal to all of them: that table keeps none of them and the pair collides there. No pair is missed.

Rows: a null text has no words; a text without words has fingerprint zero, which is linked like any other. Copies share a fingerprint
and cost one row of the index. Extra columns are ignored. An empty table gives an empty result. A null doc_id is kept as a row
whose id is null and is never the name of a component with other ids. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, every, fresh, raw, scratch, small, table, written
from .components import components

BITS, SEED = 64, 42


def fingerprints(docs: list[bytes], width: int = 4) -> np.ndarray:
    """SimHash of each text: bit i is set if over half of the shingles' XXH64 have it."""
    sizes, hashes = [], []
    for doc in docs:
        words = doc.lower().split()
        text = b" ".join(words)
        if len(words) <= width:
            own = [xxhash.xxh64_intdigest(text, SEED)] if words else []
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = [0, *(ends[: len(words) - width] + 1).tolist()]
            own = [xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
        sizes.append(len(own))
        hashes.append(np.array(own, np.uint64))
    out = np.zeros(len(docs), np.uint64)
    place = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    for i, (n, own) in enumerate(zip(sizes, hashes, strict=True)):
        if n:
            ones = np.zeros(BITS, np.int64)
            for k in range(0, n, 65536):
                ones += np.unpackbits(own[k : k + 65536].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
            out[i] = place[2 * ones > n].sum(dtype=np.uint64)
    return out


def fingerprinted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp long): the fingerprint's 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole):
                yield pa.record_batch([batch.column(0), pa.array(fingerprints(raw(batch.column(1)), width).view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def _signed(m: int) -> int:
    return m - (1 << BITS) if m >> (BITS - 1) else m


def masks(radius: int, positions: list[int] | None = None) -> list[int]:
    """The kept bits of each table, as signed 64-bit numbers. Positions (by default all) deal out the non-zero vectors evenly."""
    size = 1 << (radius + 1)
    own = {i: k % (size - 1) + 1 for k, i in enumerate(range(BITS) if positions is None else positions)}
    return [_signed(sum(1 << i for i, x in own.items() if (x & v).bit_count() % 2)) for v in range(1, size)]


def finer(radius: int) -> list[list[int]]:
    """For each table the masks that split its buckets: those of a covering of the positions that it doesn't keep."""
    return [masks(radius, [i for i in range(BITS) if not m >> i & 1]) for m in masks(radius)]


def near_edges(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the components of "at most radius bits differ" in one bucket; as many as values at most, not all pairs."""
    todo, a, b = values, [], []
    while len(todo):
        root, front, todo = todo[0], [todo[0]], todo[1:]
        while front and len(todo):
            near = np.bitwise_count(todo ^ front.pop()) <= radius
            if near.any():
                found = todo[near]
                todo = todo[~near]
                front.extend(found)
                a.append(np.full(len(found), root))
                b.append(found)
    none = np.zeros(0, values.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


#: What names a unit of pairs: table and key, finer table and key, two blocks.
UNIT = ["t", "key", "t2", "key2", "lo", "hi"]


def _bucket_edges(radius: int):
    def pairs(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows sorted by bucket."""
        key = pdf[UNIT].to_numpy()
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        fp, sizes = pdf["fp"].to_numpy().view(np.uint64), np.diff(np.r_[new, len(pdf)])
        two = new[sizes == 2]
        ok = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
        out = [(fp[two][ok], fp[two + 1][ok])]
        out += [near_edges(fp[s : s + n], radius) for s, n in zip(new[sizes > 2], sizes[sizes > 2], strict=True)]
        a, b = (np.concatenate([x[i] for x in out]).view(np.int64) for i in (0, 1))
        if len(a):
            yield pd.DataFrame({"a": a, "b": b})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (pdf[UNIT] == pdf[UNIT].iloc[-1]).all(axis=1).to_numpy()
            held = pdf[last]
            if not last.all():
                yield from pairs(pdf[~last])
        if held is not None and len(held):
            yield from pairs(held)

    return run


def links(distinct: DataFrame, radius: int = 4, block: int = 512, hot: int = 16_384) -> DataFrame:
    """distinct (fp long) -> edges (a, b) with the components of "at most radius bits differ".

    Buckets of one fingerprint cost a count only. A bucket above `hot` is split by a second covering, of the bits that its table doesn't keep: each
    of its pairs within the radius meets in one of that covering's tables, which costs as many rows a fingerprint as there are tables, however large
    the bucket. What remains above `block` is split into blocks by hash, and each pair of blocks is a unit of its own: no task gets a whole large
    bucket, and no pair is lost. With 64 bits a bucket split twice has about 2**16 fingerprints at most, so the number of blocks is bounded.
    """
    every_ = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)])).alias("t", "key"))
    full = written(every_.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))  # few, so mostly broadcast by its size
    rows = every_.join(full, ["t", "key"])
    fine = F.element_at(F.array(*[F.lit(m) for m in finer(radius)]), F.col("t") + 1)
    split = F.transform(fine, lambda m: F.col("fp").bitwiseAND(m))
    cold = rows.where(F.col("n") <= hot).select("t", "key", F.lit(-1).alias("t2"), F.lit(0).cast("long").alias("key2"), "fp", "n")
    warm = rows.where(F.col("n") > hot).select("t", "key", F.posexplode(split).alias("t2", "key2"), "fp")
    counts = warm.groupBy("t", "key", "t2", "key2").agg(F.count("*").alias("n")).where("n > 1")
    both = cold if full.where(F.col("n") > hot).isEmpty() else cold.unionByName(warm.join(counts, ["t", "key", "t2", "key2"]))
    rows = both.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("t", "key", "t2", "key2", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    units = rows.repartition(*UNIT).sortWithinPartitions(*UNIT, "fp")
    return units.mapInPandas(_bucket_edges(radius), "a long, b long").distinct()


def classes(prints: DataFrame, radius: int = 4) -> DataFrame:
    """prints (doc_id, fp), a written table -> (doc_id, fp, component_id): the least doc_id reachable over links."""
    firsts = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    with scratch() as keep:
        labels = keep(components(links(firsts.select("fp"), radius)))
    named = firsts.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    by_print = written(named.join(least, "label").select("fp", "component_id"))
    out = prints.join(by_print, "fp").select("doc_id", "fp", "component_id")
    discard(labels)
    discard(firsts)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    out = classes(written(fingerprinted(docs, doc_id, text, width)), radius)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies: the one with the least doc_id; rows without doc_id stay. Columns as in docs.

    A row is known by its doc_id and a hash of its text: of rows that share a doc_id but not their text each belongs to its own class,
    which keeps the one with the least hash if the id is its least. Rows with the same id and text are one document, of which the row with
    the least hash of all columns stays. The ids that go or repeat are a written table, so Catalyst knows its size: below the broadcast
    threshold no text is shuffled, above it texts are joined by id.
    """
    sign = fresh("_sign", docs)
    key = ["doc_id", sign]
    signed = docs.withColumn(sign, F.xxhash64("text"))
    known = signed.select(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.col(sign).alias("sign"))).alias("doc_id"), "text")
    rows = near_duplicates(known).where("doc_id is not null")
    own = rows.groupBy("doc_id.doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("names"))
    odd = written(own.where("n > 1 or not names").select("doc_id", F.expr("names and n > 1").alias("several")))
    single = docs.join(odd.select("doc_id"), "doc_id", "left_anti").select(every(docs))
    several = odd.where("several").select("doc_id")
    names = written(rows.where("doc_id = component_id").select("doc_id.*").join(several, "doc_id", "left_semi").distinct()).withColumnRenamed("sign", sign)
    again = signed.join(names, key, "left_semi").select(*key, F.struct(*every(docs)).alias("row"))
    repeated = again.groupBy(*key).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
    return single.union(repeated)
