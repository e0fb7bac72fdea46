"""Vector best-fit packing of token sequences.

A document's ids are cut into pieces of at most `capacity` tokens, the first piece taking the remainder. Bins have three capacities:
tokens, pieces ("documents") and attention cost (sum of squared lengths). A piece's demand depends on its length only, so
pieces of one length are interchangeable: the driver packs the histogram of lengths (at most `capacity` counters, whatever the number of
documents) and gets patterns, each with a number of bins; pieces then find their slots by their rank among pieces of their length.
Lengths go from large to small; among the bin classes with room under every capacity the one with the best score is taken:
"dot" takes the bin whose residual is best aligned with the demand (greatest weighted dot product over the residual's norm), "norm" the
bin with the least weighted norm of the residual after placement.

Rows: a null text is empty and has the end id only, so every document has a piece. Repeated rows are packed each.
An empty table gives an empty result. Extra columns are ignored. Texts of any length are encoded whole. Pieces of one length are ranked by
doc_id, piece and then their further columns; rows equal in all of these can change places, which changes nothing.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, table, texts, written

CAPACITY, END_ID, MOST_PIECES = 2048, 0, 64
#: White space characters in a row from which on the library encodes a text, as the faster encoder's pattern may recurse too deep on them.
LONG_RUN = 50_000
_encoders: dict[str, Encoder] = {}


class Encoder:
    """ids of whole texts as little-endian 32-bit numbers, by a tokenizer file of the tokenizers library.

    If the file is a plain byte-level BPE whose ids stand in the order of its merges, tiktoken gives the same ids several times faster: the
    pair with the least merge is the pair whose union has the least id. The library itself encodes texts of any other file, texts that hold an
    added token, and texts with very long runs of white space.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.added = [x["content"] for x in said.get("added_tokens") or []]
        self.fast = _ranked(said, set(self.added))
        self.run = re.compile(rf"\s{{{LONG_RUN}}}")

    @cached_property
    def tokenizer(self):
        """The library's, which most workers never need."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def one(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(x in text for x in self.added) or len(text) >= LONG_RUN and self.run.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def ids(self, some: list[str]) -> list[bytes]:
        return [self.one(x) for x in some]


def _ranked(said: dict, added: set[str]):
    """The tokenizer file's model for tiktoken; None if it is no plain byte-level BPE in the order of its merges."""
    import public_tokenizers
    import tiktoken

    model, before = said["model"], said.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or said.get("normalizer") or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    vocab = model["vocab"]
    merged = [vocab.get("".join(x.split(" ") if isinstance(x, str) else x), -1) for x in model["merges"]]
    if len(merged) + 256 != len(set(vocab) - added) or min(merged, default=256) < 256 or any(x >= y for x, y in zip(merged, merged[1:], strict=False)):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others are numbered from 256 on
    of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(shown)))}
    ranks = {bytes(of[c] for c in x): i for x, i in vocab.items() if x not in added}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECE = "piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than capacity."""
    first = n % capacity or min(n, capacity)
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole):
                row, out = [], []
                for i, own in enumerate(encoder(path).ids(texts(batch.column(1)))):
                    ids = own + END_ID.to_bytes(4, "little")
                    for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                        row.append(i)
                        out.append((k, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)])))
                k, start, n, crc = (np.array([x[j] for x in out], np.int32 if j == 0 else np.int64) for j in range(4))
                yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), *map(pa.array, (k, start, n, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {PIECE}")


def patterns(counts: dict[int, int], capacity: int = CAPACITY, most_pieces: int | None = None, most_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.2), score: str = "norm") -> list[tuple[int, list[tuple[int, int]]]]:
    """counts (length -> pieces) -> [(bins, [(length, pieces in each bin), ...]), ...]; every piece has a place, no capacity is exceeded.

    most_pieces: by default MOST_PIECES, or twice what a sequence holds on average, if that is more, so that the limit holds tiny pieces apart
    but asks for no further bins. most_cost: by default what one piece of full length costs, the least that leaves room for it.

    Every step empties a length or a class of equal bins or opens new bins of one kind, so the list is as long as the number
    of lengths allows, not the number of pieces.
    """
    if most_pieces is None:
        full = -(-sum(k * n for k, n in counts.items()) // capacity)
        most_pieces = max(MOST_PIECES, 2 * -(-sum(counts.values()) // max(full, 1)))
    caps, w = np.array([capacity, most_pieces, float(capacity) ** 2 if most_cost is None else most_cost], float), np.array(weights)
    room = np.zeros((0, 3))
    number = np.zeros(0, np.int64)
    held: list[tuple[tuple[int, int], ...]] = []
    for length in sorted(counts, reverse=True):
        demand, left = np.array([length, 1, float(length) ** 2]), counts[length]
        if (demand > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        while left:
            fits = np.flatnonzero((number > 0) & (room >= demand).all(axis=1))
            if len(fits):
                free = (room[fits] - demand) / caps
                if score == "norm":
                    value = (w * free**2).sum(axis=1)
                else:
                    left_in = room[fits] / caps
                    value = -(w * left_in * (demand / caps)).sum(axis=1) / np.sqrt((w * left_in**2).sum(axis=1))
                best = int(fits[np.argmin(value)])
                base, bins, had = room[best], int(number[best]), held[best]
            else:
                best, base, bins, had = -1, caps, left, ()
            each = int(min(np.floor(base / demand).min(), left))
            used = min(bins, left // each)
            left -= used * each
            if best >= 0:
                number[best] -= used
            room = np.vstack([room, base - each * demand])
            number = np.append(number, used)
            held.append((*had, (length, each)))
        live = number > 0
        if live.sum() < 0.5 * len(live):  # forget emptied classes
            room, number, held = room[live], number[live], [h for h, x in zip(held, live, strict=True) if x]
    return [(int(n), list(h)) for n, h in zip(number, held, strict=True) if n]


def slots(found: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length: the ranks at which a pattern begins, its first bin, pieces a bin and offset of the first of them."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    bin_ = 0
    for bins, held in found:
        at = 0
        for length, each in held:
            out.setdefault(length, []).append((given.get(length, 0), bin_, each, at))
            given[length] = given.get(length, 0) + bins * each
            at += length * each
        bin_ += bins
    return {k: dict(zip(("rank", "bin", "each", "offset"), np.array(v, np.int64).T, strict=True)) for k, v in out.items()}


def packed(cuts: DataFrame, **limits) -> DataFrame:
    """cuts (doc_id, piece, length, ...), a written table -> its columns, sequence_id and offset.

    A piece's rank among those of its length: its place in one range partitioning by length, id and piece, less the length's first place
    in that partition, plus its rows in earlier partitions. So a common length is spread over tasks, and what is broadcast has one row for
    each partition and one more for each length.
    """
    spark = cuts.sparkSession
    key = [F.col("length"), F.col("doc_id"), F.col("piece"), *(F.col(c) for c in cuts.columns if c not in ("length", "doc_id", "piece"))]
    placed = cuts.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_place", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_place", 33)))
    runs = placed.groupBy("length", "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    runs = written(runs.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")))
    counts = {r["length"]: r["n"] for r in runs.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(slots(patterns(counts, **limits)))
    ranked = placed.join(F.broadcast(runs.drop("_n")), ["length", "_part"])
    ranked = ranked.select(*cuts.columns, (F.col("_place") - F.col("_first") + F.col("_before")).alias("_rank"))
    at = cuts.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0, True]) if len(order) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows_, own = order[a:b], plan.value[int(length[order[a]])]
                p = np.searchsorted(own["rank"], rank[rows_], "right") - 1
                n = rank[rows_] - own["rank"][p]
                sequence[rows_] = own["bin"][p] + n // own["each"][p]
                offset[rows_] = own["offset"][p] + n % own["each"][p] * length[rows_]
            yield pa.record_batch([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in cuts.dtypes)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def vocabulary() -> str:
    """The default tokenizer file of the installed package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, path: str | None = None, **limits) -> DataFrame:
    return packed(written(pieces(docs, path or vocabulary(), limits.get("capacity", CAPACITY))), **limits)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
