"""Quality rules: fixed word rules, and a calibrated logistic regression on hashed word and character n-grams.

The classifier is fitted on a bounded sample of labelled rows (label 1: good). A feature is the square root of an n-gram's share in its
family, so the length of a text does not matter. A quarter of the sample, by hash of the id, calibrates the probability. A
row is kept if no fixed rule fails and the probability of being good reaches `keep_at`.

Rows: a null text has no words and fails the rules, as does an empty one. Without labelled rows the classifier keeps all. Labels that are
null are not learned from; an id labelled twice counts with its least label. Repeated rows are scored each; extra columns are ignored; whole
texts are read, whatever their length. An empty table gives an empty result. A probability of exactly `keep_at` is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import code_points, ngram_slots, raw, sampled, small, table
from .linear import Rows, fit, platt, sigmoid

WORD_BITS, CHAR_BITS, CHAR_ORDERS = 14, 13, (2, 3)
#: Labelled rows that training reads at most.
MAX_TRAIN = 4000
KEEP_AT = 0.5
SYMBOLS = b"#*$%&|<>"
#: Rule limits: least words; most percent of words in repeated windows; words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words found twice or more, its first place included."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    number: dict = {}
    named = np.fromiter((number.setdefault(x, len(number)) for x in windows), np.int64, len(windows))
    again = np.flatnonzero(np.bincount(named)[named] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + width, -1)
    return int((cover.cumsum() > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    some = [x for x in lines if x.split()]
    return len(some) - len(set(some))


def counted(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(b"".join(words).decode("utf-8", "replace"))
    return len(words), chars, sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))), repeated_lines(text), repeated_words(words)


def slots(text: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of word slots and of character n-gram slots."""
    own = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & ((1 << WORD_BITS) - 1)
    chars, grams = code_points(text.decode("utf-8", "replace")), np.zeros(1 << CHAR_BITS, np.int64)
    for at in range(0, len(chars), 1 << 16):
        for n in CHAR_ORDERS:
            grams += np.bincount(ngram_slots(chars[at : at + (1 << 16) + n - 1], n, CHAR_BITS), minlength=1 << CHAR_BITS)
    return np.bincount(own, minlength=1 << WORD_BITS), grams


def shares(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / max(counts.sum(), 1))


@dataclass
class Model:
    words: np.ndarray
    grams: np.ndarray
    bias: float
    scale: tuple[float, float]

    def good(self, text: bytes, words: list[bytes]) -> float:
        """Calibrated probability of label 1."""
        own, grams = slots(text, words)
        said = shares(own) @ self.words + shares(grams) @ self.grams + self.bias
        return float(sigmoid(np.array([self.scale[0] * said + self.scale[1]]))[0])


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """docs (doc_id, text), labels (doc_id, quality)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole):
                at, value = [], []
                for text in raw(batch.column(1)):
                    both = [shares(x) for x in slots(text, text.split())]
                    x = np.concatenate(both)
                    at.append(np.flatnonzero(x).astype(np.int32))
                    value.append(x[at[-1]].astype(np.float32))
                yield pa.record_batch([batch.column(2), batch.column(3), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["label", "part", "slot", "value"])

    known = sampled(labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label")), F.col("doc_id"), most)
    known = known.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(4)).cast("int"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")  # `most` rows of three numbers
    rows = rows.groupBy("doc_id", "label", "part").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of rows that share an id, one
    got = rows.select("doc_id", "text", "label", "part").mapInArrow(run, "label int, part int, slot array<int>, value array<float>").toArrow()
    size = (1 << WORD_BITS) + (1 << CHAR_BITS)
    y, part = np.asarray(got["label"], float), np.asarray(got["part"])
    slot, value = ([np.asarray(x.values) for x in got[c]] for c in ("slot", "value"))

    def some(keep: np.ndarray) -> Rows:
        return Rows([slot[i] for i in keep], [value[i].astype(float) for i in keep], size)

    if not 0 < y.sum() < len(y):
        return Model(np.zeros(1 << WORD_BITS), np.zeros(1 << CHAR_BITS), 35.0 if not len(y) or y.all() else -35.0, (1.0, 0.0))
    fitted, tuned = np.flatnonzero(part > 0), np.flatnonzero(part == 0)
    w, b = fit(some(fitted), y[fitted], l2=1e-4, steps=150)
    scale = platt(some(tuned).dot(w) + b, y[tuned]) if len(tuned) else (1.0, 0.0)
    return Model(w[: 1 << WORD_BITS], w[1 << WORD_BITS :], b, scale)


def judged(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, the counts, base_failed, p_good, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**14 + 2**13 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole):
                counts, good = [], []
                for text in raw(batch.column(1)):
                    words = text.split()
                    counts.append(counted(text, words))
                    good.append(shared.value.good(text, words))
                n = np.array(counts, np.int64).reshape(-1, 5)
                failed = (n[:, 0] < LEAST_WORDS) | (100 * n[:, 4] > MOST_REPEATED * n[:, 0])
                p = np.array(good, float)
                yield pa.record_batch([batch.column(0), *(pa.array(n[:, k]) for k in range(5)), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_at))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_good", "kept"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_good double, kept boolean")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, train(docs, table(spark, sf_dir, "labels")))
