"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of labelled rows on the executors: of all that aren't held out for `accepted`, of a bounded sample for `op4_language_id`.
The driver gets one count per language and hash slot that occur, and broadcasts the matrix of log-probabilities, 2**bits rows by the number of languages. Scoring takes many texts at once: their n-grams
are a sparse matrix of texts by slots, whose product with that matrix is one gather and one segmented sum. The numbers are whole 2**-20ths, so
sums are exact and a score doesn't depend on what else is in a batch.

Rows: a null text or one without a letter is `und` with score 0, as is every row if there is nothing to learn from. Rows without lang are not
learned from but are scored. Repeated rows and extra columns do no harm; whole texts are read, whatever their length; ties go to
the first language by code point. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside_text, code_points, fold, mapped, ngram_slots, sampled, small, table, texts

BITS, ORDERS, UNKNOWN = 14, (1, 2, 3), "und"
#: Rows that training reads at most, where it is bounded; a hash of the id picks them.
MAX_TRAIN = 20_000
#: Languages whose slots a task counts before it passes them on.
HELD = 256
#: Code points that are scored at a time, over the languages; fractions of which sums are whole numbers.
STEP, FINE = 1 << 20, 1 << 20
LETTER = regex.compile(r"\p{L}")


def slots(text: str) -> np.ndarray:
    """Hash slots of all n-grams of the lower-cased text, in one array."""
    chars = code_points(text.lower())
    return np.concatenate([ngram_slots(chars, n, BITS) for n in ORDERS])


@dataclass
class Model:
    langs: list[str]
    log_probs: np.ndarray  # (2**BITS, langs), whole numbers of 1 / FINE
    prior: np.ndarray

    def sums(self, some: list[str]) -> np.ndarray:
        """Log-probabilities of texts by language, in 1 / FINE."""
        out = np.tile(self.prior, (len(some), 1))
        parts = [code_points(x.lower()) for x in some]
        sizes = np.array([len(x) for x in parts], np.int64)
        chars, doc = np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.repeat(np.arange(len(parts)), sizes)
        step = max(1, STEP // max(1, len(self.langs)))
        for at in range(0, len(chars), step):
            for n in ORDERS:
                found = ngram_slots(chars[at : at + step + n - 1], n, BITS)
                own = doc[at : at + len(found)]
                whole = own == doc[at + n - 1 : at + n - 1 + len(found)]  # no n-gram spans two texts
                found, own = found[whole], own[whole]
                if len(found):
                    first = np.flatnonzero(np.r_[True, np.diff(own) != 0])
                    out[own[first]] += np.add.reduceat(self.log_probs[found], first, axis=0)
        return out

    def predict_all(self, some: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(some)
        todo = [i for i, x in enumerate(some) if self.langs and LETTER.search(x)]
        while todo:
            own, size = [], 0
            while todo and size < STEP:
                own.append(todo.pop())
                size += len(some[own[-1]])
            said = self.sums([some[i] for i in own])
            odds = np.exp((said - said.max(axis=1, keepdims=True)) / FINE)
            best = said.argmax(axis=1)
            share = odds[np.arange(len(own)), best] / odds.sum(axis=1)
            for i, k, p in zip(own, best.tolist(), share.tolist(), strict=True):
                out[i] = self.langs[k], p
        return out

    def predict(self, text: str) -> tuple[str, float]:
        return self.predict_all([text])[0]


def train(rows: DataFrame, most: int | None = MAX_TRAIN, held: int = HELD) -> Model:
    """rows (doc_id, text, lang), about `most` of them at most; None: all."""

    def counted(seen: dict[str, np.ndarray], docs: dict[str, int]) -> Iterator[pa.RecordBatch]:
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(counts[at], docs[lang]))], names=["lang", "slot", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for whole in batches:
            for batch in small(whole):
                for text, lang in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                    if len(seen) >= held and lang not in seen:
                        yield from counted(seen, docs)
                        seen, docs = {}, {}
                    counts = seen.setdefault(lang, np.zeros(1 << BITS, np.int64))
                    docs[lang] = docs.get(lang, 0) + 1
                    counts += np.bincount(slots(text), minlength=1 << BITS)
        yield from counted(seen, docs)

    known = rows.where("lang is not null and text is not null")
    if most is not None:
        known = sampled(known, F.xxhash64("doc_id", "text"), most)
    counts = known.select("text", "lang").mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counts["lang"]))
    tally, prior = np.zeros((1 << BITS, len(langs))), np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        prior[k] = own.loc[own["slot"] < 0, "n"].sum()
        own = own[own["slot"] >= 0]
        tally[own["slot"].to_numpy(), k] = own["n"].to_numpy()
    tally += 0.5
    log_probs, share = np.log(tally / tally.sum(axis=0)), np.log(prior / max(prior.sum(), 1))
    return Model(langs, np.rint(log_probs * FINE).astype(np.int64), np.rint(share * FINE).astype(np.int64))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) -> its columns but text, lang_pred and score, which replace columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS x languages numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole):
                said = shared.value.predict_all(texts(batch.column(batch.num_columns - 1)))
                yield pa.record_batch([*batch.columns[:-1], pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return beside_text(docs, run, "lang_pred string, score double")


def learned(docs: DataFrame, most: int | None = MAX_TRAIN) -> Model:
    """From the rows that aren't held out, about `most` of them at most; None: all."""
    return train(docs.where(fold(F.col("doc_id")) != 2).select("doc_id", "text", "lang"), most)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "text")
    return identified(rows, learned(docs))


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose language is known with at least that probability, by a model of all labelled rows that aren't held out. Columns as in docs."""
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, None))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole):
                said = shared.value.predict_all(texts(batch.column(at)))
                yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in said], pa.bool_()))

    return mapped(docs, run)
