"""Toxicity: a counterfactual-regularised classifier.

Features are the distinct words (runs of letters, lower case) of a text and the words' beginnings, as inflected and compound words share
them. Features that do not tell the labels apart in the sample (z below LEAST_Z, or fewer than LEAST_SEEN texts), and those beyond the
MAX_FEATURES strongest, are left out, so long clean texts gather no noise. Training copies each labelled text that names a group, with every
identity term swapped for another, and penalises the squared change of the score: a neutral mention of a group does not raise it.

Identity terms come from two places: the lists of IDENTITY, of which only those that occur in the sample have an effect, and the sample itself.
What a term must look like to mislead a classifier is known: it comes more often in toxic texts than chance has it, yet most texts that have it
are clean. Such words (`suspects`) are each swapped with an even-handed word of like frequency. Model.pairs says how many pairs were used.

Rows: a null text is empty; an empty text scores as the bias says. Without labelled rows every score is 0. Null labels are not
learned from; an id labelled twice counts with its greatest label. Repeated rows are scored each; extra columns are ignored; whole texts are read,
whatever their length. An empty table gives an empty result. A score of exactly `toxic_at` is toxic.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside_text, fold, sampled, small, table, texts
from .linear import Rows, fit, sigmoid

#: Terms that name groups of people, in sets whose members can stand for each other. A parameter.
IDENTITY = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("woman", "man", "girl", "boy", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "african", "european", "american", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("old", "young", "elderly", "disabled", "blind", "deaf"),
    ("immigrants", "refugees", "foreigners", "migrants"),
)
WORD = re.compile(r"[^\W\d_]+")
#: Letters of the beginnings.
BEGIN = (3, 4, 5, 6, 7)
#: Labelled rows that training reads at most; features that the model holds at most; words that a worker remembers.
MAX_TRAIN, MAX_FEATURES, WORDS_HELD = 4000, 20_000, 300_000
#: What a feature must have: texts of the sample, standard deviations from chance.
LEAST_SEEN, LEAST_Z = 4, 5.0
#: What a suspect must have: texts, standard deviations, and at most that share of toxic texts; its partner is within EVEN deviations of chance. Suspects at most.
TERM_SEEN, TERM_Z, TERM_TOXIC, EVEN, MAX_TERMS = 20, 2.0, 0.5, 1.0, 200
TOXIC_AT = 0.3


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(word: str) -> list[str]:
    """The word, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in BEGIN if n <= len(word))]


def swapped(own: set[str], groups: tuple[tuple[str, ...], ...] = IDENTITY) -> set[str] | None:
    """The words with each identity term replaced by the next of its set; None if there is none."""
    turn = {x: g[(i + 1) % len(g)] for g in groups for i, x in enumerate(g)}
    return {turn.get(x, x) for x in own} if any(x in turn for x in own) else None


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    pairs: int = 0
    terms: tuple[tuple[str, ...], ...] = ()

    def __post_init__(self):
        self.known: dict[str, tuple[str, ...]] = {}

    def score(self, text: str) -> float:
        if self.bias == float("-inf"):
            return 0.0
        own, known = words(text), self.known
        if len(known) > WORDS_HELD:
            known.clear()
        found: set[str] = set()
        for x in own:
            at = known.get(x)
            if at is None:
                at = known[x] = tuple(f for f in features(x) if f in self.weights)
            if at:
                found.update(at)
        return float(sigmoid(np.array([sum(self.weights[x] for x in sorted(found)) + self.bias]))[0])


def all_features(own: Iterable[str]) -> set[str]:
    return {f for x in own for f in features(x)}


def suspects(seen: dict[str, int], toxic: dict[str, int], share: float) -> list[tuple[str, str]]:
    """Words that come too often in toxic texts though most of their texts are clean, each with an even-handed word of like frequency."""
    def z(f: str) -> float:
        return (toxic.get(f, 0) - seen[f] * share) / np.sqrt(seen[f] * share * (1 - share))

    common = [f for f, n in seen.items() if n >= TERM_SEEN and not f.endswith("*")]
    found = sorted((f for f in common if z(f) >= TERM_Z and toxic.get(f, 0) <= TERM_TOXIC * seen[f]), key=lambda f: (-z(f), f))[:MAX_TERMS]
    even = sorted((seen[f], f) for f in common if abs(z(f)) < EVEN)
    out = []
    for f in found:
        if not even:
            break
        at = min(bisect_left(even, (seen[f], f)), len(even) - 1)
        out.append((f, even.pop(at)[1]))  # a partner of its own for each
    return out


def fitted(docs: Sequence[Iterable[str]], y: np.ndarray, groups: tuple[tuple[str, ...], ...] = IDENTITY, pull: float = 0.1) -> Model:
    """docs: the distinct words of each text. They are read twice; only counts of features stay in memory."""
    if not len(y):
        return Model({}, float("-inf"))
    share = min(max(float(y.mean()), 1 / len(y)), 1 - 1 / (len(y) + 1))
    seen: Counter = Counter()
    toxic: Counter = Counter()
    for own, label in zip(docs, y, strict=True):
        got = all_features(own)
        seen.update(got)
        if label:
            toxic.update(got)
    told = {f: abs(toxic[f] - n * share) / np.sqrt(n * share * (1 - share)) for f, n in seen.items() if n >= LEAST_SEEN}
    groups = (*groups, *suspects(seen, toxic, share))
    names = {x for g in groups for x in g}
    kept = sorted((f for f, z in told.items() if z >= LEAST_Z or f in names), key=lambda f: (-told[f], f))[:MAX_FEATURES]
    place = {f: i for i, f in enumerate(kept)}

    known: dict[str, tuple[int, ...]] = {}

    def at(own: Iterable[str]) -> np.ndarray:
        found: set[int] = set()
        for x in own:
            some = known.get(x)
            if some is None:
                some = known[x] = tuple(place[f] for f in features(x) if f in place)
            if some:
                found.update(some)
        return np.array(sorted(found), np.int64)

    def rows(some: list[np.ndarray]) -> Rows:
        return Rows(some, [np.ones(len(x)) for x in some], len(place))

    both = [(at(own), at(turned)) for own in docs if (turned := swapped(set(own), groups)) is not None]
    pairs = (rows([x for x, _ in both]), rows([x for _, x in both]))
    w, b = fit(rows([at(own) for own in docs]), y, l2=1e-4, steps=300, rate=0.2, pairs=pairs, pull=pull)
    return Model({f: float(w[i]) for f, i in place.items()}, b, len(both), groups)


class Lists(Sequence):
    """The rows of an Arrow list column, made when they are read."""

    def __init__(self, column: pa.ChunkedArray):
        self.column = column

    def __len__(self) -> int:
        return len(self.column)

    def __getitem__(self, i):
        return self.column[i].as_py()


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic). Held-out ids are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole):
                yield pa.record_batch([batch.column(2), pa.array([sorted(words(x)) for x in texts(batch.column(1))], pa.list_(pa.string()))], names=["label", "words"])

    known = labels.where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sampled(known, F.col("doc_id"), most)), "doc_id")  # `most` rows of two numbers
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of rows that share an id, one
    got = rows.select("doc_id", "text", "label").mapInArrow(run, "label int, words array<string>").toArrow()
    return fitted(Lists(got["words"]), np.asarray(got["label"], float))


def scored(docs: DataFrame, model: Model, toxic_at: float = TOXIC_AT) -> DataFrame:
    """docs (doc_id, text, ...) -> its columns but text, score and predicted, which replace columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_FEATURES strings at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole):
                score = np.array([shared.value.score(x) for x in texts(batch.column(batch.num_columns - 1))], float)
                yield pa.record_batch([*batch.columns[:-1], pa.array(score), pa.array((score >= toxic_at).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    return beside_text(docs, run, "score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "text")
    return scored(rows, train(docs, table(spark, sf_dir, "labels")))
