"""Secret scans: fixed patterns, and Markov models of random strings and ordinary identifiers compared by log-likelihood ratio.

Both models are character chains of second order, trained from labelled samples (string, 1 if random). Ordinary samples are joined words of
program texts and of the corpus itself, as identifiers, paths, slugs and compounds, with numbers and dates. The corpus's words are counted over
all its documents; every word of LEAST_DOCS or more begins strings of its own, which are made, counted and scored on the executors, however many
words there are, and together weigh as much as CORPUS samples. The driver gets one count per triple of characters and per thousandth of a score.
A quarter of the samples is held out; on it the bound is chosen, and recall and precision are measured. A candidate
is what the patterns' spans leave of a run of [A-Za-z0-9+/_=-], if LEAST_RUN or more characters, a letter and VARIED different letters and
digits are left. It is a secret of kind `random` if the ratio per character reaches the bound; else each part of it is one around whose best
LEAST_RUN characters that holds, so that words joined to a secret by / = - _ don't hide it. Such a part reaches as far as the ratio's sum
grows, and on to the next of / = - _ +.

Rows: a null text is empty. An empty text has no spans and the digest of the empty string. Repeated rows are scanned each; extra
columns are ignored; texts of any length are scanned whole. An empty table gives an empty result (and trains on program texts only).
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, scratch, small, table, texts, written
from .words import WORDS

#: Kind, pattern, group that has a least length, that length. In the order that ties of start follow.
KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: Finds the same spans as the third pattern with its length, in one pass.
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_HINT = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_RUN, LEAST_PART, VARIED = 20, 16, 8
#: A part ends where the ratio's sum has fallen by so much.
FALL = 6.0
JOINTS = "+/_=-"
#: The bound is never below.
LEAST_BOUND = 0.3
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: Parts of ordinary identifiers, for the default samples. Any labelled samples can take their place.
PARTS = "user name value index count total file path line list item node data table column row key time date start end first last next size length buffer input output parse read write open close get set add remove update delete create build load save send receive request response server client config option default result error message handler test case number string text http version code type class object field group order account page view model state event source target".split()


#: Alphabets of random strings.
ALPHABETS = (string.ascii_letters + string.digits, string.digits + "abcdef", string.ascii_uppercase + string.digits, string.ascii_letters, ALPHABET)
#: Documents that a word must be in; the samples that the strings of all such words weigh as much as; words on average that are joined with each other.
LEAST_DOCS, CORPUS, GROUP = 3, 16_000, 64
#: Different words that a task counts before it passes them on.
HELD = 200_000
#: Scores of the corpus's strings are counted by steps of one part in so many.
STEPS = 1000
PIECE = re.compile(r"[A-Za-z]{2,40}")


def _ordinary(draw: random.Random, words: list[str], first: str | None = None) -> str:
    """Some words (`first` before others, if given) joined as identifiers, paths, slugs or compounds, some with a number or a date at an end."""
    some, style = draw.choices(words, k=draw.randint(1, 6)), draw.randrange(9)
    some[0] = first or some[0]
    text = ("", "_", "-", "/", "=")[style].join(some) if style < 5 else "_".join(some).upper() if style == 5 else "".join(w.title() for w in some) if style == 6 else some[0] + "".join(w.title() for w in some[1:]) if style == 7 else "-".join(some).title()
    kind = draw.random()
    if kind < 0.25:
        text += str(draw.choice((1, 2, 3, 7, 10, 16, 64, 100, draw.randint(0, 9999), draw.randint(1990, 2035))))
    elif kind < 0.35:
        date = f"{draw.randint(1990, 2035)}-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}"
        text = draw.choice((f"{date}-{text}", f"{text}_{date}", f"{text}-{date.replace('-', '')}", f"{date.replace('-', '/')}/{text}"))
    elif kind < 0.4:
        text += f"-{draw.randint(1, 30)}-{draw.choice(words)}"
    return text


def samples(words: list[str] | None = None, n: int = 4000, seed: int = 5) -> list[tuple[str, int]]:
    """Labelled samples: random strings of usual alphabets, joined words of program texts, and joined words of the corpus, where given."""
    draw = random.Random(seed)
    out = [("".join(draw.choices(draw.choice(ALPHABETS), k=draw.randint(20, 48))), 1) for _ in range(n)]
    for own, times in ((PARTS, 1), (WORDS, 3), (words, 4)):
        out += [(_ordinary(draw, own), 0) for _ in range(times * n if own else 0)]
    return out


def vocabulary(docs: DataFrame, most: int = HELD) -> DataFrame:
    """word, n: every word of all documents that LEAST_DOCS or more of them hold, and how many do. A word of few documents may be a secret itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        counted = lambda: pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for whole in batches:
            for batch in small(whole):
                for x in texts(batch.column(0)):
                    held.update(set(PIECE.findall(x)))
                    if len(held) >= most:
                        yield counted()
                        held.clear()
        yield counted()

    rows = docs.where("text is not null").select(F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)


def corpus_words(docs: DataFrame) -> list[str]:
    """The whole vocabulary, the words of most documents first, then by letters: for `samples`, where the driver can hold it. `learned` does without."""
    return [r.word for r in vocabulary(docs).orderBy(F.desc("n"), "word").collect()]


def corpus_strings(group: int, words: list[str], times: int, seed: int = 5) -> Iterator[tuple[str, bool]]:
    """`times` ordinary strings for each word of a group, which it begins and others of the group follow, and whether the string is held out."""
    draw = random.Random(f"{seed}:{group}")
    for _ in range(times):
        for first in words:
            yield _ordinary(draw, words, first), draw.random() < 0.25


class Ratio:
    """log P(text | random) - log P(text | ordinary), each by a second-order chain with smoothing. `more` has further counts of the ordinary one's triples."""

    place = np.zeros(128, np.int64)
    place[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET)) + 1

    def __init__(self, labelled: list[tuple[str, int]], smooth: float = 0.1, more: np.ndarray | None = None):
        size = len(ALPHABET) + 1
        tables = []
        for label in (1, 0):
            two, one = np.zeros((size, size, size)), np.zeros((size, size))
            for text, own in labelled:
                if own == label:
                    codes = self.codes(text)
                    np.add.at(two, (codes[:-2], codes[1:-1], codes[2:]), 1)
                    np.add.at(one, (codes[1:-1], codes[2:]), 1)
            if more is not None and label == 0:
                two, one = two + more, one + more.sum(axis=0)
            back = (one + smooth) / (one + smooth).sum(axis=1, keepdims=True)
            tables.append(np.log((two + 5 * back[None]) / (two.sum(axis=2, keepdims=True) + 5)))
        self.table = (tables[0] - tables[1]).astype(np.float64)

    @classmethod
    def codes(cls, text: str) -> np.ndarray:
        own = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
        return np.concatenate([[0, 0], cls.place[np.minimum(own, 127)]])

    def each(self, text: str) -> np.ndarray:
        codes = self.codes(text)
        return self.table[codes[:-2], codes[1:-1], codes[2:]]

    def score(self, text: str) -> float:
        """Per character."""
        return float(self.each(text).mean()) if text else 0.0

    def best(self, text: str) -> float:
        """Per character of the best LEAST_RUN characters."""
        each = self.each(text)
        if len(each) < LEAST_RUN:
            return float("-inf")
        sums = np.concatenate([[0.0], np.cumsum(each)])
        return max(float(each.mean()), float((sums[LEAST_RUN:] - sums[:-LEAST_RUN]).max()) / LEAST_RUN)


@dataclass
class Detector:
    """A ratio, the bound from which on a string counts as random, and what both did on samples that they were not trained on."""

    ratio: Ratio
    least: float
    recall: float
    precision: float


def bound(scores: np.ndarray, weights: np.ndarray, wrong: float) -> float:
    """The least that no more than a share `wrong` of the weight reaches."""
    order = np.argsort(scores, kind="stable")
    beyond = np.append(np.cumsum(weights[order][::-1])[::-1][1:], 0.0)
    return float(scores[order][np.argmax(beyond <= wrong * weights.sum())]) + 1e-9


def fitted(labelled: list[tuple[str, int]], wrong: float = 0.002, more: np.ndarray | None = None, scored: Callable[[Ratio], tuple[np.ndarray, np.ndarray]] | None = None) -> Detector:
    """Trained on three of four samples; the bound is the least (LEAST_BOUND at least) that no more than a share `wrong` of the other ordinary samples reach anywhere.

    `more` has counts of triples in further ordinary strings; `scored` gives the scores that others have by a ratio, and their weights.
    """
    ratio = Ratio([x for i, x in enumerate(labelled) if i % 4], more=more)
    score = {label: np.array([ratio.best(t) for i, (t, own) in enumerate(labelled) if i % 4 == 0 and own == label and len(t) >= LEAST_RUN]) for label in (0, 1)}
    weight = np.ones(len(score[0]))
    if scored is not None:
        score[0], weight = (np.concatenate(x) for x in zip((score[0], weight), scored(ratio), strict=True))
    least = max(LEAST_BOUND, bound(score[0], weight, wrong) if len(weight) else LEAST_BOUND)
    hit, false = int((score[1] >= least).sum()), float(weight[score[0] >= least].sum())
    return Detector(ratio, least, hit / max(len(score[1]), 1), hit / max(hit + false, 1))


def learned(docs: DataFrame) -> Detector:
    """Trained on `samples` and on strings of every word of the vocabulary."""
    size = len(ALPHABET) + 1
    with scratch():
        words = written(vocabulary(docs))
        n = words.count()
        if not n:
            return fitted(samples())
        times = -(-CORPUS // n)
        weight = CORPUS / (times * n)
        groups = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(max(1, n // GROUP))).alias("k")).agg(F.sort_array(F.collect_list("word")).alias("words"))

        def strings(batch: pa.RecordBatch, held: bool) -> Iterator[str]:
            for k, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from (t for t, out in corpus_strings(k, own, times) if out == held)

        def summed(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["key", "n"])

        def totals(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> tuple[np.ndarray, np.ndarray]:
            got = groups.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
            return got.column(0).to_numpy(), got.column(1).to_numpy()

        def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(size**3, np.int64)
            for whole in batches:
                for batch in small(whole, 64):
                    codes = [Ratio.codes(t) for t in strings(batch, False)]
                    keys = [(c[:-2] * size + c[1:-1]) * size + c[2:] for c in codes]
                    counts += np.bincount(np.concatenate([*keys, np.zeros(0, np.int64)]), minlength=size**3)
            yield summed(np.flatnonzero(counts), counts[counts > 0])

        def scored(ratio: Ratio) -> tuple[np.ndarray, np.ndarray]:
            shared = docs.sparkSession.sparkContext.broadcast(ratio)

            def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                counts: Counter[int] = Counter()
                for whole in batches:
                    for batch in small(whole, 64):
                        counts.update(int(np.floor(shared.value.best(t) * STEPS)) for t in strings(batch, True) if len(t) >= LEAST_RUN)
                yield summed(np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64))

            keys, counts = totals(steps)
            return (keys + 1) / STEPS, counts * weight

        keys, counts = totals(triples)
        more = np.bincount(keys, counts * weight, size**3).reshape(size, size, size)
        return fitted(samples(), more=more, scored=scored)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of kind, end) of the fixed patterns, by start, then kind."""
    out = []
    if ASSIGN_HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in KINDS[0][1].finditer(text) if m.end(2) - m.start(2) >= KINDS[0][3]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in KINDS[1][1].finditer(text) if m.end() - m.start() >= KINDS[1][3]]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def reach(gain: np.ndarray) -> int:
    """How many numbers to take, from the first on, for the largest sum before one that is less by FALL."""
    sums = np.concatenate([[0.0], np.cumsum(gain)])
    low = np.flatnonzero(sums < np.maximum.accumulate(sums) - FALL)
    return int(sums[: low[0] if len(low) else None].argmax())


def varied(text: str) -> bool:
    return len({c for c in text if c.isalnum()}) >= VARIED and not text.isdigit()


def random_parts(text: str, ratio: Ratio, least: float) -> Iterator[tuple[int, int]]:
    """(start, end) of what is random in a candidate."""
    if len(text) < LEAST_RUN or not any(c.isalpha() for c in text):
        return
    each = ratio.each(text)
    if each.mean() >= least and varied(text):
        yield 0, len(text)
        return
    sums = np.concatenate([[0.0], np.cumsum(each)])
    mean = (sums[LEAST_RUN:] - sums[:-LEAST_RUN]) / LEAST_RUN
    while (mean >= least).any():
        k = int(mean.argmax())
        a, b = k - reach(each[:k][::-1]), k + LEAST_RUN + reach(each[k + LEAST_RUN :])
        while a > 0 and text[a - 1] not in JOINTS:
            a -= 1
        while b < len(text) and text[b] not in JOINTS:
            b += 1
        while a < b and text[a] in JOINTS:
            a += 1
        own = text[a:b]
        if len(own) >= LEAST_PART and any(c.isalpha() for c in own) and varied(own):
            yield a, b
        each[min(a, k) : max(b, k + 1)] = -np.inf  # no part goes into another
        mean[max(0, min(a, k) - LEAST_RUN + 1) : max(b, k + 1)] = -np.inf


def scan(text: str, ratio: Ratio, least: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The fixed patterns' spans, and all spans; the method's have kind 3."""
    base = base_spans(text)
    more = []
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for a, _, b in [*base, (m.end(), 0, m.end())]:
            if b > at and a <= m.end():
                more += [(at + x, 3, at + y) for x, y in random_parts(text[at:a], ratio, least)]
                at = max(at, b)
    return base, sorted(base + more)


NAMES = ("assign", "access", "hex", "random")


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in spans)


def found(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(detector or learned(docs))  # 67 cubed numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole):
                out = [scan(x, shared.value.ratio, shared.value.least) for x in texts(batch.column(1))]
                number = [pa.array([sum(k == own for _, k, _ in every) for _, every in out], pa.int64()) for own in range(4)]
                digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in out], pa.string())
                yield pa.record_batch([batch.column(0), *number, digest, pa.array([joined(x[1]) for x in out], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"))


def covered(text: str, spans: list[tuple[int, int, int]], mask: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """docs with every secret masked and n_chars, where it is a column, counted anew. All rows stay; columns as in docs."""
    shared = docs.sparkSession.sparkContext.broadcast(detector or learned(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole):
                out = [None if x is None else covered(x, scan(x, shared.value.ratio, shared.value.least)[1]) for x in batch.column(at).to_pylist()]
                yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    out = mapped(docs, run)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
