"""Token counts by a linear longest-match automaton.

Greedy word pieces: a word (a run without white space) begins with the longest matching piece that starts a word and goes on with the longest
pieces that continue one. Both tries are joined at a node from which continuations start. Each node has a failure link, the node that
matching goes on from after popping whole pieces, and the number of pieces popped on the way, so a word is counted in one pass
over its bytes and no piece is built. A word that the pieces can't cover counts as one token.

The vocabulary is a byte-level one whose word starts carry a leading space mark. A word that no longer piece starts begins with the mark
alone, the empty start, which is one token, and goes on with continuations; with all single bytes every word is covered. It is read from a tokenizer file (a parameter).
Rows: a null or empty text has 0 tokens. Repeated rows are counted each; extra columns are ignored; whole texts are read, whatever
their length. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import raw, small, table

WORDS_HELD = 500_000


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest in order from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in own}
    for i, b in enumerate(b for b in range(256) if b not in set(own)):
        out[chr(256 + i)] = b
    return out


def load(path: str) -> tuple[list[bytes], list[bytes]]:
    """(pieces that start a word, pieces that continue one) as bytes, of a byte-level BPE file."""
    turn = byte_of()
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    pieces = [bytes(turn[c] for c in x) for x in names if all(c in turn for c in x)]
    return [x[1:] for x in pieces if x[:1] == b" "], [x for x in pieces if x[:1] != b" "]


class Automaton:
    """step: (node << 8 | byte) -> node. A node spells bytes since the last popped piece. An empty start is the space mark alone."""

    def __init__(self, starts: Iterable[bytes], more: Iterable[bytes]):
        self.step: dict[int, int] = {}
        self.root, self.rest = 0, 1
        whole: list[bool] = [False, False]
        children: list[list[tuple[int, int]]] = [[], []]
        for top, pieces in ((self.root, starts), (self.rest, more)):
            for piece in pieces:
                node = top
                for b in piece:
                    to = self.step.get(node << 8 | b)
                    if to is None:
                        to = self.step[node << 8 | b] = len(whole)
                        whole.append(False)
                        children.append([])
                        children[node].append((b, to))
                    node = to
                whole[node] = True
        n = len(whole)
        self.fail, self.popped = [-1] * n, [0] * n  # -1: no way on
        if whole[self.root]:
            self.fail[self.root], self.popped[self.root] = self.rest, 1
        todo = deque([self.root, self.rest])
        while todo:
            node = todo.popleft()
            for b, to in children[node]:
                if whole[to]:
                    self.fail[to], self.popped[to] = self.rest, 1
                else:
                    at, count = self.fail[node], self.popped[node]
                    while at >= 0 and (at << 8 | b) not in self.step:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[to], self.popped[to] = self.step[at << 8 | b], count
                todo.append(to)

    def count(self, word: bytes) -> int:
        """Pieces of one word; 1 if it can't be covered."""
        node, out, step, fail, popped = self.root, 0, self.step, self.fail, self.popped
        for b in word:
            while (to := step.get(node << 8 | b)) is None:
                out += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node != self.rest:
            out += popped[node]
            node = fail[node]
            if node < 0:
                return 1 if word else 0
        return out if word else 0


def greedy(word: bytes, starts: set[bytes], more: set[bytes]) -> int:
    """The same by trying lengths from long to short: the test's measure."""
    at, out, pieces = 0, 0, starts
    while at < len(word):
        end = next((e for e in range(len(word), at - (pieces is starts), -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, out, pieces = end, out + 1, more
    return out


def counted(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(*load(path)))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, known = shared.value, {}
        for whole in batches:
            for batch in small(whole):
                words, tokens = [], []
                for text in raw(batch.column(1)):
                    own = text.split()
                    try:
                        n = sum([known[x] for x in own])
                    except KeyError:
                        if len(known) > WORDS_HELD:
                            known.clear()
                        for x in set(own):
                            if x not in known:
                                known[x] = auto.count(x)
                        n = sum([known[x] for x in own])
                    words.append(len(own))
                    tokens.append(n)
                yield pa.record_batch([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
