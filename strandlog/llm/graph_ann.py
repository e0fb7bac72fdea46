"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Equal vectors are one node that carries the least ids of its rows (one more than the neighbours asked for, which is all that a result
can need), so copies neither crowd a graph nor a task. Nodes go to shards by hash. In a shard, greedy searches from the most central node
propose neighbours; pruning keeps the nearest and drops what a kept neighbour is nearer to by the factor alpha; reverse edges are
added and pruned alike. Graphs are built and searched in double precision around the shard's median and in units of its median spread, so
neither a common offset nor a scale nor single far values hide what is near. Exact distances on the original vectors rank what was found.

Queries go in blocks to every shard. A unit of work is one graph and at most UNIT blocks: units are partitions of their own by dimension,
shard and salt, in which the graph comes first and the blocks stream past it, so no key holds more than that, whatever the table's size.
The number of units is rows of queries times shards: queries that are a fixed share of the rows make the work grow with their square.

Rows: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows without id; equal rows count once;
vectors meet those of their own dimension only. Fewer candidates than asked for give fewer rows; an empty table gives none. Extra columns are
ignored. Ties of distance go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

DEGREE, BEAM, ALPHA, SHARD, BLOCK = 28, 96, 1.2, 4000, 256
#: Queries in a row of a block; blocks that one task searches in one graph; partitions at most.
ASKED, UNIT, MOST_PARTS = 64, 64, 20_000
#: Dimensions whose numbers of shards are broadcast, two numbers each; beyond they are joined.
MOST_DIMS = 10_000
#: Components beyond that many median spreads count as so many in a search, not in distances that are given.
FAR = 1e60


def frame(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Middle and spread of a shard's vectors: medians, which single values don't move."""
    middle = np.median(x, axis=0)
    with np.errstate(over="ignore"):
        spread = np.abs(x - middle).max(axis=1)
    some = spread[(spread > 0) & np.isfinite(spread)]
    return middle, float(np.median(some)) if len(some) else 1.0


def framed(x: np.ndarray, middle: np.ndarray, unit: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip((x - middle) / unit, -FAR, FAR)


def beam_search(x: np.ndarray, norm: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the beam of each query, nearest first. graph: -1 where a node has no further edge."""
    n, m = len(x), len(q)
    qn = (q * q).sum(axis=1)
    ids = np.full((m, beam), -1, np.int32)
    far = np.full((m, beam), np.inf)
    ids[:, 0] = entry
    far[:, 0] = qn + norm[entry] - 2 * (q @ x[entry])
    done = np.zeros((m, beam), bool)
    seen = np.zeros((m, n + 1), bool)  # the last column stands for -1
    seen[:, [entry, n]] = True
    live = np.arange(m)
    while len(live):
        open_ = np.where(done[live] | (ids[live] < 0), np.inf, far[live])
        best = open_.argmin(axis=1)
        some = np.isfinite(open_[np.arange(len(live)), best])
        live, best = live[some], best[some]
        if not len(live):
            break
        done[live, best] = True
        near = graph[ids[live, best]]
        rows = live[:, None]
        fresh = ~seen[rows, near]
        seen[rows, near] = True
        seen[live, n] = True
        d = np.where(fresh, qn[live][:, None] + norm[near] - 2 * np.einsum("mrd,md->mr", x[near], q[live]), np.inf)
        every, gap = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1), np.concatenate([far[live], d], axis=1)
        flag = np.concatenate([done[live], np.zeros(d.shape, bool)], axis=1)
        order = np.argsort(gap, axis=1, kind="stable")[:, :beam]
        ids[live], far[live], done[live] = (np.take_along_axis(a, order, 1) for a in (every, gap, flag))
    return ids, far


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-edges of each point, from candidates (-1: none): nearest first, less those that a kept one covers."""
    norm = (x * x).sum(axis=1)
    out = np.full((len(points), degree), -1, np.int32)
    for a in range(0, len(points), 128):
        p, c = points[a : a + 128], cand[a : a + 128]
        c = np.where(c == p[:, None], -1, c)
        order = np.sort(c, axis=1)
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1  # each candidate once
        d = np.where(order < 0, np.inf, norm[p][:, None] + norm[order] - 2 * np.einsum("brd,bd->br", x[order], x[p]))
        rank = np.argsort(d, axis=1, kind="stable")
        c, d = np.take_along_axis(order, rank, 1), np.take_along_axis(d, rank, 1)
        v = x[c]
        between = norm[c][:, :, None] + norm[c][:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        live, rows = np.isfinite(d), np.arange(len(p))
        for k in range(degree):
            some = live.any(axis=1)
            if not some.any():
                break
            pick = live.argmax(axis=1)
            out[a : a + 128][some, k] = c[rows, pick][some]
            live &= alpha * alpha * between[rows, pick] > d
            live[rows, pick] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = 64, alpha: float = ALPHA, seed: int = 1) -> tuple[np.ndarray, int]:
    """(graph, entry) over the rows of x, in one pass: each point's edges are chosen once, with alpha, and reverse edges prune as they come."""
    n = len(x)
    norm = (x * x).sum(axis=1)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    draw = np.random.default_rng(seed)
    graph = np.full((n, degree), -1, np.int32)
    if n > 1:
        first = draw.integers(0, n - 1, (n, min(8, degree)))
        graph[:, : first.shape[1]] = first + (first >= np.arange(n)[:, None])
    order = draw.permutation(n)
    for a in range(0, n, BLOCK):
        p = order[a : a + BLOCK]
        found, _ = beam_search(x, norm, graph, entry, x[p], beam)
        graph[p] = robust_prune(x, p, np.concatenate([found, graph[p]], axis=1), degree, alpha)
        to, of = graph[p].ravel(), np.repeat(p, degree)
        of, to = of[to >= 0], to[to >= 0]
        rank = np.argsort(to, kind="stable")
        of, to = of[rank], to[rank]
        ends, first, count = np.unique(to, return_index=True, return_counts=True)
        wide = np.full((len(ends), int(count.max(initial=0))), -1, np.int32)
        wide[np.repeat(np.arange(len(ends)), count), np.arange(len(to)) - np.repeat(first, count)] = of
        room = (graph[ends] >= 0).sum(axis=1)
        roomy = room + count <= degree
        for j, r, own, k in zip(ends[roomy], room[roomy], wide[roomy], count[roomy], strict=True):
            new = own[:k][~np.isin(own[:k], graph[j])]
            graph[j, r : r + len(new)] = new
        if not roomy.all():
            tight = ends[~roomy]
            graph[tight] = robust_prune(x, tight, np.concatenate([graph[tight], wide[~roomy]], axis=1), degree, alpha)
    return graph, entry


def _index_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep", ignore_index=True)
    x = np.stack(pdf["embedding"].to_numpy()).astype(float)
    graph, entry = build(framed(x, *frame(x)))
    members = pdf["ids"].to_numpy()
    return pd.DataFrame({"dim": [x.shape[1]], "shard": [int(pdf["shard"].iloc[0])], "n": [len(x)], "entry": [entry], "vectors": [x.tobytes()], "graph": [graph.tobytes()], "members": [np.concatenate(members)], "held": [[len(m) for m in members]]})


INDEX = "dim int, shard int, n int, entry int, vectors binary, graph binary, members array<long>, held array<int>"


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>, dim) of the rows that take part, each once."""
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(fine).where(F.exists("embedding", lambda v: v != 0)).withColumn("dim", F.size("embedding")).distinct()


def index(rows: DataFrame, k: int = 10, shard: int = SHARD) -> DataFrame:
    """rows as of usable() -> a written table with one graph in each row."""
    by = Window.partitionBy("embedding").orderBy("vec_id")
    least = rows.withColumn("_at", F.row_number().over(by)).where(F.col("_at") <= k + 1)
    nodes = least.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.min("dim").alias("dim"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = written(nodes)
    sizes = written(nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards")))
    total = sizes.agg(F.sum("shards")).first()[0] or 0
    nodes = nodes.join(F.broadcast(sizes), "dim") if sizes.count() <= MOST_DIMS else nodes.join(sizes, "dim")
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("rep", F.lit(11)), F.col("shards")).cast("int"))
    nodes = nodes.repartition(min(max(1, 2 * total), MOST_PARTS), "dim", "shard")  # a number of its own: shards aren't merged into few tasks
    return written(nodes.groupBy("dim", "shard").applyInPandas(_index_rows, INDEX))


def _answers(g, blocks: list, k: int, beam: int) -> pd.DataFrame:
    """The k nearest of one graph for the queries of some blocks."""
    x = np.frombuffer(g.vectors, float).reshape(int(g.n), g.dim)
    graph = np.frombuffer(g.graph, np.int32).reshape(int(g.n), -1)
    members, held = np.asarray(g.members), np.asarray(g.held)
    ends = held.cumsum()
    own = frame(x)
    y = framed(x, *own)
    norm = (y * y).sum(axis=1)
    ids = np.concatenate([np.asarray(b.queries) for b in blocks])
    asked = np.concatenate([np.asarray(b.asked, float) for b in blocks]).reshape(-1, g.dim)
    rows = []
    for a in range(0, len(ids), BLOCK):
        q = asked[a : a + BLOCK]
        found, _ = beam_search(y, norm, graph, int(g.entry), framed(q, *own), max(beam, k + 1))
        with np.errstate(over="ignore"):
            exact = np.sqrt(((x[found] - q[:, None]) ** 2).sum(axis=2))
        for i, query in enumerate(ids[a : a + BLOCK]):
            near = [(exact[i, j], m) for j in np.argsort(exact[i], kind="stable") if found[i, j] >= 0 for m in members[ends[found[i, j]] - held[found[i, j]] : ends[found[i, j]]] if m != query]
            rows += [(query, m, s) for s, m in sorted(near)[:k]]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def _answer(k: int, beam: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by unit: its graph, then its blocks, a few of which are searched at once."""
        graph, held = None, []
        for pdf in batches:
            for r in pdf.itertuples():
                if r.graph is not None:
                    if held:
                        yield _answers(graph, held, k, beam)
                    graph, held = r, []
                elif graph is not None and (r.dim, r.shard, r.salt) == (graph.dim, graph.shard, graph.salt):  # else a shard without vectors
                    held.append(r)
                    if len(held) * ASKED >= BLOCK:
                        yield _answers(graph, held, k, beam)
                        held = []
        if held:
            yield _answers(graph, held, k, beam)

    return run


def nearest(graphs: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM) -> DataFrame:
    """graphs as of index(), queries as of usable() -> query_id, rank, vec_id, score."""
    blocks = max(1, -(-queries.count() // ASKED))
    salts = -(-blocks // UNIT)
    block = F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(blocks)).cast("int")
    asked = queries.groupBy("dim", block.alias("block")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("q"))
    asked = written(asked.select("dim", "block", F.col("q.vec_id").alias("queries"), F.flatten("q.embedding").alias("asked")))
    shards = written(graphs.groupBy("dim").agg((F.max("shard") + 1).alias("shards")))
    few = shards.count() <= MOST_DIMS
    rows = graphs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("block", F.lit(-1))
    more = asked.join(F.broadcast(shards) if few else shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    units = rows.unionByName(more.withColumn("salt", F.pmod("block", F.lit(salts))), allowMissingColumns=True)
    units = units.repartition(min(max(1, 2 * salts * graphs.count()), MOST_PARTS), "dim", "shard", "salt").sortWithinPartitions("dim", "shard", "salt", "block")
    found = units.mapInPandas(_answer(k, beam), "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return nearest(index(rows), rows.where(F.pmod(F.col("vec_id"), F.lit(100)) == 0))
