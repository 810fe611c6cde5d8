"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Distinct vectors are dealt to shards by hash. Shards grow with the table, to the power of two
thirds, so that their number, and with it the copies of a query, grows only by the third root;
the beam widens with the root of a shard's size, which holds the recall. In each shard a graph grows:
a greedy beam search proposes neighbours for a batch of vectors, relaxed distance pruning
keeps those that no kept neighbour is much closer to, and edges back are pruned the same way
where a vector gets too many. Queries walk every shard's graph with a beam; the best of all
shards are the answer. All work on a batch is done in numpy at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import stage

#: Distinct vectors of a shard, about: at least, and at most (what a task holds and builds in minutes).
SHARD, MOST = 2048, 1 << 16
DEGREE = 24
#: Beam of a build, and of queries to a shard of ``SHARD`` vectors.
BEAM = 64
BATCH = 256
#: Numbers in a block of query vectors, which travels as one row.
BLOCK = 1024
#: Beam entries opened in one step.
OPEN = 4
RELAX = (1.0, 1.2)


@dataclass
class Graph:
    points: np.ndarray  # float32, centred: for walking only
    edges: np.ndarray  # n x width, -1 where free
    start: int


def _far(points: np.ndarray, queries: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its row of points; infinite where ``at`` is negative."""
    gap = points[np.maximum(at, 0)] - queries[:, None, :]
    d = np.einsum("bcd,bcd->bc", gap, gap)
    d[at < 0] = np.inf
    return d


def search(graph: Graph, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and squared distances of the ``beam`` nearest points that a walk meets, nearest first."""
    b, n = len(queries), len(graph.points)
    ids = np.full((b, beam), -1)
    far = np.full((b, beam), np.inf)
    ids[:, 0] = graph.start
    far[:, 0] = _far(graph.points, queries, ids[:, :1])[:, 0]
    opened = np.zeros((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)  # the last column stands for free places
    seen[:, graph.start] = True
    seen[:, n] = True
    live = np.arange(b)
    while len(live):
        closed = opened[live] | (ids[live] < 0)
        pick = np.argsort(closed, axis=1, kind="stable")[:, :OPEN]
        rows = live[:, None]
        source = np.where(np.take_along_axis(closed, pick, 1), -1, ids[rows, pick])
        opened[rows, pick] = True
        new = np.where(source[:, :, None] < 0, -1, graph.edges[np.maximum(source, 0)]).reshape(len(live), -1)
        new = np.where(seen[rows, new], -1, new)
        # the same point may come from two sources: only its first place stays
        order = np.argsort(new, axis=1, kind="stable")
        ranked = np.take_along_axis(new, order, 1)
        again = np.zeros_like(ranked, bool)
        again[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
        ranked[again] = -1
        seen[rows, ranked] = True
        seen[:, n] = True
        width = int((ranked >= 0).sum(axis=1).max())
        if width:
            ranked = np.sort(ranked, axis=1)[:, ::-1][:, :width]
            d = _far(graph.points, queries[live], ranked)
            every = np.concatenate([far[live], d], axis=1)
            best = np.argsort(every, axis=1, kind="stable")[:, :beam]
            far[live] = np.take_along_axis(every, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], ranked], axis=1), best, 1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], np.zeros_like(ranked, bool)], axis=1), best, 1)
        live = live[(~opened[live] & (ids[live] >= 0)).any(axis=1)]
    return ids, far


def prune(points: np.ndarray, own: np.ndarray, proposed: np.ndarray, relax: float, degree: int) -> np.ndarray:
    """At most ``degree`` of the proposed neighbours (-1: none) of each own point, nearest first.

    A kept neighbour k rules out every c with relax * d(k, c) <= d(own, c).
    """
    order = np.argsort(proposed, axis=1, kind="stable")
    ranked = np.take_along_axis(proposed, order, 1)
    ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = -1
    ranked[ranked == own[:, None]] = -1
    d = _far(points, points[own], ranked)
    order = np.argsort(d, axis=1, kind="stable")
    c, d = np.take_along_axis(ranked, order, 1), np.take_along_axis(d, order, 1)
    width = max(1, int((c >= 0).sum(axis=1).max()))
    c, d = c[:, :width], d[:, :width]
    x = points[np.maximum(c, 0)]
    norm = np.einsum("bcd,bcd->bc", x, x)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    between *= relax * relax
    alive = c >= 0
    out = np.full((len(own), degree), -1)
    rows = np.arange(len(own))
    for i in range(degree):
        has = alive.any(axis=1)
        if not has.any():
            break
        pick = alive.argmax(axis=1)
        out[has, i] = c[rows, pick][has]
        alive &= between[rows, pick] > d
        alive[rows, pick] = False
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, seed: int = 7) -> Graph:
    """Graph over the rows of ``vectors``; the same rows in the same order give the same graph."""
    n, rng = len(vectors), np.random.default_rng(seed)
    points = (vectors - vectors.mean(axis=0)).astype(np.float32)
    width = degree + degree // 2
    edges = np.full((n, width), -1)
    start = int(np.einsum("nd,nd->n", points, points).argmin())
    graph = Graph(points, edges, start)
    if n > 1:
        edges[:, :degree] = (np.arange(n)[:, None] + rng.integers(1, n, (n, degree))) % n
    for relax in RELAX:
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            own = order[at : at + BATCH]
            near, _ = search(graph, points[own], beam)
            kept = prune(points, own, np.concatenate([near, edges[own]], axis=1), relax, degree)
            edges[own] = -1
            edges[own, :degree] = kept
            back, to = kept[kept >= 0], np.repeat(own, degree).reshape(-1, degree)[kept >= 0]
            known = (edges[back] == to[:, None]).any(axis=1)
            back, to = back[~known], to[~known]
            by = np.argsort(back, kind="stable")
            back, to = back[by], to[by]
            place = np.arange(len(back)) - np.searchsorted(back, back, side="left")
            free = (edges[back] >= 0).sum(axis=1) + place
            fits = free < width
            full = np.unique(back[~fits])
            small = fits & ~np.isin(back, full)
            # free places are kept at the end of a row
            edges[back[small], free[small]] = to[small]
            for j in range(0, len(full), BATCH):
                some = full[j : j + BATCH]
                mine = np.isin(back, some)
                more = np.full((len(some), int(place[mine].max()) + 1), -1)
                more[np.searchsorted(some, back[mine]), place[mine]] = to[mine]
                kept = prune(points, some, np.concatenate([edges[some], more], axis=1), relax, degree)
                edges[some] = -1
                edges[some, :degree] = kept
    return graph


def layout(n: int) -> tuple[int, int]:
    """(vectors of a shard, beam of a query) for ``n`` distinct vectors."""
    shard = min(MOST, max(SHARD, math.ceil(round(n ** (2 / 3), 6))))
    return shard, math.ceil(BEAM * math.sqrt(shard / SHARD))


def _blocks(asked: DataFrame) -> DataFrame:
    """(length, v, ids, keys): query vectors of one length behind each other, ``BLOCK`` numbers a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, column = batch.column(0), batch.column(1), batch.column(2)
            length = np.diff(column.offsets.to_numpy())
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                step = max(1, BLOCK // int(size))
                parts = [pa.array(at[i : i + step]) for i in range(0, len(at), step)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(size)] * len(parts), pa.int32()),
                        pa.array([column.take(p).flatten().to_numpy() for p in parts], pa.list_(pa.float64())),
                        *(pa.array([c.take(p).to_numpy() for p in parts], pa.list_(pa.int64())) for c in (ids, keys)),
                    ],
                    names=["length", "v", "ids", "keys"],
                )

    return asked.select("query_id", F.xxhash64("v"), "v").mapInArrow(run, "length int, v array<double>, ids array<long>, keys array<long>")


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", shard: int | None = None, beam: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` nearest rows of another id.

    Vectors that are null, zero or hold a null, NaN or infinity take no part, nor do rows without
    an id. Vectors of another length than the query's are no candidates. Repeated rows, of one id
    and vector, count once; an id with several vectors asks, and is found, with each. Equal vectors
    are one point of a graph, which carries its ``k + 1`` smallest ids; they are found by a window
    whose limit Spark applies before the shuffle, so any number of copies is harmless. ``score`` is
    the Euclidean distance of the original vectors in double precision; equal ones go by id.

    ``shard`` and ``beam`` follow ``layout`` unless given. Every query goes to every shard.
    """
    numbers = F.col(vector).cast("array<double>")

    def sound(df: DataFrame, name: str) -> DataFrame:
        df = df.select(F.col(id).cast("long").alias(name), F.transform(numbers, lambda x: x + F.lit(0.0)).alias("v"))
        bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.filter(F.col(name).isNotNull() & F.col("v").isNotNull()).filter(~bad).filter(F.exists("v", lambda x: x != 0)).distinct()

    by = Window.partitionBy("v").orderBy("vec_id")
    least = sound(rows, "vec_id").withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k + 1)
    points = stage(least.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    n = points.count()
    shard = shard or layout(n)[0]
    width = max(beam or math.ceil(BEAM * math.sqrt(max(1, shard / SHARD))), k + 1)
    shards = max(1, -(-n // shard))
    own = points.select(F.size("v").alias("length"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "v", "ids", F.array().cast("array<long>").alias("keys"))
    asked = _blocks(sound(queries, "query_id")).select("length", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "v", "ids", "keys")
    dealt = own.unionByName(asked).repartition(shards, "length", "shard").sortWithinPartitions("length", "shard", "asks", "v")

    def answer(graph: Graph, vectors: np.ndarray, ids: list[list[int]], asking: np.ndarray, keys: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        """The best ``k`` of this shard for each query."""
        found, _ = search(graph, (q - vectors.mean(axis=0)).astype(np.float32), width)
        out: list[tuple[int, int, int, float]] = []
        for one, key, at, x in zip(asking.tolist(), keys.tolist(), found, q):
            at = at[at >= 0]
            gap = vectors[at] - x
            exact = np.sqrt((gap * gap).sum(axis=1))
            best = sorted((d, i) for d, p in zip(exact.tolist(), at.tolist()) for i in ids[p] if i != one)[:k]
            out += [(one, key, i, d) for d, i in best]
        cols = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "key", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, vectors, graph = None, [], [], None, None
        for batch in batches:
            length, part = (batch.column(i).to_numpy() for i in (0, 1))
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(length) != 0) | (np.diff(part) != 0) | np.diff(asks)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                if lo == hi:
                    continue
                if (length[lo], part[lo]) != now:
                    now, held, ids, graph = (length[lo], part[lo]), [], [], None
                v = batch.column(3).slice(lo, hi - lo).flatten().to_numpy().reshape(-1, length[lo])
                if not asks[lo]:
                    held.append(v)
                    ids += batch.column(4).slice(lo, hi - lo).to_pylist()
                elif held:
                    if graph is None:
                        vectors = np.concatenate(held)
                        graph = build(vectors)
                    asking, keys = (batch.column(i).slice(lo, hi - lo).flatten().to_numpy() for i in (4, 5))
                    for at in range(0, len(v), BATCH):
                        some = slice(at, at + BATCH)
                        yield answer(graph, vectors, ids, asking[some], keys[some], v[some])

    near = dealt.mapInArrow(run, "query_id long, key long, vec_id long, score double")
    best = Window.partitionBy("query_id", "key").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every row whose id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(rows, rows.filter("vec_id % 100 = 0"))
