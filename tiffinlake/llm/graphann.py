"""Approximate nearest neighbours by inner product: robust-pruned directed graphs, one for each shard.

Equal vectors are one point. Points are dealt to shards by the octave of their
length and then by hash, so that no vector of a shard is more than twice as
long as another. The graph of a shard is built by insertion: a greedy search over the graph so far
proposes neighbours, and pruning keeps those that no kept one is nearer to by
the factor ALPHA, so that edges point in diverse directions. A query walks the
graph of each shard with a beam and scores what it meets exactly; the best of
all shards are its neighbours. Shards have a bounded size and queries come in
bounded blocks: a task holds one graph, and the blocks stream past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiffinlake.llm.common import written

NEAREST = 20
#: Points of a shard, and queries of a block, some.
SHARD_POINTS, BLOCK_QUERIES = 8_192, 4_096
DEGREE, ALPHA = 32, 1.15
#: Points that a search keeps while building and while querying.
BUILD_BEAM, BEAM = 64, 256
#: Points inserted together, and expanded together.
INSERTED, EXPANDED = 256, 4

_INDEX = "shard int, ids binary, vectors binary, neighbours binary, starts binary"
_HITS = "query long, point long, score double"


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part: an id, and as many finite components as most vectors, not all zero."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector")).where("vec_id IS NOT NULL")
    sound = named.where(finite & F.exists("vector", lambda x: x != 0))
    sizes = sound.groupBy(F.size("vector").alias("size")).count().orderBy(F.col("count").desc(), F.col("size").desc())
    size = sizes.first()
    return sound.where(F.size("vector") == (size["size"] if size else 0))


def points_of(sound: DataFrame, most: int) -> DataFrame:
    """(point, vector, members): equal vectors once, with the `most` smallest ids; a point goes by the smallest.

    The window keeps the smallest ids of each task before it shuffles.
    """
    nth = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    ids = sound.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("members"))
    return ids.select(F.col("members")[0].alias("point"), "vector", "members")


def _raised(x: np.ndarray) -> np.ndarray:
    """One more component each, so that all have one length: nearest is then largest inner product with a query that has 0 there.

    All are divided by the largest component before anything is squared.
    """
    x = x / np.abs(x).max()
    square = np.einsum("nd,nd->n", x, x)
    return np.concatenate([x, np.sqrt(np.maximum(0.0, square.max() - square))[:, None]], axis=1)


def _far(x: np.ndarray, of: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distance of rows of x, `to` (rows, some), to rows `of`. By differences: near copies are told apart."""
    apart = x[to]
    apart -= of[:, None, :]
    return np.einsum("rsd,rsd->rs", apart, apart)


class Graph:
    """Points of one shard with their edges."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM):
        self.x = _raised(vectors.astype(np.float64)).astype(np.float32)
        self.degree, self.alpha = degree, alpha
        count = len(self.x)
        self.edges = np.full((count, degree), -1, np.int32)
        self.starts = self._spread(min(count, 24))
        order = np.random.default_rng(1).permutation(count)
        done = min(count, 2 * INSERTED)
        first = order[:done]
        # The first ones know each other; the others are found by walking.
        near = np.argsort(((self.x[first][:, None, :] - self.x[first][None, :, :]) ** 2).sum(axis=2), axis=1)[:, 1 : beam + 1]
        if done > 1:
            self._connect(first, first[near])
        self.starts = np.unique(np.concatenate((self.starts[np.isin(self.starts, first)], first[:8])))
        while done < count:
            new = order[done : done + INSERTED]
            self._connect(new, self.walk(self.x[new], beam))
            done += len(new)
        self.starts = np.unique(np.concatenate((self.starts, self._spread(min(count, 24)))))

    def _spread(self, many: int) -> np.ndarray:
        """Points far from each other, each the farthest from those before it."""
        chosen = [int(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1).argmin())]
        far = ((self.x - self.x[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < many:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((self.x - self.x[chosen[-1]]) ** 2).sum(axis=1))
        return np.unique(chosen)

    def prune(self, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Edges for each point out of its candidates (-1 for none): the nearest, then the nearest that it does not cover, and so on.

        Whatever room is left goes to the nearest that were covered.
        """
        out = np.full((len(points), self.degree), -1, np.int32)
        for at in range(0, len(points), 512):
            kept = self._prune(points[at : at + 512], candidates[at : at + 512])
            out[at : at + 512, : kept.shape[1]] = kept
        return out

    def _prune(self, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        candidates = np.sort(candidates, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        candidates[candidates == points[:, None]] = -1
        # Seen from the point: what is near to it keeps its digits.
        local = self.x[np.maximum(candidates, 0)] - self.x[points][:, None, :]
        far = np.einsum("rsd,rsd->rs", local, local)
        apart = self.alpha * self.alpha * (far[:, :, None] + far[:, None, :] - 2 * (local @ local.transpose(0, 2, 1)))
        far = np.where(candidates >= 0, far, np.inf)
        alive, picked = np.isfinite(far), np.zeros(far.shape, bool)
        for _ in range(self.degree):
            left = np.where(alive, far, np.inf)
            next_ = left.argmin(axis=1)
            some = np.flatnonzero(np.isfinite(left.min(axis=1)))
            if not len(some):
                break
            picked[some, next_[some]] = True
            alive[some] &= apart[some, next_[some]] > far[some]
            alive[some, next_[some]] = False
        # Picked ones first, then the others, both by distance.
        order = np.lexsort((far, np.where(np.isfinite(far), ~picked, 2)))[:, : self.degree]
        return np.where(np.isfinite(np.take_along_axis(far, order, 1)), np.take_along_axis(candidates, order, 1), -1)

    def _connect(self, points: np.ndarray, candidates: np.ndarray) -> None:
        """Edges of new points, and back to them from each end; an end with too many is pruned."""
        self.edges[points] = self.prune(points, candidates)
        source = np.repeat(points, self.degree)
        target = self.edges[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        far = ((self.x[source] - self.x[target]) ** 2).sum(axis=1)
        order = np.lexsort((far, target))
        source, target = source[order], target[order]
        ends, begins = np.unique(target, return_index=True)
        place = np.arange(len(target)) - np.repeat(begins, np.diff(np.append(begins, len(target))))
        few = place < self.degree
        back = np.full((len(ends), 2 * self.degree), -1, np.int64)
        back[:, : self.degree] = self.edges[ends]
        back[np.searchsorted(ends, target[few]), self.degree + place[few]] = source[few]
        self.edges[ends] = self.prune(ends, back)

    def walk(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """For each query (raised, 0 last) the points of the beam at the end, nearest first; -1 where there are fewer."""
        out = [self._walk(queries[at : at + 512], beam) for at in range(0, len(queries), 512)]
        return np.concatenate(out) if out else np.empty((0, beam), np.int64)

    def _walk(self, queries: np.ndarray, beam: int) -> np.ndarray:
        rows, count = np.arange(len(queries))[:, None], len(self.x)
        start = np.arange(count) if count <= beam else self.starts
        size = max(beam, len(start))
        ids = np.full((len(queries), size), -1, np.int64)
        far = np.full((len(queries), size), np.inf, np.float32)
        ids[:, : len(start)] = start
        far[:, : len(start)] = _far(self.x, queries, np.broadcast_to(start, (len(queries), len(start))))
        seen = np.zeros((len(queries), count + 1), bool)
        seen[:, start] = True
        open_ = np.isfinite(far)
        active = np.arange(len(queries))
        while len(active):
            # The nearest open ones of each walk that goes on.
            waiting = np.where(open_[active], far[active], np.inf)
            next_ = np.argpartition(waiting, min(EXPANDED, size) - 1, axis=1)[:, :EXPANDED]
            going = np.isfinite(np.take_along_axis(waiting, next_, 1))
            some = going.any(axis=1)
            active, next_, going = active[some], next_[some], going[some]
            if not len(active):
                break
            line = active[:, None]
            open_[line, next_] &= ~going
            around = self.edges[ids[line, next_]].astype(np.int64)
            around[~going] = -1
            around = np.sort(around.reshape(len(active), -1), axis=1)
            around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
            around[seen[line, around]] = -1
            seen[line, around] = True
            seen[:, -1] = False
            # To the left what is new; most lines have few.
            around = -np.sort(-around, axis=1)[:, : max(1, int((around >= 0).sum(axis=1).max()))]
            fresh = np.where(around >= 0, _far(self.x, queries[active], np.maximum(around, 0)), np.inf)
            all_ids = np.concatenate([ids[active], around], axis=1)
            all_far = np.concatenate([far[active], fresh], axis=1)
            all_open = np.concatenate([open_[active], np.isfinite(fresh)], axis=1)
            kept = np.argpartition(all_far, size - 1, axis=1)[:, :size]
            ids[active] = np.take_along_axis(all_ids, kept, 1)
            far[active] = np.take_along_axis(all_far, kept, 1)
            open_[active] = np.take_along_axis(all_open, kept, 1)
        order = np.argsort(far, axis=1, kind="stable")
        ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
        return np.where(np.isfinite(far), ids, -1)[:, :beam]


def _array(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(column[0].as_py(), kind)


def octave(vector: Column) -> Column:
    """The power of two below the length of a vector that is not zero; no square overflows or vanishes."""
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))

    def scaled(power: int) -> Column:
        unit = F.lit(2.0**-power)
        squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + (x.cast("double") * unit) * (x.cast("double") * unit))
        return F.floor(F.log2(squares) / 2) + power

    return F.when(largest > 2.0**400, scaled(600)).when(largest < 2.0**-400, scaled(-600)).otherwise(scaled(0)).cast("int")


def dealt(points: DataFrame, shard_points: int) -> tuple[DataFrame, int]:
    """Points with their `shard`, and how many shards there are. Octaves are at most some 2,100."""
    leveled = points.select(octave(F.col("vector")).alias("octave"), "point", "vector")
    first, rows = 0, []
    for level, count in sorted(leveled.groupBy("octave").count().collect()):
        shards = -(-count // shard_points)
        rows.append((level, first, shards))
        first += shards
    levels = points.sparkSession.createDataFrame(rows, "octave int, first int, shards int")
    shard = (F.col("first") + F.pmod(F.xxhash64("point"), F.col("shards"))).cast("int").alias("shard")
    return leveled.join(F.broadcast(levels), "octave").select(shard, "point", "vector"), first


def build(points: DataFrame, shard_points: int = SHARD_POINTS) -> DataFrame:
    """The index: for each shard one row of arrays, its ids, vectors, edges and starts."""

    def step(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("point")
        vectors = group.column("vector").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        graph = Graph(vectors)
        parts = [group.column("point").to_numpy(), vectors.astype(np.float64), graph.edges, graph.starts.astype(np.int64)]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names)

    names = [f.split()[0] for f in _INDEX.split(", ")]
    placed, shards = dealt(points, shard_points)
    # A shard takes long and is small: each has a task of its own.
    return placed.repartitionByRange(max(1, shards), "shard").groupBy("shard").applyInArrow(step, _INDEX)


def search(index: DataFrame, queries: DataFrame, most: int, beam: int = BEAM, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query, point, score): the `most` best points found for each of (query, vector). Ties go to smaller points.

    A graph travels once; each block of queries goes to every shard.
    """
    shards, blocks = index.count(), max(1, -(-queries.count() // block_queries))

    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        vectors = group.column("vector").combine_chunks().flatten().to_numpy().astype(np.float64)
        parts = [group.column("query").to_numpy(), vectors]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["block", "ids", "vectors"])

    def graph_of(row: pa.RecordBatch) -> tuple[Graph, np.ndarray, np.ndarray]:
        ids = _array(row.column("ids"), np.int64)
        vectors = _array(row.column("vectors"), np.float64).reshape(len(ids), -1)
        graph = Graph.__new__(Graph)
        graph.x, graph.starts = _raised(vectors).astype(np.float32), _array(row.column("starts"), np.int64)
        graph.edges = _array(row.column("neighbours"), np.int32).reshape(len(ids), -1)
        return graph, ids, vectors

    def answer(graph: Graph, ids: np.ndarray, vectors: np.ndarray, names: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
        scaled = asked / np.abs(asked).max(axis=1, keepdims=True)
        scaled /= np.sqrt(np.einsum("qd,qd->q", scaled, scaled))[:, None]
        found = graph.walk(np.concatenate([scaled, np.zeros((len(asked), 1))], axis=1).astype(np.float32), beam)
        out = []
        for at in range(0, len(asked), 256):
            near = found[at : at + 256]
            scores = np.where(near >= 0, np.einsum("qsd,qd->qs", vectors[near], asked[at : at + 256]), -np.inf)
            order = np.lexsort((ids[near], -scores, near < 0))[:, :most]
            near, scores = np.take_along_axis(near, order, 1), np.take_along_axis(scores, order, 1)
            real = near >= 0
            out.append((np.repeat(names[at : at + 256], real.sum(axis=1)), ids[near[real]], scores[real]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query", "point", "score"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if row.column("block")[0].as_py() < 0:
                    graph = graph_of(row)
                elif graph is not None:
                    names = _array(row.column("ids"), np.int64)
                    yield answer(*graph, names, _array(row.column("vectors"), np.float64).reshape(len(names), -1))

    packed = (
        queries.select(F.pmod(F.xxhash64("query", F.lit("block")), F.lit(blocks)).cast("int").alias("block"), "query", "vector")
        .groupBy("block")
        .applyInArrow(pack, "block int, ids binary, vectors binary")
    )
    nothing = F.lit(None).cast("binary")
    graphs = index.select("shard", F.lit(-1).alias("block"), "ids", "vectors", "neighbours", "starts")
    every = F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1)))).alias("shard")
    asked = packed.select(every, "block", "ids", "vectors", nothing.alias("neighbours"), nothing.alias("starts"))
    # The graph of a shard comes first, its blocks after it.
    streams = graphs.unionByName(asked).repartitionByRange(max(1, shards), "shard").sortWithinPartitions("shard", "block")
    hits = streams.mapInArrow(step, _HITS)
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "point"))
    return hits.withColumn("nth", nth).where(F.col("nth") <= most)


def nearest(vectors: DataFrame, every: int = 20, most: int = NEAREST, **options) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by `every` the `most` nearest others found.

    Null ids, and vectors that are null, zero, of another length than most, or
    with null or non-finite components, take no part. Rows equal in id and
    vector are one; an id with several vectors is a query for each of them, and
    never its own neighbour. Equal scores go by smaller id. The score is the
    inner product in double precision.
    """
    sound = usable(vectors)
    points = written(points_of(sound, most + 1), "points")
    own = sound.where(F.col("vec_id") % every == 0).distinct().join(points.select("point", "vector"), "vector")
    asked = written(own.select("vec_id", "point", "vector"), "asked")
    index = written(build(points, options.get("shard_points", SHARD_POINTS)), "graphs")
    different = asked.select(F.col("point").alias("query"), "vector").dropDuplicates(["query"])
    hits = search(index, different, most + 1, options.get("beam", BEAM), options.get("block_queries", BLOCK_QUERIES))
    members = points.select("point", "members")
    spread = hits.join(members, "point").select("query", "score", F.explode("members").alias("vec_id"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    best = (
        spread.withColumn("nth", nth)
        .where(F.col("nth") <= most + 1)
        .groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("best"))
    )
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, most)
    return (
        asked.select(F.col("vec_id").alias("query_id"), F.col("point").alias("query"))
        .join(best, "query")
        .select("query_id", F.posexplode(others).alias("place", "hit"))
        .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
    )
