"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Distinct vectors are dealt to shards by a hash: SPREAD of them, fewer where they would fall under SHARD_LEAST vectors,
more only where they would pass SHARD_ROWS vectors or SHARD_BYTES, so that a search meets few shards. In a shard, points join the graph in batches: a
greedy search from the medoid proposes neighbours, and pruning keeps a candidate only where no kept neighbour is nearer
to it by the factor ALPHA, which leaves few but diverse edges; backward edges are added and pruned alike. Beam search
answers queries on every shard, and the best of all shards are ranked by cosine in double precision on the original
vectors. The index is a table of one row per vector: shard, ids, vector and edges.

Exact copies are one vector with its TOP + 1 smallest ids, found before the shuffle. Vectors that are null or zero, or
hold null or non-finite components, and rows without an id take no part; vectors of other lengths are other shards and
never meet. A query's own id is no candidate, also on repeated rows. Ties go to the smaller vec_id. One vec_id with two
vectors is two points and two queries, whose results are ranked together, the better score of a neighbour counting. An
empty table gives no rows; columns but vec_id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm import common

SPREAD, SHARD_LEAST, SHARD_ROWS, SHARD_BYTES = 16, 4096, 1 << 17, 1 << 26
DEGREE, BUILD_BEAM, BEAM, ALPHA, TOP = 32, 56, 112, 1.2, 5
#: Points that join at once, nodes that a search opens at once, queries searched at once.
BATCH, WIDTH, QUERIES = 256, 4, 256
#: Shards whose list is broadcast.
FEW = 10_000


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    """points: unit vectors (float32); edges: (n, DEGREE), -1 where there is none."""

    def __init__(self, points: np.ndarray, edges: np.ndarray | None = None):
        self.points = np.ascontiguousarray(points, np.float32)
        n = len(points)
        self.start = int((self.points @ self.points.mean(0)).argmax()) if n else 0
        self.edges = np.full((n, DEGREE), -1, np.int32) if edges is None else edges
        if edges is None:
            self._build()

    def search(self, queries: np.ndarray, beam: int, opened: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the `beam` best found for each query, -1 where there are fewer."""
        q, rows = len(queries), np.arange(len(queries))[:, None]
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -9.0, np.float32)
        done = np.ones((q, beam), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = self.start, queries @ self.points[self.start], False
        seen = np.zeros((q, len(self.points) + 1), bool)  # the last column stands for -1
        seen[:, self.start] = seen[:, -1] = True
        while True:
            rank = np.where(done, -9.0, sims)
            pick = np.argpartition(-rank, WIDTH - 1, axis=1)[:, :WIDTH]
            live = ~done[rows, pick]
            if not live.any():
                return ids, sims
            done[rows, pick] = True
            nodes = np.where(live, ids[rows, pick], -1)
            if opened is not None:
                opened.append(nodes)
            near = np.where(nodes[:, :, None] >= 0, self.edges[nodes], -1).reshape(q, -1).astype(np.int64)
            near.sort(axis=1)  # a node that two opened nodes name counts once
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[rows, near]] = -1
            seen[rows, near] = True
            s = np.where(near >= 0, np.einsum("qkd,qd->qk", self.points[near], queries, optimize=False), -9.0).astype(np.float32)
            ids, sims, done = np.concatenate([ids, near], 1), np.concatenate([sims, s], 1), np.concatenate([done, near < 0], 1)
            best = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            ids, sims, done = ids[rows, best], sims[rows, best], done[rows, best]

    def _prune(self, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For each point of `at` its edges, from candidates ids (-1: none)."""
        rows = np.arange(len(at))
        ids = np.where(ids == at[:, None], -1, ids)
        ids = -np.sort(-ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        x = self.points[ids]
        d = np.where(ids >= 0, 2 - 2 * np.einsum("qkd,qd->qk", x, self.points[at]), np.inf)
        alive, out = ids >= 0, np.full((len(at), DEGREE), -1, np.int32)
        for k in range(DEGREE):
            pick = np.where(alive, d, np.inf).argmin(1)
            ok = alive[rows, pick]
            if not ok.any():
                break
            out[ok, k] = ids[rows, pick][ok]
            alive[rows, pick] = False
            between = 2 - 2 * np.einsum("qkd,qd->qk", x, x[rows, pick])
            alive &= ~(ok[:, None] & (ALPHA * ALPHA * between <= d))
        return out

    def _build(self) -> None:
        n = len(self.points)
        order = np.random.RandomState(7).permutation(n)
        order = np.r_[self.start, order[order != self.start]] if n else order
        k = 1
        while k < n:
            new = order[k : k + min(BATCH, k)]
            opened: list = []
            ids, _ = self.search(self.points[new], min(BUILD_BEAM, max(WIDTH, k)), opened)
            found = np.concatenate([ids, *opened], 1)
            found = np.concatenate([found, np.broadcast_to(new[: min(len(new), 32)], (len(new), min(len(new), 32)))], 1) if k < 64 else found
            self.edges[new] = self._prune(new, found)
            a, b = np.repeat(new, DEGREE), self.edges[new].ravel()
            a, b = a[b >= 0], b[b >= 0]
            by = np.argsort(b, kind="stable")
            a, b = a[by], b[by]
            nodes, first, count = np.unique(b, return_index=True, return_counts=True)
            back = np.full((len(nodes), int(count.max(initial=0))), -1, np.int64)
            back[np.repeat(np.arange(len(nodes)), count), np.arange(len(b)) - np.repeat(first, count)] = a
            every = np.concatenate([self.edges[nodes].astype(np.int64), back], 1)
            for i in range(0, len(nodes), BATCH):
                some = every[i : i + BATCH]
                full = (some >= 0).sum(1) > DEGREE
                at = nodes[i : i + BATCH]
                kept = -np.sort(-some[~full], axis=1)[:, :DEGREE]
                if kept.shape[1] < DEGREE:
                    kept = np.pad(kept, ((0, 0), (0, DEGREE - kept.shape[1])), constant_values=-1)
                self.edges[at[~full]] = kept
                if full.any():
                    self.edges[at[full]] = self._prune(at[full], some[full])
            k += len(new)


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """vec_id long, vector array<double> of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    good = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector")).where("vec_id is not null and vector is not null").where(good)


_INDEX = "shard int, node int, ids array<long>, vector array<double>, edges array<int>"


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition is a shard (shard, ids, vector, ids_key)."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts).sort_by([("shard", "ascending"), ("ids_key", "ascending")]).combine_chunks()
    shards = rows.column("shard").to_numpy()
    cuts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1], True])
    for i, j in zip(cuts[:-1], cuts[1:]):
        some = rows.slice(i, j - i)
        edges = Graph(unit(_vectors(pa.concat_arrays(some.column("vector").chunks)))).edges
        for k in range(0, j - i, 8192):
            part = some.slice(k, 8192).combine_chunks()
            n = part.num_rows
            columns = [pa.array(np.full(n, shards[i], np.int32)), pa.array(np.arange(k, k + n, dtype=np.int32)), part.column("ids").chunk(0), part.column("vector").chunk(0), pa.array(list(edges[k : k + n]), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "node", "ids", "vector", "edges"])


def n_shards(n: int, dim: int, most: int = SHARD_ROWS) -> int:
    """Shards for n vectors of a length."""
    return max(-(-n // min(most, max(1, SHARD_BYTES // (4 * max(1, dim))))), min(SPREAD, -(-n // SHARD_LEAST)), 1)


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors: of usable(). The index table, written to the shared folder; a shard holds about shard_rows vectors at most."""
    ranked = vectors.distinct().withColumn("key", F.xxhash64("vector")).withColumn("k", F.row_number().over(Window.partitionBy("key", "vector").orderBy("vec_id"))).where(F.col("k") <= TOP + 1)
    each = common.materialise(ranked.groupBy("key", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")  # TOP + 1 ids at most
    sizes = {r[0]: r[1] for r in each.groupBy(F.size("vector")).count().collect()}
    shards, first = F.lit(0), 0
    for dim in sorted(sizes):
        n = n_shards(sizes[dim], dim, shard_rows)
        shards = F.when(F.size("vector") == dim, F.lit(first) + F.pmod("key", F.lit(n))).otherwise(shards)
        first += n
    dealt = each.select(shards.cast("int").alias("shard"), "ids", "vector", F.element_at("ids", 1).alias("ids_key"))
    return common.materialise(common.arrow_map(dealt.repartitionById(max(1, first), "shard"), _index, _INDEX), "graph")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, its nodes in order (node >= 0) before its queries (node -1)."""
    shard, parts, graph = None, [], None
    for b in batches:
        shards, node = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | ((node[1:] < 0) != (node[:-1] < 0)), True])
        for i, j in zip(cuts[:-1], cuts[1:]):
            if shards[i] != shard:
                shard, parts, graph = shards[i], [], None
            part = b.slice(i, j - i)
            if node[i] >= 0:
                parts.append(part)
                continue
            if graph is None:
                x = np.concatenate([_vectors(p.column(3)) for p in parts]) if parts else np.zeros((0, 1))
                ids = [v for p in parts for v in p.column(2).to_pylist()]
                edges = np.concatenate([_vectors(p.column(4)) for p in parts]).astype(np.int32) if parts else np.zeros((0, DEGREE), np.int32)
                graph = Graph(unit(x), edges) if len(x) else None
            q = _vectors(part.column(3))
            if graph is None or q.shape[1] != x.shape[1]:
                continue
            asked = [v[0] for v in part.column(2).to_pylist()]
            for k in range(0, len(q), QUERIES):
                some = q[k : k + QUERIES]
                found, sims = graph.search(unit(some).astype(np.float32), max(WIDTH, BEAM))
                best = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * TOP + 2]
                rows = []
                for n, v, f in zip(asked[k : k + QUERIES], some, np.take_along_axis(found, best, 1)):
                    f = f[f >= 0]
                    big, own = np.abs(v).max(), x[f]
                    own_big = np.abs(own).max(1, keepdims=True)
                    a, c = v / big, own / own_big
                    cos = (c * a).sum(1) / (np.sqrt((a * a).sum()) * np.sqrt((c * c).sum(1)))
                    nearest: dict[int, float] = {}  # an id with several vectors counts once
                    for sim, at in sorted(zip((-cos).tolist(), f.tolist())):
                        for i in ids[at]:
                            if i != n:
                                nearest.setdefault(i, sim)
                    rows += sorted((sim, i, n) for i, sim in nearest.items())[:TOP]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([-r[0] for r in rows], pa.float64())], names=["query_id", "vec_id", "score"])


def search(index: DataFrame, queries: DataFrame) -> DataFrame:
    """queries: of usable(). query_id, rank, vec_id, score of the TOP nearest found in all shards."""
    shards = index.select("shard", F.size("vector").alias("dim")).distinct()
    n = 1 + (index.agg(F.max("shard")).first()[0] or 0)
    asked = queries.distinct().join(F.broadcast(shards) if n <= FEW else shards, F.size("vector") == F.col("dim"))  # a row a shard
    asked = asked.select("shard", F.lit(-1).alias("node"), F.array("vec_id").alias("ids"), "vector", F.lit(None).cast("array<int>").alias("edges"))
    both = index.unionByName(asked).repartitionById(n, "shard").sortWithinPartitions("shard", F.col("node") < 0, "node")
    found = common.arrow_map(both, _search, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= TOP).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(common.table(spark, sf_dir, "embeddings"), "embedding")
    return search(build_index(rows), rows.where("vec_id % 50 = 0"))
