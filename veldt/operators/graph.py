"""Graph index: layered neighbour graphs, one for each shard of the data, walked from layer to layer.

Rows are dealt to shards of a bounded size by a hash of key and vector, equal
rows once; a task links a shard's different vectors and stores the graph as one
value. The layers hold ever fewer vectors. A link leads to a near vector that no
closer link already stands for; links back and links between parts that would
stay apart are added. Inner product is searched as a distance, with one more
coordinate that gives all vectors of a shard the same length.

A search walks all shards in parallel and all queries of a block at once, each
with its `ef` nearest vectors so far; it is approximate. Null vectors and those
with a null, an infinity or a NaN are not indexed and, as queries, find none.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.scratch import materialize

from .vector import FOUND, _joined, _vectors, check, nearest, query_blocks

#: Rows and bytes of vectors that a shard may have.
SHARD_ROWS, SHARD_BYTES = 1 << 16, 64 << 20


def _square(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of each q to its own rows of x."""
    d = x - q[:, None]
    return np.einsum("abd,abd->ab", d, d)


def _candidates(x: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest others of some vectors and their distances, nearest first."""
    x2 = (x * x).sum(axis=1)
    rough = x2[None] - 2 * (x[own] @ x.T)
    rough[np.arange(len(own)), own] = np.inf
    near = np.argpartition(rough, n - 1, axis=1)[:, :n]
    d = _square(x[own], x[near])
    order = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)


def _diverse(x: np.ndarray, near: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """Which candidates are nearer to their vector than to any candidate kept before; the nearest of the others fill up to `most`."""
    v = x[near]
    v2 = (v * v).sum(axis=2)
    between = v2[:, :, None] + v2[:, None] - 2 * (v @ v.transpose(0, 2, 1))
    keep = np.zeros(near.shape, bool)
    for j in range(near.shape[1]):
        keep[:, j] = ~(keep & (between[:, j] < d[:, j : j + 1])).any(axis=1) & (keep.sum(axis=1) < most)
    place = np.argsort(~keep, axis=1, kind="stable")[:, :most]
    out = np.zeros(near.shape, bool)
    np.put_along_axis(out, place, True, axis=1)
    return out


class _Links:
    """Links of one layer: at most `degree` for each vector by distance, and a few places for connections."""

    SPARE = 4

    def __init__(self, x: np.ndarray, degree: int):
        n, dim = x.shape
        self.x, self.count = x, np.zeros(n, np.int64)
        self.to = np.repeat(np.arange(n)[:, None], degree + self.SPARE, axis=1)  # free places lead to the vector itself
        some = min(n - 1, 2 * degree)
        if not some:
            return
        step, edges = max(1, min(SHARD_BYTES // (8 * n), SHARD_BYTES // (8 * some * (dim + some)))), []
        for a in range(0, n, step):
            own = np.arange(a, min(n, a + step))
            near, d = _candidates(x, own, some)
            r, c = np.nonzero(_diverse(x, near, d, max(1, degree // 2)))
            edges.append((own[r], near[r, c], d[r, c]))
        a, b, d = (np.concatenate(z) for z in zip(*edges, strict=True))
        # a vector's own links come first, then those back to it, nearest first
        src, dst, back, d = np.concatenate([a, b]), np.concatenate([b, a]), np.repeat([0, 1], len(a)), np.concatenate([d, d])
        order = np.lexsort((dst, d, back, src))
        src, dst = src[order], dst[order]
        first = np.sort(np.unique(src * n + dst, return_index=True)[1])
        src, dst = src[first], dst[first]
        place = np.arange(len(src)) - np.searchsorted(src, src)
        src, dst, place = (z[place < degree] for z in (src, dst, place))
        self.to[src, place] = dst
        self.count = np.bincount(src, minlength=n)
        self._connect()

    def _spread(self, seen: np.ndarray, front: np.ndarray) -> None:
        while len(front):
            seen[front] = True
            front = np.unique(self.to[front])
            front = front[~seen[front]]

    def _connect(self) -> None:
        """Lead from vector 0 to every vector: the nearest reached one with a free place gets a link to the first that is not."""
        seen = np.zeros(len(self.x), bool)
        self._spread(seen, np.array([0]))
        while not seen.all():
            u = int(np.argmin(seen))
            free = np.flatnonzero(seen & (self.count < self.to.shape[1]))
            r = free[((self.x[free] - self.x[u]) ** 2).sum(axis=1).argmin()]
            self.to[r, self.count[r]] = u
            self.count[r] += 1
            self._spread(seen, np.array([u]))


def build_graph(x: np.ndarray, m: int, seed: int = 7) -> tuple[np.ndarray, list[np.ndarray]]:
    """An order of the vectors, and the links of each layer between places in it; a layer has the first of them, the lowest all."""
    order = np.random.default_rng(seed).permutation(len(x))
    x, sizes = x[order], [len(x)]
    while sizes[-1] > 2 * m:
        sizes.append(max(1, sizes[-1] // m))
    return order, [_Links(x[:n], 2 * m if not i else m).to.astype(np.int32) for i, n in enumerate(sizes)]


def _walk(x: np.ndarray, links: np.ndarray, ids: np.ndarray, q: np.ndarray, ef: int, width: int, allowed: np.ndarray | None = None, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and distances, nearest first, that each query meets from its vectors ids: the ef nearest, or the k nearest allowed. Infinite distances fill up."""
    rows, seen = np.arange(len(q))[:, None], np.zeros((len(q), len(links)), bool)
    seen[rows, ids] = True
    d = _square(q, x[ids])
    done = np.zeros(ids.shape, bool)

    def cut(n, ids, d, *more):
        order = np.argsort(d, axis=1, kind="stable")[:, :n]
        return [np.take_along_axis(z, order, 1) for z in (ids, d, *more)]

    best = None if allowed is None else cut(k, ids, np.where(allowed[ids], d, np.inf))
    while True:
        open_ = np.where(done, np.inf, d)
        pick = np.argsort(open_, axis=1, kind="stable")[:, :width]
        use = np.isfinite(np.take_along_axis(open_, pick, 1))
        a = np.flatnonzero(use.any(axis=1))
        if not len(a):
            return (ids, d) if best is None else tuple(best)
        pick, use, at = pick[a], use[a], a[:, None]
        near = links[ids[at, pick]]
        done[at, pick] = True
        near = np.sort(np.where(use[:, :, None], near, ids[at, pick[:, :1]][:, :, None]).reshape(len(a), -1), axis=1)
        new = ~seen[at, near]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[at, near] = True
        far = np.full(near.shape, np.inf)
        r, c = np.nonzero(new)
        diff = x[near[r, c]] - q[a[r]]
        far[r, c] = np.einsum("ij,ij->i", diff, diff)

        def widened(z, rows, fill):
            out = np.full((len(q), near.shape[1]), fill, z.dtype)
            out[a] = rows
            return np.concatenate([z, out], axis=1)

        if best is not None:
            best = cut(k, widened(best[0], near, 0), widened(best[1], np.where(allowed[near], far, np.inf), np.inf))
        ids, d, done = cut(ef, widened(ids, near, 0), widened(d, far, np.inf), widened(done, ~np.isfinite(far), True))


def _lifted(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors among which the nearest of (q, 0) are the nearest of q by the metric."""
    if metric == "L2":
        return x
    x2 = (x * x).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(x2.max(initial=0.0) - x2, 0))[:, None]], axis=1)


def _search_shard(g: dict[str, np.ndarray], q: np.ndarray, metric: str, k: int, ef: int, width: int, rows: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Query and vector of the hits of a shard; rows: which of its rows are allowed."""
    x = _lifted(g["x"], metric)
    q = q if metric == "L2" else np.concatenate([q, np.zeros((len(q), 1))], axis=1)
    n, layers = len(x), [g[f"links{i}"] for i in range(int(g["layers"]))]
    allowed = None if rows is None else np.bincount(g["vector"][rows], minlength=n) > 0
    few = np.flatnonzero(allowed) if allowed is not None else None
    reach = layers[0].shape[1]
    step = max(1, min(256, (1 << 24) // (max(1, width * reach, len(layers[-1])) * x.shape[1])))
    out = []
    for a in range(0, len(q), step):
        some = q[a : a + step]
        if few is not None and len(few) <= max(k, ef) * 4:  # a walk would meet hardly any of them
            ids, d = np.tile(few, (len(some), 1)), np.stack([((x[few] - v) ** 2).sum(axis=1) for v in some])
        else:
            ids = np.tile(np.arange(len(layers[-1])), (len(some), 1))
            ids = np.take_along_axis(ids, np.argsort(_square(some, x[ids]), axis=1)[:, :1], 1)
            for links in layers[-2:0:-1]:
                ids = _walk(x, links, ids, some, 8, 1)[0][:, :1]
            ids, d = _walk(x, layers[0], ids, some, max(ef, k), width, allowed, k)
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        r, c = np.nonzero(np.isfinite(np.take_along_axis(d, order, 1)))
        out.append((r + a, np.take_along_axis(ids, order, 1)[r, c]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))


class GraphIndex:
    """shards: a DataFrame of __shard and graph, the stored graph; data: the rows that were indexed."""

    def __init__(self, data: DataFrame, shards: DataFrame, n: int, key: str, col: str, metric: str):
        self.data, self.shards, self.n, self.key, self.col, self.metric = data, shards, n, key, col, metric

    @classmethod
    def build(cls, data: DataFrame, key: str, col: str, m: int = 32, metric: str = "L2", shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> GraphIndex:
        """Graphs of m links a vector and layer (2 m in the lowest), written once to the shared scratch folder."""
        check(1, None, metric)
        if m < 2:
            raise ValueError("a graph needs at least 2 links a vector")
        rows = data.where(F.col(col).isNotNull())
        total, dim = rows.agg(F.count(F.lit(1)), F.max(F.size(col))).first()
        n = max(1, -(-total // max(1, min(shard_rows, shard_bytes // (8 * (dim or 1))))))
        small = rows.select(F.col(key).cast("bigint").alias("k"), F.xxhash64(col).alias("h"), F.col(col).alias("v")).dropDuplicates(["k", "h"])

        def linked(t: pa.Table) -> pa.Table:
            shard, t = t.column("s")[0].as_py(), t.sort_by([("k", "ascending"), ("h", "ascending")])
            x = _vectors(t.column("v").combine_chunks())
            ok = np.isfinite(x).all(axis=1)
            keys, hashes = (t.column(c).to_numpy()[ok] for c in "kh")
            x, vector = np.unique(x[ok], axis=0, return_inverse=True)
            g = {"k": keys, "h": hashes, "layers": np.array(0)}
            if len(x):
                order, links = build_graph(_lifted(x, metric), m)
                vector = np.argsort(order)[vector.reshape(-1)]
                g |= {"x": x[order], "vector": vector, "layers": np.array(len(links))} | {f"links{i}": z for i, z in enumerate(links)}
            out = io.BytesIO()
            np.savez(out, **g)
            return pa.table({"__shard": pa.array([shard], pa.int32()), "graph": pa.array([out.getvalue()], pa.binary())})

        shards = small.withColumn("s", cls._shard(n)).groupBy("s").applyInArrow(linked, "__shard int, graph binary")
        return cls(data, materialize(shards, "graph"), n, key, col, metric)

    @staticmethod
    def _shard(n: int) -> Column:
        return F.pmod(F.xxhash64("k", "h"), F.lit(n)).cast("int")

    def save(self, root: str) -> str:
        """Write the graphs; the data stay where they are."""
        self.shards.write.mode("overwrite").parquet(root)
        return root

    @classmethod
    def load(cls, spark: SparkSession, path: str, data: DataFrame, n: int, key: str, col: str, metric: str = "L2") -> GraphIndex:
        """Graphs of the same data, of which build made n shards."""
        return cls(data, spark.read.parquet(path), n, key, col, metric)

    def search(self, query: DataFrame, query_key: str, query_col: str, k: int, ef: int = 64, width: int = 1, where: Column | None = None, distance: str = "vs_distance") -> DataFrame:
        """Approximate k nearest by a walk that keeps the ef nearest and leaves `width` vectors a step.

        where: a condition on data columns; the walk passes all vectors and keeps
        those allowed, and takes these alone where a shard has few of them.
        Columns: the query's, data's without vectors, the distance.
        """
        check(k, None, self.metric)
        if ef < 1 or width < 1:
            raise ValueError("ef and width are positive")
        data, metric, filtered = (self.data if where is None else self.data.where(where)), self.metric, where is not None
        shards = self.shards
        if filtered:
            # a shard's rows are bounded, and so is the list of those allowed
            rows = data.where(F.col(self.col).isNotNull()).select(F.col(self.key).cast("bigint").alias("k"), F.xxhash64(self.col).alias("h")).distinct()
            may = rows.groupBy(self._shard(self.n).alias("__s")).agg(F.collect_list("k").alias("k"), F.collect_list("h").alias("h"))
            shards = shards.join(may, F.col("__shard") == F.col("__s")).select("graph", "k", "h")
        else:
            shards = shards.select("graph")
        found = None
        for ids, q, _ in query_blocks(query, query_key, query_col):

            def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in range(batch.num_rows if len(q) else 0):
                        with np.load(io.BytesIO(batch.column("graph")[row].as_buffer()), allow_pickle=False) as z:
                            g = dict(z)
                        if not int(g["layers"]):
                            continue
                        if g["x"].shape[1] != q.shape[1]:
                            raise ValueError("vectors differ in length")
                        rows = np.arange(len(g["k"]))
                        if filtered:
                            own = set(zip(batch.column("k")[row].as_py(), batch.column("h")[row].as_py(), strict=True))
                            rows = np.array([i for i, pair in enumerate(zip(g["k"].tolist(), g["h"].tolist(), strict=True)) if pair in own], int)
                        r, v = _search_shard(g, q, metric, k, ef, width, rows if filtered else None)
                        # a vector's rows by key, k at most
                        rows = rows[np.lexsort((g["k"][rows], g["vector"][rows]))]
                        owner = g["vector"][rows]
                        start, stop = np.searchsorted(owner, v), np.searchsorted(owner, v, "right")
                        n = np.minimum(stop - start, k)
                        at = rows[np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                        d = np.einsum("ij,ij->i", q[r], g["x"][v]) if metric == "IP" else ((q[r] - g["x"][v]) ** 2).sum(axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[r], n), pa.int64()), pa.array(g["k"][at], pa.int64()), pa.array(g["h"][at], pa.int64()), pa.array(np.repeat(d, n), pa.float64())], names=["q", "k", "h", "d"])

            part = shards.mapInArrow(run, FOUND)
            found = part if found is None else found.union(part)
        found = data.sparkSession.createDataFrame([], FOUND) if found is None else nearest(found, ["q"], "d", "k", k, metric)
        return _joined(data, query, self.key, query_key, self.col, query_col, found, False, False, distance, k, metric)
