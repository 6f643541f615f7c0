"""Product-quantized index: a code of a few bytes stands for each vector, and exact distances settle the best.

A vector is cut into parts, and each part becomes the number of its nearest
centroid among 256 at most. A search reads keys, lists and codes only: a task
adds up tabled distances, keeps the best k * k_factor rows for each query, and
of these, over all tasks, the true distances decide. It is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.exprs import DISTANCES
from veldt.scratch import materialize

from .ivf import SAMPLE_BYTES, IVFIndex, _closest, kmeans
from .vector import FOUND, _matrix, check, nearest, query_blocks

#: Entries of a codebook, as a code is a byte, and sampled rows for each.
ENTRIES, SAMPLE_PER_ENTRY = 256, 64


class PQIndex:
    """lists: an inverted file or all rows as one list, with the codes in __code; books: part by entry by coordinate."""

    def __init__(self, lists: IVFIndex, books: np.ndarray):
        self.lists, self.books = lists, books
        self.key, self.col, self.metric = lists.key, lists.col, lists.metric

    @classmethod
    def build(cls, data: DataFrame, key: str, col: str, parts: int, lists: int | None = None, metric: str = "L2", sample_bytes: int = SAMPLE_BYTES) -> PQIndex:
        """Fit the codebooks on 64 rows an entry and sample_bytes at most, by order of a hash of the key; code every row. Written once to the shared scratch folder.

        Null vectors and those with a null, an infinity or a NaN are left out.
        """
        check(1, None, metric)
        odd = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        rows = data.where(F.col(col).isNotNull() & ~odd)
        index = IVFIndex.build(rows, key, col, f"IVF{lists},Flat" if lists else "Flat", metric)
        dim = rows.agg(F.max(F.size(col))).first()[0] or parts
        if dim % parts:
            raise ValueError(f"{dim} coordinates cannot be cut into {parts} parts")
        sample = rows.select(key, col).orderBy(F.xxhash64(key), key).limit(max(1, min(SAMPLE_PER_ENTRY * ENTRIES, sample_bytes // (8 * dim)))).collect()
        x = _matrix([r[1] for r in sample]) if sample else np.zeros((1, dim))
        cut = x.reshape(len(x), parts, dim // parts)
        books = np.stack([kmeans(cut[:, p], min(ENTRIES, len(x)), "L2") for p in range(parts)])

        @F.pandas_udf("binary")
        def coded(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            y = _matrix(v).reshape(len(v), parts, -1)
            codes = np.stack([_closest(books[p], y[:, p], "L2", 1)[:, 0] for p in range(parts)], axis=1).astype(np.uint8)
            return pd.Series([c.tobytes() for c in codes])

        index.lists = materialize(index.lists.withColumn("__code", coded(F.col(col))), "codes")
        return cls(index, books)

    def _tables(self, q: np.ndarray) -> np.ndarray:
        """Query by part by entry: what an entry adds to the distance, or takes from it for inner products."""
        cut = q.reshape(len(q), len(self.books), -1)
        if self.metric == "IP":
            return -np.einsum("qpd,ped->qpe", cut, self.books)
        return np.stack([((cut[:, p, None] - b) ** 2).sum(axis=2) for p, b in enumerate(self.books)], axis=1)

    def search(self, query: DataFrame, query_key: str, query_col: str, k: int, nprobe: int = 10, k_factor: int = 8, where: Column | None = None, distance: str = "vs_distance") -> DataFrame:
        """Approximate k nearest among the nprobe nearest lists, by codes and then by the true distances of k * k_factor candidates.

        where: a condition on data columns, applied before the search. Columns:
        the query's, data's without vectors, the distance.
        """
        check(k, None, self.metric)
        rows = self.lists.lists if where is None else self.lists.lists.where(where)
        data, c, n = rows.drop("__list", "__code"), self.lists.centroids, k * max(1, k_factor)
        found = data.sparkSession.createDataFrame([], FOUND)
        for ids, q, _ in query_blocks(query, query_key, query_col):
            if not len(ids):
                continue
            if q.shape[1] != self.books.shape[0] * self.books.shape[2]:
                raise ValueError("vectors differ in length")
            probed = np.ones((len(ids), 1), bool)
            if c is not None and len(c):
                probed = np.zeros((len(ids), len(c)), bool)
                np.put_along_axis(probed, _closest(c, q, self.metric, nprobe), True, axis=1)
            some = np.flatnonzero(probed.any(axis=0)).tolist()
            part = rows.where(F.col("__list").isin(some)).select(F.col(self.key).cast("bigint").alias("k"), F.xxhash64(self.col).alias("h"), F.col("__code").alias("c"), F.col("__list").alias("l"))
            found = found.union(part.mapInArrow(_scan(ids, self._tables(q), probed, n), FOUND))
        found = nearest(found.distinct(), ["q"], "d", "k", n).select(F.col("q").alias("__q"), F.col("k").alias("__k"), F.col("h").alias("__h"))
        both = set(query.drop(query_col).columns) & set(data.drop(self.col).columns)
        if both:
            raise ValueError(f"query and data share columns {sorted(both)}; rename them")
        out = found.join(query, F.col("__q") == F.col(query_key)).join(data, (F.col("__k") == F.col(self.key)) & (F.col("__h") == F.xxhash64(self.col)))
        out = out.withColumn(distance, DISTANCES[self.metric](self.col, query_col))
        out = nearest(out, ["__q"], distance, "__k", k, self.metric)
        return out.select(*query.drop(query_col).columns, *data.drop(self.col).columns, distance)


def _scan(ids: np.ndarray, tables: np.ndarray, probed: np.ndarray, n: int):
    """A mapInArrow step over rows of k, h, c (code), l (list): the n best a query and task by tabled distances."""
    part = np.arange(tables.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column("c").to_pylist()), np.uint8).reshape(-1, len(part))
            keys, hashes, lists = (batch.column(x).to_numpy(zero_copy_only=False) for x in "khl")
            for i, table in enumerate(tables):
                own = np.flatnonzero(probed[i, lists])
                d = np.concatenate([best[i][0], table[part, codes[own]].sum(axis=1)])
                k, h = (np.concatenate([a, b[own]]) for a, b in zip(best[i][1:], (keys, hashes), strict=True))
                order = np.lexsort((h, k, d))[:n]
                best[i] = (d[order], k[order], h[order])
        for i, (d, k, h) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), ids[i]), pa.int64()), pa.array(k, pa.int64()), pa.array(h, pa.int64()), pa.array(d, pa.float64())], names=["q", "k", "h", "d"])

    return run
