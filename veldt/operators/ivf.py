"""Inverted-file index: k-means lists over an embedding column, probed by list.

Queries and the lists that they probe go to every task, in blocks of a checked
size, so a search moves no data: a task compares the rows of a list with the
queries that probe it, and lists that none probes are not read if the index was
saved, which partitions it by list.
"""

from __future__ import annotations

import hashlib
import json
import re
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.scratch import materialize

from .vector import FOUND, _joined, _matrix, check, conditional, distances, kernel, knn_join, nearest, query_blocks, searched

#: Bytes of vectors that k-means may be fitted on.
SAMPLE_BYTES = 512 << 20


def parse_spec(spec: str) -> int | None:
    """Number of lists of a factory text; None for exhaustive search. Graph and product-quantized indexes are not offered."""
    parts = [p for p in spec.split(",") if p != "GPU"]
    if parts == ["Flat"]:
        return None
    if (m := re.match(r"IVF(\d+)$", parts[0])) and parts[1:] in ([], ["Flat"]):
        return int(m[1])
    raise ValueError(f"index {spec!r} is not offered; use Flat or IVF<lists>,Flat")


def parse_params(text: str) -> dict[str, int]:
    """Search parameters such as `nprobe=30`; those of other kinds of index are an error."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, _, value = part.partition("=")
        if name.strip() != "nprobe":
            raise ValueError(f"search parameter {name.strip()!r} is not offered; use nprobe")
        out["nprobe"] = int(value)
    return out


def kmeans(x: np.ndarray, k: int, metric: str, steps: int = 10, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        own = _closest(c, x, metric, 1)[:, 0]
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _closest(c: np.ndarray, x: np.ndarray, metric: str, n: int) -> np.ndarray:
    d = distances(c, x, metric).T
    return np.argsort(-d if metric == "IP" else d, axis=1, kind="stable")[:, :n]


class IVFIndex:
    """lists: a DataFrame of __list, the key and the vector column, plus data's other columns."""

    def __init__(self, lists: DataFrame, centroids: np.ndarray | None, key: str, col: str, metric: str):
        self.lists, self.centroids, self.key, self.col, self.metric = lists, centroids, key, col, metric

    @classmethod
    def build(cls, data: DataFrame, key: str, col: str, spec: str, metric: str = "L2", sample_per_list: int = 256, sample_bytes: int = SAMPLE_BYTES) -> IVFIndex:
        """Train on sample_per_list rows a list and sample_bytes at most, by key order of a hash; assign every row."""
        n = parse_spec(spec)
        if n is None:
            return cls(data.withColumn("__list", F.lit(0)), None, key, col, metric)
        rows = data.where(F.col(col).isNotNull())
        total, dim = rows.agg(F.count(F.lit(1)), F.max(F.size(col))).first()
        if total < n * 39:
            warnings.warn(f"{total} rows are few for {n} lists", stacklevel=2)
            n = max(1, min(n, total // 39))
        sample = rows.select(key, col).orderBy(F.xxhash64(key), key).limit(min(sample_per_list * n, max(n, sample_bytes // (8 * (dim or 1))))).collect()
        if not sample:
            return cls(rows.withColumn("__list", F.lit(0)), np.zeros((0, 0)), key, col, metric)
        c = kmeans(_matrix([r[1] for r in sample]), n, metric)

        @F.pandas_udf("int")
        def assigned(v: pd.Series) -> pd.Series:
            return pd.Series(_closest(c, _matrix(v), metric, 1)[:, 0].astype(np.int32)) if len(v) else pd.Series([], dtype="int32")

        return cls(rows.withColumn("__list", assigned(F.col(col))), c, key, col, metric)

    def save(self, root: str, spec: str) -> str:
        """Write lists, partitioned, and centroids under a folder named by content; an existing one is kept."""
        spark = self.lists.sparkSession
        n, sums = self.lists.agg(F.count(F.lit(1)), F.sum(F.xxhash64(self.key, self.col).cast("decimal(38,0)"))).first()
        name = hashlib.sha256(json.dumps([spec, self.col, self.metric, n, str(sums)]).encode()).hexdigest()[:24]
        path = f"{root.rstrip('/')}/{name}"
        self.lists.write.mode("ignore").partitionBy("__list").parquet(f"{path}/lists")
        meta = json.dumps({"key": self.key, "col": self.col, "metric": self.metric, "centroids": None if self.centroids is None else self.centroids.tolist()})
        spark.createDataFrame([(meta,)], "meta string").write.mode("ignore").text(f"{path}/meta")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IVFIndex:
        m = json.loads(spark.read.text(f"{path}/meta").first()[0])
        c = m["centroids"]
        return cls(spark.read.parquet(f"{path}/lists"), None if c is None else np.array(c), m["key"], m["col"], m["metric"])

    def search(self, query: DataFrame, query_key: str, query_col: str, k: int | None = None, radius: float | None = None, nprobe: int = 10, where: Column | None = None, on: Column | None = None, distance: str = "vs_distance", refine: bool = False) -> DataFrame:
        """Approximate k nearest (or those within radius) among the nprobe nearest lists; exact if all are probed.

        where: a condition on data columns (a bitmap column serves as well as an
        expression). on: a condition on columns of both sides. refine, for k
        nearest without `on`: lists beyond these are probed too where a bound on
        their distance lets them hold a vector nearer than the k-th found, so the
        result is exact. Columns: the query's, data's without vectors, the distance.
        """
        check(k, radius, self.metric)
        if refine and (k is None or on is not None):
            raise ValueError("refine needs k and no condition on both sides")
        lists = self.lists.where(where) if where is not None else self.lists
        data = lists.drop("__list")
        if on is not None:
            return self._conditional(lists, query, query_key, query_col, k, radius, nprobe, on, distance)
        if self.centroids is None or not len(self.centroids):
            return knn_join(data, query, self.key, query_key, self.col, query_col, k, radius, self.metric, distance=distance)
        spark, parts = lists.sparkSession, []
        for ids, q, _ in query_blocks(query, query_key, query_col, k=k):
            probed = np.zeros((len(ids), len(self.centroids)), bool)
            if len(ids):
                np.put_along_axis(probed, _closest(self.centroids, q, self.metric, nprobe), True, axis=1)
            found = self._probe(lists, ids, q, probed, k, radius)
            if refine and not probed.all():
                # a row a query of the block comes to the driver
                found = materialize(nearest(found, ["q"], "d", "k", k, self.metric), "found")
                last = {r[0]: r[1] for r in found.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, (F.max if self.metric == "L2" else F.min)("d"))).collect()}
                more = self._open(q, np.array([last.get(i) for i in ids.tolist()], float)) & ~probed
                found = found.union(self._probe(lists, ids, q, more, k, radius)) if more.any() else found
            parts.append(found)
        found = spark.createDataFrame([], FOUND)
        for part in parts:
            found = found.union(part)
        if k is not None:
            found = nearest(found, ["q"], "d", "k", k, self.metric)
        return _joined(data, query, self.key, query_key, self.col, query_col, found, False, False, distance, k, self.metric)

    def _probe(self, lists: DataFrame, ids: np.ndarray, q: np.ndarray, probed: np.ndarray, k: int | None, radius: float | None) -> DataFrame:
        """Hits of queries in the lists marked in probed (queries by lists)."""
        some = np.flatnonzero(probed.any(axis=0)).tolist()
        rows = lists if len(some) == probed.shape[1] else lists.where(F.col("__list").isin(some))
        rows = rows.select(F.col(self.key).cast("bigint").alias("k"), F.xxhash64(self.col).alias("h"), F.col(self.col).alias("v"), F.col("__list").alias("l"))
        if probed.all():
            return searched(rows, kernel(ids, q, self.metric, k, radius))
        members = [np.flatnonzero(p) for p in probed.T]
        return searched(rows, kernel(ids, q, self.metric, k, radius, group=lambda batch: batch.column("l").to_numpy(), members=members))

    def _open(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Which lists may hold a vector as near as the k-th found (NaN: fewer than k), by the triangle inequality or Cauchy-Schwarz; a little slack for rounding."""
        far, d = self._radii(), distances(self.centroids, q, self.metric).T
        bound = np.maximum(np.sqrt(np.maximum(d, 0)) - far, 0) ** 2 if self.metric == "L2" else -d - np.sqrt((q**2).sum(axis=1))[:, None] * far
        worst = kth * (1 if self.metric == "L2" else -1)
        return (far >= 0) & ~(bound > (worst + 1e-9 * (1 + np.abs(worst)))[:, None])

    def _conditional(self, lists: DataFrame, query: DataFrame, query_key: str, query_col: str, k: int | None, radius: float | None, nprobe: int, on: Column, distance: str) -> DataFrame:
        """Search under a condition on both sides, settled before a distance is computed."""

        def probed(q: np.ndarray) -> np.ndarray:
            out = np.zeros((len(q), len(self.centroids)), bool)
            np.put_along_axis(out, _closest(self.centroids, q, self.metric, nprobe), True, axis=1)
            return out

        some = probed if self.centroids is not None and len(self.centroids) else None
        found = conditional(lists, query, on, self.key, query_key, self.col, query_col, k, radius, self.metric, some)
        return _joined(lists.drop("__list"), query, self.key, query_key, self.col, query_col, found, False, False, distance, k, self.metric, on)

    def _radii(self) -> np.ndarray:
        """The distance of each list's farthest vector from its centroid; a row a list comes to the driver."""
        c = self.centroids

        @F.pandas_udf("double")
        def off(own: pd.Series, v: pd.Series) -> pd.Series:
            return pd.Series(np.sqrt(((_matrix(v) - c[own.to_numpy()]) ** 2).sum(axis=1)) if len(v) else [], dtype="float64")

        far = np.full(len(c), -np.inf)
        for i, r in self.lists.groupBy("__list").agg(F.max(off("__list", self.col))).collect():
            far[i] = r
        return far
