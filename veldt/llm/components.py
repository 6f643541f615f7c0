"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table


def _stars(edges: DataFrame) -> bool:
    """Whether each vertex is either the centre of its edges or has a single edge, to a centre."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return per.agg(F.count_if(F.expr("out > 1 or out = 1 and into = 1"))).first()[0] == 0


def _joined(edges: DataFrame, mins: DataFrame) -> tuple[DataFrame, Table]:
    # written out, so that the join deals both sides and Spark can split the edges of a hot vertex
    m = Table(mins, "mins")
    return edges.join(m.df, "u"), m


def components(edges: DataFrame) -> DataFrame:
    """u, component (the smallest vertex it is connected with) for each vertex of edges(u, v).

    Every step writes its edges to the shared folder. Large-star links each
    vertex's larger neighbours to its smallest; small-star links a vertex and
    its smaller neighbours to the smallest. Both keep the components and end
    in stars, in about log2 of the longest path's rounds; stars need none. No
    vertex's neighbours are gathered: only their minimum is.
    """
    e = Table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(e.df):
        both = e.df.union(e.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big, m1 = _joined(both.where("v > u"), both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = Table(big.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        small, m2 = _joined(large.df, large.df.groupBy("u").agg(F.min("v").alias("m")))
        pairs = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(m2.df.select("u", F.col("m").alias("v")))
        new = Table(pairs.distinct(), "edges")
        for t in (e, m1, large, m2):
            t.drop()
        e = new
    return e.df.select("u", F.col("v").alias("component")).union(e.df.select("v", "v").distinct())
