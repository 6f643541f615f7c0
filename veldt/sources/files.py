"""Reading and writing tables: a folder as catalogue, Parquet, CSV, rows, random tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Catalogue:
    """Tables of a folder: name.parquet or name.csv, or numbered fragments name-0, name-1 and so on."""

    def __init__(self, spark: SparkSession, path: str):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.path, fs = path.rstrip("/"), p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.found: dict[str, list[tuple[int, str]]] = {}
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if m := re.match(r"(.+?)(?:-(\d+))?\.(csv|parquet)$", name):
                self.found.setdefault(m[1], []).append((int(m[2] or 0), f"{self.path}/{name}"))

    def names(self) -> list[str]:
        return sorted(self.found)

    def files(self, name: str) -> list[str]:
        if name not in self.found:
            raise ValueError(f"no file of table {name!r} in {self.path}")
        return [p for _, p in sorted(self.found[name])]


def _chosen(df: DataFrame, columns: list[str] | None) -> DataFrame:
    if columns and (missing := [c for c in columns if c not in df.columns]):
        raise ValueError(f"unknown columns {missing}")
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, paths: list[str], schema: T.StructType | None = None, columns: list[str] | None = None) -> DataFrame:
    """All fragments; columns are cast to those of a declared schema."""
    df = spark.read.parquet(*paths)
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    return _chosen(df, columns)


def read_csv(spark: SparkSession, paths: list[str], schema: T.StructType | None = None, columns: list[str] | None = None) -> DataFrame:
    """Files with a header. Without a schema, names such as `x(int)` give the columns' types, others are inferred."""
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    if schema is not None:
        return _chosen(r.schema(schema).csv(paths), columns)
    typed = [re.match(r"(.+)\(([a-z]+(?:\(\d+,\d+\))?)\)$", c) for c in r.csv(paths).columns]
    if typed and all(typed):
        return _chosen(r.schema(", ".join(f"`{m[1]}` {m[2]}" for m in typed)).csv(paths), columns)
    return _chosen(r.option("inferSchema", True).csv(paths), columns)


def from_rows(spark: SparkSession, rows: list, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def write_csv(df: DataFrame, path: str) -> None:
    """Typed header `name(type)`, quoted where needed."""
    df.select(*[F.col(c).alias(f"{c}({t})") for c, t in df.dtypes]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_fragments(df: DataFrame, path: str, n: int) -> None:
    df.repartition(n).write.mode("overwrite").parquet(path)


def random_table(spark: SparkSession, schema: T.StructType, rows: int, seed: int = 0) -> DataFrame:
    """Seeded random rows of a schema; every batch differs."""

    def column(i: int, f: T.StructField):
        r = F.rand(seed + i)
        t = f.dataType
        if isinstance(t, T.StringType):
            out = F.substring(F.md5(r.cast("string")), 1, 8)
        elif isinstance(t, T.BooleanType):
            out = r < 0.5
        elif isinstance(t, T.DateType):
            out = F.date_add(F.lit("1992-01-01").cast("date"), (r * 2500).cast("int"))
        elif isinstance(t, T.ArrayType):
            out = F.array(*[F.rand(seed + i * 97 + k) for k in range(8)]).cast(t)
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            out = (r * 1000).cast(t)
        else:
            out = (r * 100).cast(t)
        return out.alias(f.name)

    return spark.range(rows).select(*[column(i, f) for i, f in enumerate(schema)])
