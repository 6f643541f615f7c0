"""A session: tables found in a folder or declared, SQL over them."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from veldt.sources.files import Catalogue, read_csv, read_parquet

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def register(spark: SparkSession, sf_dir: str, names=TABLES[:8] + ["embeddings"]) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once an application, unless it is installed, on the PYTHONPATH or, with a local master, in the folder they start in."""
    sc, home = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    seen = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        seen.append(os.getcwd())
    if sc.applicationId in _shipped or home in seen or os.path.basename(home).endswith("-packages"):
        return
    folder = tempfile.mkdtemp(prefix="veldt-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    # the driver's file server hands it out for as long as the application lasts
    sc.addPyFile(shutil.make_archive(f"{folder}/veldt", "zip", home, "veldt"))
    _shipped.add(sc.applicationId)


def parse_schema(ddl: str) -> dict[str, T.StructType]:
    """Table name and schema of each CREATE TABLE in a text. Character types have no padding; TIME is kept as microseconds."""
    out = {}
    for name, body in re.findall(r"CREATE\s+TABLE\s+(\w+)\s*\((.*?)\)\s*(?:;|$)", ddl, re.I | re.S):
        fields = []
        for part in re.split(r",(?![^(]*\))", body):
            m = re.match(r"\s*(\w+)\s+(\w+)\s*(\([^)]*\))?\s*(NOT\s+NULL)?", part, re.I)
            if not m or m[1].upper() in ("PRIMARY", "FOREIGN", "UNIQUE", "CONSTRAINT"):
                continue
            kind = m[2].upper()
            if kind in ("CHAR", "VARCHAR", "TEXT", "STRING"):
                t = T.StringType()
            elif kind in ("DECIMAL", "NUMERIC"):
                p, s = (list(map(int, re.findall(r"\d+", m[3] or ""))) + [18, 3][len(re.findall(r"\d+", m[3] or "")) :])[:2]
                t = T.DecimalType(p, s)
            else:
                t = {"SMALLINT": T.ShortType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "LONG": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "REAL": T.DoubleType(), "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(), "TIMESTAMP": T.TimestampNTZType(), "TIME": T.LongType(), "BOOLEAN": T.BooleanType(), "BOOL": T.BooleanType()}[kind]
            fields.append(T.StructField(m[1], t, not m[4]))
        out[name] = T.StructType(fields)
    return out


class Session:
    def __init__(self, spark: SparkSession, path: str | None = None, schemas: dict[str, T.StructType] | None = None):
        self.spark, self.catalogue, self.schemas = spark, Catalogue(spark, path) if path else None, dict(schemas or {})

    def create_tables(self, ddl: str) -> list[str]:
        found = parse_schema(ddl)
        self.schemas |= found
        return list(found)

    def load_table(self, name: str, columns: list[str] | None = None, cache: bool = False) -> DataFrame:
        """Read all fragments of a table and register it as a view."""
        paths = self.catalogue.files(name)
        read = read_csv if paths[0].endswith(".csv") else read_parquet
        return self.set_table(name, read(self.spark, paths, self.schemas.get(name), columns), cache)

    def set_table(self, name: str, df: DataFrame, cache: bool = False) -> DataFrame:
        df = df.cache() if cache else df
        df.createOrReplaceTempView(name)
        return df

    def get_table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def table_names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables())

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)
