"""Tables written once to the folder that driver and executors share, which cuts lineage: lost executors only cost a re-read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_mine: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where that is unset, a temporary one for a local master and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="veldt-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _mine:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


atexit.register(_sweep)


class Table:
    """A DataFrame written once to the shared scratch folder."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{scratch_root(self.spark)}/veldt-{label}-{uuid.uuid4().hex}"
        _mine.append((self.spark, self.path))
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def scratch_mark() -> int:
    """A mark for drop_scratch."""
    return len(_mine)


def drop_scratch(mark: int, keep: Table) -> None:
    """Delete the scratch tables written since the mark, but for one."""
    for spark, path in [x for x in _mine[mark:] if x[1] != keep.path]:
        _delete(spark, path)
    _mine[mark:] = [x for x in _mine[mark:] if x[1] == keep.path]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back."""
    return Table(df, label).df
