"""Session helpers: shared scratch tables that survive the loss of executors, and table loading.

Lineage is cut by writing Parquet below the folder named in ``spark.checkpoint.dir``, which every executor shares.
Only in local mode without that setting (unit tests) is a private folder used; on a cluster its absence is an error. Written tables also give the optimizer
exact sizes, so its broadcast decisions rest on measured bytes.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or a private one if the session names none."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="rowloom-")
        atexit.register(shutil.rmtree, _own_folder, True)
    return _own_folder


def reachable(spark: SparkSession) -> None:
    """Lets Python workers started from any directory import this package from where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


class Scratch:
    """Intermediate tables of one query, written to the shared folder and dropped as soon as they are superseded."""

    def __init__(self, spark: SparkSession):
        reachable(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/rowloom-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}

    def cut(self, df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it back: the lineage ends here."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        # the frame is kept alive beside its path, so that id() stays unique
        self.__dict__.setdefault("_alive", {})[id(back)] = back
        return back

    def bytes_of(self, df: DataFrame) -> int:
        """Bytes on disk of a table made by :meth:`cut`."""
        path = self._paths[id(df)]
        jvm = self.spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return int(fs.getContentSummary(hadoop).getLength())

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in frames:
            path = self._paths.pop(id(df), None)
            self.__dict__.get("_alive", {}).pop(id(df), None)
            if path is None:
                continue
            jvm = self.spark.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def one_per(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key; of several the one with the smallest other values, so that the choice does not depend on the partitioning."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
