"""Intermediate tables in the folder that all executors share.

Cutting lineage by writing a table instead of ``localCheckpoint`` survives the
loss of executors, keeps column statistics for the optimizer and is columnar,
hence smaller than an RDD checkpoint.  The folder is the one the cluster names
in ``spark.checkpoint.dir``; only a local session without that setting gets a
temporary folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application.

    Raises ``RuntimeError`` on a cluster that names no checkpoint folder, as a
    machine-local folder would not be seen by the other machines.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.get(sc.applicationId)
        if base is None:
            base = tempfile.mkdtemp(prefix="lexweave-")
            _own[sc.applicationId] = base
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/lexweave-{sc.applicationId}"


class Table:
    """A written intermediate table; ``df`` reads it, ``drop`` deletes it."""

    def __init__(self, spark: SparkSession, path: str, schema) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def drop(self) -> None:
        p, fs = self._fs()
        fs.delete(p, True)


def save(df: DataFrame, name: str, **options: str) -> Table:
    """Write ``df`` as an intermediate table, with options of the writer, and return a handle on it."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    return Table(spark, path, df.schema)

