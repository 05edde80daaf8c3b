"""Tables written to the shared folder of the cluster.

The folder is the one the session names in ``spark.checkpoint.dir``. Only where that setting
is absent (unit tests on one machine) does the store make a folder of its own.
"""

from __future__ import annotations

import copy
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN_ROOT = "spark.packetloom.store.root"


class Store:
    _is_scratch = False

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        root = root or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_ROOT, None)
        if not root:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("tables of several machines need a folder that all of them share: set spark.checkpoint.dir")
            root = tempfile.mkdtemp(prefix="spark-")
            spark.conf.set(_OWN_ROOT, root)
        self.root = f"{root.rstrip('/')}/packetloom-{spark.sparkContext.applicationId}"

    def fresh_path(self, name: str) -> str:
        """A path nobody has written yet, so a retried job never sees half a table."""
        return f"{self.root}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write once, read back: cuts the lineage and survives executor loss."""
        path = self.fresh_path(name)
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def scratch(self, name: str) -> Store:
        """A store in a folder of its own inside this one, for tables nobody reads after ``clear``."""
        inner = copy.copy(self)
        inner.root = self.fresh_path(name)
        inner._is_scratch = True
        return inner

    def clear(self) -> None:
        """Deletes all tables of a scratch store; what is still needed must be saved elsewhere first."""
        if not self._is_scratch:
            raise ValueError("only a scratch store can be cleared")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
