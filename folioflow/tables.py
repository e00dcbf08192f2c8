"""Tables that a run writes on its way, owned by one object, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a session on this machine alone may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioflow-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get()
    return f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


class Tables:
    """Named Parquet tables of one run. A table is there when its write was committed, so what a lost driver left half written is written again.

    What reads a table must be done before it is dropped; ``close`` deletes the folder.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, tag: str = "run"):
        self.spark, self.folder = spark, (folder or shared_folder(spark, tag)).rstrip("/")

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _store(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def has(self, name: str) -> bool:
        store, path = self._store(f"{name}/_SUCCESS")
        return store.exists(path)

    def names(self, under: str = "") -> list[str]:
        """The committed tables directly below a folder."""
        store, path = self._store(under)
        found = [f.getPath().getName() for f in store.listStatus(path) if f.isDirectory()] if store.exists(path) else []
        at = f"{under}/" if under else ""
        return sorted(f"{at}{n}" for n in found if self.has(f"{at}{n}"))

    def read(self, name: str | list[str], schema=None) -> DataFrame:
        """A table, or several of one schema as one; no table at all is an empty one."""
        names = [name] if isinstance(name, str) else name
        if not names:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*(f"{self.folder}/{n}" for n in names))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.read(name, df.schema)

    def observed(self, df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
        """As ``write``, with aggregates that the write itself observes, so no other job reads the table for them."""
        told = Observation(uuid.uuid4().hex)
        df.observe(told, *(c.alias(k) for k, c in metrics.items())).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.read(name, df.schema), told.get

    def counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """As ``write``, with the number of rows."""
        made, told = self.observed(df, name, n=F.count(F.lit(1)))
        return made, told["n"]

    def drop(self, *names: str) -> None:
        for name in names:
            store, path = self._store(name)
            store.delete(path, True)

    def close(self) -> None:
        self.drop("")


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer parts than there are cores (one file of one row group) dealt out to all of them; one of more parts stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
