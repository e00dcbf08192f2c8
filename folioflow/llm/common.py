"""What the operators of this subpackage share: reading tables, the shared folder, text primitives."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of 8-byte ids that may be broadcast after they have been counted (about 8 MB).
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor and the driver see.

    Only a session on this machine alone (a local master) may do without the setting; a temporary folder serves
    it. On a cluster each executor would write such a folder to its own disk, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioflow-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store holds it."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


#: Tables that a result still reads.
Kept = list[tuple[SparkSession, str]]
_SESSION: Kept = []
_OWNER: ContextVar[Kept] = ContextVar("owner", default=_SESSION)


@contextmanager
def owned() -> Iterator[Kept]:
    """The tables kept within this block, in this thread, are its own: whoever has the list deletes them (``drop_tables``)
    or gives them to the block around it (``keep``). They are deleted if the block fails."""
    tables: Kept = []
    before = _OWNER.set(tables)
    try:
        yield tables
    except BaseException:
        drop_tables(tables)
        raise
    finally:
        _OWNER.reset(before)


class Scratch:
    """The tables that one run writes on its way, in one folder of the shared one; each is deleted when it is no longer read.

    ``with Scratch(spark, "tag") as scratch:`` deletes at the end what ``cut`` wrote, but for tables written with
    ``keep=True``, which the run's result still reads: those are part of the result and belong to the ``owned`` block around
    the run, or to the session, where ``drop_kept`` deletes them.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path, self.passing = spark, shared_dir(spark, tag), []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def folder(self, tag: str, keep: bool = False) -> str:
        path = f"{self.path}/{tag}-{uuid.uuid4().hex[:12]}"
        if keep:
            _OWNER.get().append((self.spark, path))
        else:
            self.passing.append(path)
        return path

    def cut(self, df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
        """Writes ``df`` to the shared folder and reads it back: lineage ends there and survives lost executors."""
        path = self.folder(tag, keep)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.passing:
            drop_dir(self.spark, path)
        self.passing = []


def drop_tables(tables: Kept) -> None:
    while tables:
        drop_dir(*tables.pop())


def keep(tables: Kept) -> None:
    _OWNER.get().extend(tables)


def drop_kept() -> None:
    """Deletes the tables that results of this session read and no ``owned`` block holds; call it when those results have been written."""
    drop_tables(_SESSION)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else (``lower`` would also change other alphabets)."""
    return F.translate(text, UPPER, UPPER.lower())


def space_words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(spaced, " "), "")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` doesn't have, one for each stem."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names
