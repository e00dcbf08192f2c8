"""A sink for rows that are files: a Python data source whose writer commits all of a job's files or none."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "folioflow_files"
#: Files that the commit moves at once, where a store answers slowly.
MOVES = 16
#: A job's folder holds this file for as long as the job goes on.
MARK = "open"


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme, as Spark reads it: a path without one is in the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path, and the path there."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def below(path: str | None) -> str:
    """A path within the folder; one that leads out of it, or none, is an error, since names come from the data."""
    if path is None:
        raise ValueError("a file needs a path")
    clean = posixpath.normpath(path)
    if clean.startswith("/") or clean in ("", ".", "..") or clean.startswith("../"):
        raise ValueError(f"not a path below the folder: {path!r}")
    return clean


@dataclass
class Part(WriterCommitMessage):
    """A task's files: the folder they wait in, with their paths in ``paths`` there, so that no list of names grows in the driver."""

    folder: str


class FileWriter(DataSourceArrowWriter):
    """Tasks write to a folder of the job's own beside the results; the commit moves what the counted attempts wrote and deletes the
    folder with what other attempts left in it; an abort deletes it all. An attempt that outlives its job sees that the job's mark is
    gone and takes its files away itself. A driver that is lost within the commit leaves whole files only, and writing again completes them."""

    def __init__(self, folder: str, overwrite: bool, job: str):
        self.folder, self.overwrite, self.job = folder, overwrite, job

    def _waiting(self) -> tuple[fs.FileSystem, str, str]:
        store, root = store_of(self.folder)
        return store, root, f"{root}/.waiting-{self.job}"

    def begin(self) -> None:
        """Called by the driver before the tasks start."""
        store, _, waiting = self._waiting()
        store.create_dir(waiting, recursive=True)
        store.open_output_stream(f"{waiting}/{MARK}").close()

    def end(self) -> None:
        store, _, waiting = self._waiting()
        if store.get_file_info(waiting).type == fs.FileType.Directory:
            store.delete_dir(waiting)

    def _check(self) -> None:
        store, _, waiting = self._waiting()
        if store.get_file_info(f"{waiting}/{MARK}").type == fs.FileType.NotFound:
            self.end()
            raise RuntimeError("the job is over")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        try:
            return self._written(iterator)
        finally:
            self._check()

    def _written(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        self._check()
        store, _, waiting = self._waiting()
        part, paths = f"{waiting}/{uuid.uuid4().hex}", []
        store.create_dir(part, recursive=True)
        for batch in iterator:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                paths.append(below(path.as_py()))
                if not content.is_valid:
                    raise ValueError(f"no content: {paths[-1]!r}")
                with store.open_output_stream(f"{part}/{len(paths) - 1}") as out:
                    out.write(content.as_buffer())
        with store.open_output_stream(f"{part}/paths") as out:
            out.write(json.dumps(paths).encode())
        return Part(part)

    def commit(self, messages: list[Part | None]) -> None:
        store, root, _ = self._waiting()
        stamp = f"{datetime.now(UTC):%Y%m%d_%H%M%S}"

        def place(source: str, path: str) -> None:
            target = f"{root}/{path}"
            stem, suffix = posixpath.splitext(target)
            n = 0
            while not self.overwrite and store.get_file_info(target).type != fs.FileType.NotFound:
                target, n = f"{stem}_{stamp}{f'_{n}' if n else ''}{suffix}", n + 1
            store.create_dir(posixpath.dirname(target), recursive=True)
            store.move(source, target)

        with ThreadPoolExecutor(MOVES if self.overwrite else 1) as pool:  # names are free or not only one after another
            for part in filter(None, messages):
                with store.open_input_stream(f"{part.folder}/paths") as held:
                    paths = json.loads(held.read())
                list(pool.map(place, (f"{part.folder}/{n}" for n in range(len(paths))), paths))
        self.end()

    def abort(self, messages: list[Part | None]) -> None:
        self.end()


class FileTree(DataSource):
    """The sink of ``save_files``, for rows (path, content)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["folder"], self.options["replace"] == "true", self.options["job"])


def save_files(files: DataFrame, folder: str, path_col: str = "path", overwrite: bool = True) -> None:
    """Each row's ``content`` as a file below ``folder``, which is in any store that Spark and pyarrow both read. If a task fails for good, none is there.

    With ``overwrite=False`` a file that is there stays, and the new one has the time in its name. Of several rows with one
    path one stays with ``overwrite``, else all. A null path or content, or a path out of the folder, fails the job.
    """
    spark = files.sparkSession
    spark.dataSource.register(FileTree)
    rows = files.select(F.col(path_col).cast("string").alias("path"), F.col("content").cast("binary").alias("content"))
    writer = FileWriter(qualified(spark, folder), overwrite, uuid.uuid4().hex)
    writer.begin()
    try:
        rows.write.format(FORMAT).option("folder", writer.folder).option("replace", str(overwrite).lower()).option("job", writer.job).mode("append").save()
    finally:
        writer.end()
