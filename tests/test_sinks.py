"""The sink for rows that are files: committed whole, or nothing of them."""

import pytest
from pyspark.sql import functions as F

from folioflow.sinks.files import FileWriter, below, save_files, store_of

SCHEMA = "path string, content binary"


def files_of(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_files_in_folders_by_a_uri(spark, tmp_path):
    made = spark.range(50, numPartitions=5).select(F.concat(F.lit("d/"), F.col("id") % 3, F.lit("/é "), "id", F.lit(".bin")).alias("name"), F.lit("x").alias("path"), F.encode(F.repeat(F.lit("b"), F.col("id").cast("int")), "utf-8").alias("content"))
    save_files(made, f"file://{tmp_path}/out", path_col="name")
    assert files_of(tmp_path / "out") == {f"d/{i % 3}/é {i}.bin": b"b" * i for i in range(50)}
    save_files(made.limit(0), f"{tmp_path}/none")
    assert not list((tmp_path).glob("none/*"))


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    (tmp_path / "kept").write_bytes(b"old")
    late = F.when(F.col("id") == 39, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.encode(F.col("id").cast("string"), "utf-8"))
    rows = spark.range(40, numPartitions=4)
    with pytest.raises(Exception, match="lost"):
        save_files(rows.select(F.col("id").cast("string").alias("path"), late.alias("content")), str(tmp_path))
    for path, content in ((None, b"a"), ("a", None), ("../a", b"a"), ("/a", b"a"), ("a/../..", b"a"), ("", b"a")):
        with pytest.raises(Exception, match="path|content"):
            save_files(spark.createDataFrame([("ok", b"ok"), (path, content)], SCHEMA), str(tmp_path))
    assert files_of(tmp_path) == {"kept": b"old"} and [p.name for p in tmp_path.iterdir()] == ["kept"]


def test_files_that_are_there(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", b"1"), ("a.txt", b"1"), ("b/c", b"2")], SCHEMA)
    save_files(rows, str(tmp_path))
    assert files_of(tmp_path) == {"a.txt": b"1", "b/c": b"2"}
    save_files(spark.createDataFrame([("a.txt", b"3")], SCHEMA), str(tmp_path))
    assert files_of(tmp_path)["a.txt"] == b"3"
    save_files(rows, str(tmp_path), overwrite=False)
    assert sorted(files_of(tmp_path).values()) == [b"1", b"1", b"2", b"2", b"3"] and files_of(tmp_path)["a.txt"] == b"3"


def test_an_attempt_that_is_not_counted_leaves_nothing(spark, tmp_path):
    import pyarrow as pa

    writer = FileWriter(f"file:{tmp_path}", True, "job")
    writer.begin()
    batch = lambda v: pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([v], pa.binary())], ["path", "content"])
    writer.write(iter([batch(b"lost")]))
    writer.commit([writer.write(iter([batch(b"counted")])), None])
    assert files_of(tmp_path) == {"x": b"counted"} and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(RuntimeError, match="over"):
        writer.write(iter([batch(b"late")]))
    assert len(list(tmp_path.iterdir())) == 1
    assert store_of("file:///a b/c")[1] == "/a b/c" and below("a/./b") == "a/b"
