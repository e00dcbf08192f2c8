"""Training-order materialisation: a keyed permutation gives each sequence its slot, ranges of slots become fixed-stride shards.

1. The documents of a partition, each with ``END`` behind it, are packed into sequences of ``LENGTH`` byte-level
   token ids (UTF-8 bytes; ``END`` and ``PAD`` are bytes that UTF-8 never uses). Sequences are numbered by
   the partitions' counts, without a sort.
2. A keyed Feistel network over the next power of four, walked until it falls below the number of
   sequences, sends each number to its slot: one to one, with no table, wherever it is computed.
3. A shard holds ``per_shard`` slots in a row and is one file of equal records, written by Spark's own writer,
   so record s of a shard starts at byte s * ``STRIDE`` and a reader can begin at any slot.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, table

LENGTH = 511
#: Each record ends with a line feed, which shows a reader that it stands right.
STRIDE = LENGTH + 1
END, PAD = 0xFF, 0xFE
PER_SHARD = 65_536
ROUNDS, KEY = 6, 0x5DEECE66D


class Permutation:
    """A keyed one-to-one map of 0 .. n-1 to itself."""

    def __init__(self, n: int, key: int = KEY):
        self.n = n
        self.half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.Generator(np.random.PCG64(key)).integers(0, 2**63, ROUNDS, np.uint64)

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._mixed(left, key), left
            else:
                left, right = right, left ^ self._mixed(right, key)
        return left << self.half | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), back)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        """Which sequence lies in a slot."""
        return self._walk(slots, True)


class _Packer:
    """Cuts a stream of texts, each with ``END`` behind it, into sequences; only the last one needs ``PAD``."""

    def __init__(self):
        self.held = bytearray()

    def add(self, texts: Iterator[bytes | None]) -> list[bytes]:
        for text in texts:
            self.held += text or b""
            self.held.append(END)
        whole = len(self.held) // LENGTH * LENGTH
        cut, self.held = bytes(self.held[:whole]), self.held[whole:]
        return [cut[at : at + LENGTH] for at in range(0, whole, LENGTH)]

    def last(self) -> list[bytes]:
        return [bytes(self.held).ljust(LENGTH, bytes([PAD]))] if self.held else []


def plan(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """``n + 1`` numbers for ``n`` partitions of ``docs``: the first sequence of each, then how many there are. One row per partition comes to the driver."""
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + 1
    rows = docs.select(F.spark_partition_id().alias("p"), size.alias("n")).groupBy("p").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.p for r in rows), default=-1) + 2, np.int64)
    for r in rows:
        counts[r.p + 1] = -(-r.n // LENGTH)
    return np.cumsum(counts)


def materialise(docs: DataFrame, path: str, text_col: str = "text", key: int = KEY, per_shard: int = PER_SHARD) -> int:
    """Writes the shards below ``path`` and returns the number of sequences.

    ``docs`` must give the same partitions whenever it is read, as files do; a partition that comes out
    otherwise than it was counted stops the job, so no slot is filled twice or left. A null or empty text
    only ends; a very long one runs over as many sequences as it needs. Repeated rows are packed as often as they
    come. Other columns aren't read. An empty table writes nothing.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    firsts = plan(texts, "text")
    total = int(firsts[-1])
    if not total:
        return 0
    order = Permutation(total, key)
    shards = -(-total // per_shard)
    sent = docs.sparkSession.sparkContext.broadcast(firsts)  # 8 bytes a partition, once an executor; no task's closure holds them

    def run(batches: Iterator[pa.RecordBatch]):
        p, packer = TaskContext.get().partitionId(), _Packer()
        number, end = (int(sent.value[min(k, len(sent.value) - 1)]) for k in (p, p + 1))
        for bodies in itertools.chain((packer.add(x.as_py() for x in batch.column(0).cast(pa.large_binary())) for batch in batches), (packer.last() for _ in range(1))):
            if number + len(bodies) > end:  # a number outside the permutation has no slot
                raise RuntimeError(f"partition {p} goes on to sequence {number + len(bodies)}, it was counted to end at sequence {end}")
            slots = order.slots(np.arange(number, number + len(bodies))) if bodies else np.empty(0, np.int64)
            number += len(bodies)
            for at in range(0, len(bodies), 8192):
                part = slots[at : at + 8192]
                yield pa.RecordBatch.from_arrays([pa.array((part // per_shard).astype(np.int32)), pa.array(part), pa.array(bodies[at : at + 8192], pa.binary())], ["shard", "slot", "value"])
        if number != end:
            raise RuntimeError(f"partition {p} ends at sequence {number}, it was counted to end at sequence {end}")

    rows = texts.mapInArrow(run, "shard int, slot long, value binary")
    dealt = rows.repartitionById(shards, F.col("shard")) if hasattr(rows, "repartitionById") else rows.repartition(shards, "shard")
    dealt.sortWithinPartitions("shard", "slot").select("shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)
    return total


def read_shards(spark: SparkSession, path: str, first_slot: int = 0, per_shard: int = PER_SHARD) -> DataFrame:
    """``slot``, ``shard``, ``byte_offset``, ``n_tokens`` (``END`` included), ``crc``, ``tokens`` of all records from ``first_slot`` on.

    Shards are partitions of the folder, so earlier ones aren't opened; of the shard that holds ``first_slot`` only the records from there on are read out.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                records = np.frombuffer(data.as_py(), np.uint8)
                if len(records) % STRIDE or (records[LENGTH::STRIDE] != 10).any():
                    raise ValueError(f"shard {shard} isn't made of whole records")
                records = records.reshape(-1, STRIDE)[:, :LENGTH]
                for at in range(max(0, first_slot - shard * per_shard), len(records), 4096):
                    part = records[at : at + 4096]
                    here = np.arange(at, at + len(part))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(here + shard * per_shard), pa.array(np.full(len(part), shard, np.int32)), pa.array(here * STRIDE), pa.array((part != PAD).sum(axis=1)), pa.array([zlib.crc32(x) for x in part], pa.int64()), pa.array([x.tobytes() for x in part], pa.binary())],
                        ["slot", "shard", "byte_offset", "n_tokens", "crc", "tokens"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.filter(F.col("shard") >= first_slot // per_shard).select(F.col("shard").cast("int"), "content")
    return files.mapInArrow(run, "slot long, shard int, byte_offset long, n_tokens long, crc long, tokens binary")


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "training").folder("shards", keep=True)
    schema = "slot long, shard int, byte_offset long, n_tokens long, crc long"
    if not materialise(table(spark, sf_dir, "documents").select("text"), path):
        return spark.createDataFrame([], schema)
    return read_shards(spark, path).drop("tokens")
