"""Hard negatives by a block matrix product in two dimensions: rows in shards, components in chunks, partial scores added by a shuffle.

1. Vectors become whole numbers. Anchors are dealt into panels and all rows into shards of bounded size; each is written as
   a block for every chunk of components.
2. A grid of cells holds chunk by panels by shards. Panels are copied along one side of the grid and shards along the
   other, so a cell's task has both operands of its tiles and multiplies them.
3. Partial tiles of whole numbers meet by (panel, shard) in a shuffle and are added over the chunks. A tile holds only the
   pairs that are asked for, label by label, and travels in the fewest bytes that hold its numbers.
4. An added tile gives at most k rows for each anchor (positives) or for each window of an anchor and a positive (negatives); a
   window function keeps the best of all tiles.

Positives are the first pass, over pairs of one label; negatives the second, over pairs of different labels, with the windows that the
positives opened. Both see every pair: the work is anchors x rows, as the queries are. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm.common import Scratch, table
from folioflow.llm.topk import floored, products, usable

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: A negative scores from ``LOW`` to ``HIGH`` parts of ``WHOLE`` of the positive's score.
LOW, HIGH, WHOLE = 50, 95, 100
_LIMIT = 2**58
BLOCK = "dim int, block long, chunk int, labels binary, ids binary, part binary"
TILE = "dim int, panel long, shard long, chunk int, tile binary, a_ids binary, a_labels binary, b_ids binary, b_labels binary, windows binary"
FOUND = "dim int, panel long, row int, anchor_id long, vec_id long, score long"
MINED = "dim int, panel long, row int, turn int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


@dataclass(frozen=True)
class Grid:
    """Rows of a panel of anchors and of a shard, components of a chunk, chunks at most (longer vectors have wider ones), and
    cells along each side of the grid at most: so often is an operand copied."""

    panel: int = 512
    shard: int = 2048
    chunk: int = 32
    chunks: int = 16
    lanes: int = 32

    def width(self, dim: int) -> int:
        return max(self.chunk, -(-dim // self.chunks))


_WINDOWS = np.dtype([("row", "<i4"), ("turn", "<i4"), ("id", "<i8"), ("score", "<i8")])


def numbered(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label``, ``v`` (floor(scale * x) as doubles), and ``turn``, a hash by which rows are dealt, whatever ids and vectors repeat."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("raw"))
    whole = F.transform("raw", lambda x: floored(x * F.lit(float(scale))))
    there = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("raw")))
    return there.select("vec_id", "label", whole.alias("v"), F.xxhash64("vec_id", F.monotonically_increasing_id()).alias("turn"))


def blocks_of(rows: DataFrame, blocks: int, grid: Grid) -> DataFrame:
    """``BLOCK``: rows of one length dealt into ``blocks``, a row for each chunk of their components; ids stand with the first chunk."""

    def cut(held: pa.Table) -> pa.Table:
        held = held.sort_by([("label", "ascending"), ("vec_id", "ascending"), ("turn", "ascending")]).combine_chunks()
        column = lambda name: held.column(name).to_numpy()
        dim, n = held.column("dim")[0].as_py(), held.num_rows
        x = held.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
        kind = "<i4" if not x.size or np.abs(x).max() < 2**31 else "<f8"
        width = grid.width(dim)
        labels, ids = (column(c).astype("<i8").tobytes() for c in ("label", "vec_id"))
        made = [(dim, column("block")[0], k, labels, ids if k == 0 else None, x[:, at : at + width].astype(kind).tobytes()) for k, at in enumerate(range(0, max(dim, 1), width))]
        types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in made], t) for i, t in enumerate(types)], names=[c.split()[0] for c in BLOCK.split(", ")])

    dealt = rows.select("vec_id", "label", "v", "turn", F.size("v").alias("dim"), F.pmod("turn", F.lit(blocks)).alias("block"))
    return dealt.groupBy("dim", "block").applyInArrow(cut, BLOCK)


def pairs(a_labels: np.ndarray, b_labels: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of a tile that are asked for, label by label of the anchors: equal labels or different ones."""
    for label in np.unique(a_labels):
        if len(cols := np.flatnonzero((b_labels == label) == same)):
            yield np.flatnonzero(a_labels == label), cols


def packed(tile: np.ndarray) -> bytes:
    """Whole numbers with the sign as the last bit, in the fewest bytes of 1, 2, 4 or 8 that hold them all, the width first.

    All lowest bytes come first, then the next ones: a tile's few large numbers leave runs of zeros that the shuffle packs away.
    """
    folded = ((tile << 1) ^ (tile >> 63)).astype(np.uint64)
    most = int(folded.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + folded.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    folded = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64)
    return (folded >> np.uint64(1)).astype(np.int64) ^ -(folded & np.uint64(1)).astype(np.int64)


def tiles(anchors: DataFrame, rows: DataFrame, panels: int, shards: int, same: bool, grid: Grid) -> DataFrame:
    """``TILE``: the partial scores of each pair of a panel and a shard in each chunk; ids and windows go with the first chunk."""
    across, along = min(panels, grid.lanes), min(shards, grid.lanes)
    windows = F.col("windows") if "windows" in anchors.columns else F.lit(None).cast("binary")
    lanes = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    side = lambda df, kind, *more: df.select("dim", "chunk", F.col("block").alias(kind), *(F.col(c).alias(f"{kind}_{c}") for c in ("labels", "ids", "part")), *more)
    left = side(anchors, "panel", windows.alias("windows")).withColumn("across", F.pmod("panel", F.lit(across)).cast("int")).withColumn("along", lanes(along))
    right = side(rows, "shard").withColumn("along", F.pmod("shard", F.lit(along)).cast("int")).withColumn("across", lanes(across))
    met = left.hint("merge").join(right, ["dim", "chunk", "across", "along"])

    def multiply(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                a_labels, b_labels = (np.frombuffer(r[c], "<i8") for c in ("panel_labels", "shard_labels"))
                width = min(grid.width(r["dim"]), r["dim"] - r["chunk"] * grid.width(r["dim"]))
                a, b = (_matrix(r[f"{c}_part"], n, width) for c, n in (("panel", len(a_labels)), ("shard", len(b_labels))))
                found = [products(a[x], b[y]).ravel() for x, y in pairs(a_labels, b_labels, same)]
                if not found:
                    continue
                first = r["chunk"] == 0
                made = {"dim": r["dim"], "panel": r["panel"], "shard": r["shard"], "chunk": r["chunk"], "tile": packed(np.clip(np.concatenate(found), -_LIMIT, _LIMIT))}
                made |= {f"{x}_{c}": r[f"{y}_{c}"] if first else None for x, y in (("a", "panel"), ("b", "shard")) for c in ("ids", "labels")} | {"windows": r["windows"] if first else None}
                yield pa.RecordBatch.from_pylist([made], _TILE)

    return met.select("dim", "panel", "shard", "chunk", "panel_labels", "panel_part", "panel_ids", "shard_labels", "shard_part", "shard_ids", "windows").mapInArrow(multiply, TILE)


def _matrix(part: bytes, n: int, width: int) -> np.ndarray:
    """A chunk of ``n`` rows; its length tells whether its numbers take 4 bytes or 8."""
    return np.frombuffer(part, "<i4" if len(part) == 4 * n * width else "<f8").reshape(n, width).astype(np.float64)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_schema = lambda ddl: pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in ddl.split(", "))])
_TILE, _FOUND, _MINED = (_schema(x) for x in (TILE, FOUND, MINED))


def _added(held: pa.Table, same: bool) -> tuple[dict, np.ndarray, np.ndarray, Iterator]:
    """The first chunk's row, ids of both sides, and (rows, columns, scores) of each label's part of the tile, added over its chunks."""
    first = next(held.slice(i, 1).to_pylist()[0] for i, c in enumerate(held.column("chunk").to_pylist()) if c == 0)
    total = np.zeros(0, np.int64)
    for data in held.column("tile"):
        some = unpacked(data.as_py())
        total = some if not len(total) else total + some
    a_ids, a_labels, b_ids, b_labels = (np.frombuffer(first[c], "<i8") for c in ("a_ids", "a_labels", "b_ids", "b_labels"))

    def parts():
        at = 0
        for x, y in pairs(a_labels, b_labels, same):
            yield x, y, total[at : at + len(x) * len(y)].reshape(len(x), len(y))
            at += len(x) * len(y)

    return first, a_ids, b_ids, parts()


def best_of(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` highest ``allowed`` scores of each row, ties to the smaller id."""
    held = np.where(allowed, scores, -(2**63))
    least = np.partition(held, -k, axis=1)[:, -k] if held.shape[1] > k else np.full(len(held), -(2**63))
    r, c = np.nonzero(allowed & (held >= least[:, None]))
    order = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, np.arange(len(scores)))
    keep = np.arange(len(r)) - first[r] < k
    return r[keep], c[keep]


def positives(tile_rows: DataFrame, k: int = POSITIVES) -> DataFrame:
    """``FOUND`` and ``turn`` (from 1): the ``k`` best rows of an anchor's label, its own id left out."""

    def reduce(held: pa.Table) -> pa.Table:
        head, a_ids, b_ids, parts = _added(held, True)
        out = []
        for x, y, scores in parts:
            r, c = best_of(scores, b_ids[y], a_ids[x][:, None] != b_ids[y][None, :], k)
            out.append((x[r], a_ids[x[r]], b_ids[y[c]], scores[r, c]))
        rows, anchor, other, score = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.table([np.full(len(rows), head["dim"]), np.full(len(rows), head["panel"]), rows, anchor, other, score], names=_FOUND.names).cast(_FOUND)

    best = F.row_number().over(Window.partitionBy("dim", "panel", "row").orderBy(F.desc("score"), "vec_id"))
    return tile_rows.groupBy("dim", "panel", "shard").applyInArrow(reduce, FOUND).withColumn("turn", best).filter(F.col("turn") <= k)


def negatives(tile_rows: DataFrame, k: int = NEGATIVES, low: int = LOW, high: int = HIGH, whole: int = WHOLE) -> DataFrame:
    """``MINED`` and ``rank`` (from 1): for each anchor and positive the ``k`` best rows of other labels within the window of scores."""

    def reduce(held: pa.Table) -> pa.Table:
        head, a_ids, b_ids, parts = _added(held, False)
        opened = np.frombuffer(head["windows"], _WINDOWS)
        opened = opened[np.argsort(opened["row"], kind="stable")]
        least, most = (np.array([f(int(s)) for s in opened["score"]], np.int64) for f in (lambda s: -(-low * s // whole), lambda s: high * s // whole))
        begin = np.searchsorted(opened["row"], np.arange(len(a_ids) + 1))
        lowest, highest = np.full(len(a_ids), 2**63 - 1), np.full(len(a_ids), -(2**63))
        np.minimum.at(lowest, opened["row"], least)
        np.maximum.at(highest, opened["row"], most)
        out = []
        for x, y, scores in parts:
            r, c = np.nonzero((scores >= lowest[x][:, None]) & (scores <= highest[x][:, None]))
            s = scores[r, c]
            order = np.lexsort((b_ids[y[c]], -s, r))
            r, c, s = r[order], c[order], -s[order]  # from here on scores are negated, so they rise
            edge = np.searchsorted(r, np.arange(len(x) + 1))
            for i in np.flatnonzero(np.diff(edge)):
                some = s[edge[i] : edge[i + 1]]
                for w in range(begin[x[i]], begin[x[i] + 1]):
                    at = np.searchsorted(some, -most[w])
                    out += [(x[i], w, b_ids[y[c[edge[i] + j]]], -some[j]) for j in range(at, min(at + k, len(some))) if -some[j] >= least[w]]
        n = len(out)
        row, w, other, score = (np.array(z, np.int64) for z in zip(*out, strict=True)) if n else (np.zeros(0, np.int64),) * 4
        made = [np.full(n, head["dim"]), np.full(n, head["panel"]), row, opened["turn"][w], a_ids[row], opened["id"][w], opened["score"][w], other, score]
        return pa.table(made, names=_MINED.names).cast(_MINED)

    best = F.row_number().over(Window.partitionBy("dim", "panel", "row", "turn").orderBy(F.desc("negative_score"), "negative_id"))
    return tile_rows.groupBy("dim", "panel", "shard").applyInArrow(reduce, MINED).withColumn("rank", best).filter(F.col("rank") <= k)


def opened(found: DataFrame) -> DataFrame:
    """``windows``: an anchor panel's positives in one value, at most a panel's rows times ``k_positives``."""

    def join(held: pa.Table) -> pa.Table:
        held = held.sort_by([("row", "ascending"), ("turn", "ascending")])
        made = np.zeros(held.num_rows, _WINDOWS)
        for name, column in (("row", "row"), ("turn", "turn"), ("id", "vec_id"), ("score", "score")):
            made[name] = held.column(column).to_numpy()
        return pa.table([pa.array([held.column("dim")[0].as_py()], pa.int32()), pa.array([held.column("panel")[0].as_py()], pa.int64()), pa.array([made.tobytes()], pa.binary())], names=["dim", "block", "windows"])

    return found.select("dim", "panel", "row", "turn", "vec_id", "score").groupBy("dim", "panel").applyInArrow(join, "dim int, block long, windows binary")


def mine(vectors: DataFrame, anchors: Column, label: Column, k_positives: int = POSITIVES, k: int = NEGATIVES, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, grid: Grid = Grid()) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``anchors`` (over ``vec_id``) tells the anchors, ``label`` is a column of ``vectors``. Null ids, labels and vectors, and vectors with a
    null or non-finite component take no part; vectors of another length than the anchor's are neither its positives nor
    its negatives. Rows with the anchor's id aren't its positives. Repeated anchor rows are anchors each, repeated rows candidates each;
    equal scores go by the smaller id. Fewer candidates give fewer rows, anchors without positives none, an empty table none. A
    positive with a score below zero has an empty window. Scores are exact while a chunk's stay within 2**58, beyond
    that they are held to it (with 16 chunks at most, sums stay within the longs). Other columns aren't read.
    """
    spark = vectors.sparkSession
    with Scratch(spark, "negatives") as scratch:
        rows = scratch.cut(numbered(vectors, id_col, vector_col, label, scale), "rows")
        n, asked = rows.agg(F.count(F.lit(1)), F.count_if(anchors)).first()
        panels, shards = max(1, -(-asked // grid.panel)), max(1, -(-n // grid.shard))
        left, right = (scratch.cut(blocks_of(x, count, grid), "blocks") for x, count in ((rows.filter(anchors), panels), (rows, shards)))
        found = scratch.cut(positives(tiles(left, right, panels, shards, True, grid), k_positives), "positives")
        mined = negatives(tiles(left.join(opened(found), ["dim", "block"]), right, panels, shards, False, grid), k)
        return scratch.cut(mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "mined", keep=True)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(rows, F.col("vec_id") % EVERY == 0, label)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE alike
), n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score WHERE p.k <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
