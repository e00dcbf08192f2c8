"""Exact top-k search by inner product, a block at a time: bounds first, then forward indexes until no bound is left.

Vectors become whole numbers. Centres from a bounded sample (``SAMPLE``) tell which vectors are alike; every partition sorts
its rows by nearest centre and cuts them into blocks that hold the largest and smallest value per dimension,
a centre and a radius, the ids and the forward index. Queries are taken in groups of bounded size; a
group is sent to all tasks, each of which orders its blocks by the bound (the summed maxima, or the ball's where
that is lower): the first ones per query, the rest in one order with one product for all queries whose k-th score
held doesn't pass the block's bound. Tasks return k rows per query, and a window keeps the best k. Bounds only pass over blocks that can't
hold a result: no vector is left out whatever the centres are, and no pair is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm.common import Scratch, table

K, SCALE, EVERY = 10, 1024, 100
BLOCK = 128
#: Blocks that each query takes in its own order before blocks are taken for all queries together.
FIRST = 2
#: Vectors that the centres are made from, the most centres, and vectors for each centre at least.
SAMPLE, CENTRES, PER_CENTRE, ROUNDS = 8192, 256, 24, 6
#: Bytes of the queries of a group, which bounds what is sent to each task (65,536 queries of 64 numbers), and queries that are bounded at once.
GROUP_BYTES, AT_ONCE = 32 << 20, 1024
_EXACT = float(2**53)
_LONG = 2**63 - 1


def usable(vector: Column) -> Column:
    """True where the vector is there and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False)))


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v``, floor(scale * x) as doubles (exact, as doubles hold them); rows without an id or with an unusable vector take no part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("raw"))
    return rows.filter(F.col("vec_id").isNotNull() & usable(F.col("raw"))).select("vec_id", F.transform("raw", lambda x: floored(x * F.lit(float(scale)))).alias("v"))


def floored(x: Column) -> Column:
    """As ``floor``, but a double beyond the longs stays itself (it has no fraction)."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def centres_of(numbers: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Centres of the ``sample`` vectors with the smallest hashes (of their most common length), by k-means; they only tell which vectors are stored together."""
    rows = numbers.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    lengths = [len(r.v) for r in rows]
    if not lengths or not (dim := max(set(lengths), key=lengths.count)):
        return np.empty((0, 0))
    x = np.array([r.v for r in rows if len(r.v) == dim])
    scale = max(np.abs(x).max(), 1.0)
    x /= scale
    centres = x[:: max(PER_CENTRE, -(-len(x) // CENTRES))].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres * scale


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    scale = max(np.abs(centres).max(initial=0), np.abs(x).max(initial=0), 1.0)
    x, centres = x / scale, centres / scale
    return ((centres**2).sum(axis=1) / 2 - x @ centres.T).argmin(axis=1)


def _matrices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The lists of a column by length: places of the rows, and their numbers."""
    held = batch.column(at)
    starts = held.offsets.to_numpy().astype(np.int64)
    lengths, flat = np.diff(starts), held.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield rows, flat[starts[rows][:, None] + np.arange(dim)] if dim else np.empty((len(rows), 0))


def blocks_of(numbers: DataFrame, centres: np.ndarray, size: int = BLOCK) -> DataFrame:
    """A row per block: ``dim``, ``n``, ``ids``, ``forward`` (n x dim), ``high``, ``low`` and ``centre`` (dim), as binaries, and ``radius``."""
    sent = numbers.sparkSession.sparkContext.broadcast(centres)

    def placed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            like = np.full(batch.num_rows, -1, np.int32)
            for rows, m in _matrices(batch, 1):
                if len(sent.value) and m.shape[1] == sent.value.shape[1]:
                    like[rows] = _nearest(m, sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(like)], ["vec_id", "v", "like"])

    def block(ids: np.ndarray, x: np.ndarray) -> dict:
        kind = "<i4" if not x.size or np.abs(x).max() < 2**31 else "<f8"
        centre = (x.max(axis=0) + x.min(axis=0)) / 2 if len(sent.value) == 0 else x.mean(axis=0)
        with np.errstate(over="ignore", invalid="ignore"):  # a radius beyond the doubles bounds nothing
            radius = float(np.nan_to_num(np.sqrt(((x - centre) ** 2).sum(axis=1)).max(), nan=np.inf))
        parts = {"high": x.max(axis=0), "low": x.min(axis=0), "centre": centre}
        return {"dim": x.shape[1], "n": len(x), "ids": ids.astype("<i8").tobytes(), "forward": x.astype(kind).tobytes(), "radius": radius} | {k: v.astype("<f8").tobytes() for k, v in parts.items()}

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[int, tuple] = {}  # for each length the block that is being filled, and its centre
        for batch in batches:
            ids, like = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            made = []
            for rows, m in _matrices(batch, 1):
                dim, at = m.shape[1], 0
                for stop in [*(np.flatnonzero(np.diff(like[rows])) + 1), len(rows)]:
                    while at < stop:
                        own = like[rows[at]]
                        if dim in held and held[dim][0] != own and 4 * len(held[dim][1]) >= size:  # a few rows of a centre alone make no block
                            made.append(block(*held.pop(dim)[1:]))
                        _, old_ids, old = held.pop(dim, (own, np.empty(0, np.int64), np.empty((0, dim))))
                        end = min(stop, at + size - len(old))
                        held[dim] = own, np.concatenate([old_ids, ids[rows[at:end]]]), np.concatenate([old, m[at:end]])
                        at = end
                        if len(held[dim][1]) == size:
                            made.append(block(*held.pop(dim)[1:]))
            if made:
                yield pa.RecordBatch.from_pylist(made, _SCHEMA)
        if held:
            yield pa.RecordBatch.from_pylist([block(*x[1:]) for x in held.values()], _SCHEMA)

    sorted_rows = numbers.mapInArrow(placed, "vec_id long, v array<double>, like int").sortWithinPartitions("like", "vec_id")
    return sorted_rows.mapInArrow(run, "dim int, n int, ids binary, forward binary, high binary, low binary, centre binary, radius double")


_SCHEMA = pa.schema([("dim", pa.int32()), ("n", pa.int32()), *((x, pa.binary()) for x in ("ids", "forward", "high", "low", "centre")), ("radius", pa.float64())])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; in doubles where they are exact, else in whole numbers held to the range of a long."""
    if not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < _EXACT:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object)
    return np.clip(whole(q) @ whole(x).T, -_LONG - 1, _LONG).astype(np.int64)


class Best:
    """The k best of each query of a group, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.kth = k, np.full(n, -(2**63), np.int64)
        self.q, self.ids, self.scores = (np.empty(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``q``: the queries; ``scores``: a row for each of them, a column for each of ``ids``."""
        floor = self.kth[q]
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero(scores >= floor[:, None])
        at, i, s = np.concatenate([self.q, q[row]]), np.concatenate([self.ids, ids[col]]), np.concatenate([self.scores, scores[row, col]])
        order = np.lexsort((i, -1 - s, at))  # -1 - s turns the order round without overflow
        at, i, s = at[order], i[order], s[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        keep = rank < self.k
        last = rank == self.k - 1
        self.kth[at[last]] = s[last]
        self.q, self.ids, self.scores = at[keep], i[keep], s[keep]


def search_blocks(batch: pa.RecordBatch, q_ids: np.ndarray, q: np.ndarray, q_rows: np.ndarray, best: Best) -> int:
    """Scores the blocks of ``batch`` of the queries' dimension against them; returns how many pairs of query and block were scored."""
    dim = q.shape[1]
    found = [i for i, d in enumerate(batch.column(0).to_pylist()) if d == dim]
    if not found or not len(q):
        return 0
    read = lambda name, i, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)
    high, low, centre = (np.stack([read(name, i, "<f8") for i in found]) for name in ("high", "low", "centre"))
    radius = batch.column("radius").to_numpy()[found]
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    with np.errstate(over="ignore", invalid="ignore"):
        spread = np.sqrt((q**2).sum(axis=1))[:, None] * radius
        ball = q @ centre.T + spread + (np.abs(q) @ np.abs(centre).T + spread) * 1e-9  # above what rounding can take away
        bounds += (np.maximum(q, 0) @ np.abs(high).T + np.maximum(-q, 0) @ np.abs(low).T) * 1e-9
    bounds = np.fmin(bounds, np.where(np.isfinite(ball), ball, np.inf)) + 1
    loaded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    waiting = np.ones(bounds.shape, bool)

    def against(who: np.ndarray, b: int) -> None:
        if b not in loaded:
            data, ids = batch.column("forward")[found[b]].as_py(), read("ids", found[b], "<i8")
            loaded[b] = ids, np.frombuffer(data, "<i4" if len(data) == 4 * dim * len(ids) else "<f8").reshape(len(ids), dim).astype(np.float64)
        ids, x = loaded[b]
        scores = products(q[who], x)
        waiting[who, b] = False
        own = q_ids[who][:, None] == ids[None, :]
        if own.any():  # a query's own row is no candidate
            clean = ~own.any(axis=1)
            best.add(q_rows[who[clean]], ids, scores[clean])
            for r in np.flatnonzero(~clean):
                best.add(q_rows[who[r : r + 1]], ids[~own[r]], scores[r : r + 1, ~own[r]])
        else:
            best.add(q_rows[who], ids, scores)

    likeliest = np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST]
    for turn in range(likeliest.shape[1]):  # each query's likeliest blocks, which raise what the others must reach
        live = np.flatnonzero(bounds[np.arange(len(q)), likeliest[:, turn]] >= best.kth[q_rows])
        for b in np.unique(likeliest[live, turn]):
            against(live[likeliest[live, turn] == b], b)
    for b in np.argsort(-bounds.max(axis=0), kind="stable"):  # the others by their highest bound, each for all queries that it may still serve
        live = np.flatnonzero(waiting[:, b] & (bounds[:, b] >= best.kth[q_rows]))
        if len(live):
            against(live, b)
    return int((~waiting).sum())


def search(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, group: int | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the rows of ``vectors`` that ``queries`` (over ``vec_id``) holds for.

    Vectors of another length than the query's are no candidates, nor are rows with the query's id. Null
    ids and unusable vectors take no part. Repeated query rows give repeated results, repeated rows are candidates
    each, equal scores go by the smaller id. Fewer than k candidates give as many rows as there are, an empty table none.
    """
    spark = vectors.sparkSession
    found_schema = "query_id long, rank int, vec_id long, score long"
    numbers = whole_numbers(vectors, id_col, vector_col, scale)
    with Scratch(spark, "topk") as scratch:
        # A written number deals the queries out, so rows that share an id or a vector don't fill one group.
        asked = scratch.cut(numbers.filter(queries).withColumn("turn", F.xxhash64("vec_id", F.monotonically_increasing_id())), "queries")
        n, widest = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        if not n:
            return spark.createDataFrame([], found_schema)
        blocks = scratch.cut(blocks_of(numbers, centres_of(numbers)), "blocks")
        path = scratch.folder("found", keep=True)
        groups = -(-n // (group or max(1, GROUP_BYTES // (8 * max(widest, 1)))))
        for g in range(groups):
            rows = asked.filter(F.pmod("turn", F.lit(groups)) == g).select("vec_id", "v").toArrow()  # about GROUP_BYTES of the stated query set
            _one_group(blocks, rows.combine_chunks(), k).write.mode("append").parquet(path)
    return spark.read.schema(found_schema).parquet(path)


def _one_group(blocks: DataFrame, rows: pa.Table, k: int) -> DataFrame:
    batch = pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns], rows.column_names)
    parts = [(batch.column(0).to_numpy(zero_copy_only=False)[at], at, m) for at, m in _matrices(batch, 1)] if batch.num_rows else []
    sent = blocks.sparkSession.sparkContext.broadcast((batch.column(0).to_numpy(zero_copy_only=False), parts))

    def run(batches: Iterator[pa.RecordBatch]):
        all_ids, asked = sent.value
        best = Best(len(all_ids), k)
        for batch in batches:
            for ids, at, m in asked:
                for s in range(0, len(ids), AT_ONCE):
                    search_blocks(batch, ids[s : s + AT_ONCE], m[s : s + AT_ONCE], at[s : s + AT_ONCE], best)
        yield pa.RecordBatch.from_arrays([pa.array(best.q.astype(np.int32)), pa.array(all_ids[best.q]), pa.array(best.ids), pa.array(best.scores)], ["query_row", "query_id", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    found = blocks.mapInArrow(run, "query_row int, query_id long, vec_id long, score long").withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
