"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets, closed to components.

1. One pass over the texts gives each document its set size, a SHA-256 of its sequence of words and a signature of
   ``SYMBOLS`` b-bit MinHash symbols.
2. Documents with one sequence of words are one class, which takes no comparison (map-side sums; a group of
   copies costs a row per task). From here on only class representatives take part.
3. Signatures are split into ``CHUNKS`` chunks. If two signatures differ in at most ``MAX_DISTANCE`` symbols,
   some chunk differs in at most ``CHUNK_ERRORS`` (pigeonhole), so for every choice of the symbols that may
   differ the rest of the chunk is an index key: all pairs within the distance meet at some key.
4. First, each key's members are compared with its smallest id only, then, in keys that still hold two
   components or more, with one member drawn per key, ``ROUNDS`` times. Each round is linear in the members,
   and links what is linked often: a group of near copies grows together without its pairs being listed. A member that
   was compared with all others of a key leaves that key.
5. Keys that hold two components even then are compared in full: their members are dealt into cells of
   bounded size that together hold every pair once, with their whole sets.
6. Links are confirmed on whole sets. Sets are compared as 64-bit hashes of shingles, and as the shingles
   themselves where the count is within ``SLACK`` shingles of the threshold, so an error would take more equal hashes
   of different shingles than that in one pair. A document that many others are compared with is sent to each of several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import BROADCAST_IDS, Scratch, fresh, table

WIDTH = 5
SYMBOLS, BITS, CHUNKS, CHUNK_ERRORS = 40, 16, 8, 1
CHUNK = SYMBOLS // CHUNKS
#: Pairs within this distance are sure to meet: with one more error, each chunk could hold two.
MAX_DISTANCE = CHUNKS * (CHUNK_ERRORS + 1) - 1
#: The method's distance: pairs that met are compared on full sets up to it (a pair at 0.85 is beyond it once in 10 million, one at 0.80 once in a million).
SCREEN_DISTANCE = 21
#: A cell holds about so many members of a key, and so many shingles, on each side.
CELL, CELL_SHINGLES = 2000, 2_000_000
#: Rounds of comparisons with drawn members.
ROUNDS = 2
#: Counts so near the threshold are taken again on the shingles themselves.
SLACK = 4
#: Keys with more than this share of a table's rows are joined by broadcast: there are at most as many as its inverse.
HOT_SHARE, HOT_LEAST = 1000, 16
NUMERATOR, DENOMINATOR = 85, 100

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = _RANDOM.integers(0, 2**63, SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**63, SYMBOLS, np.uint64)
_POSITIONS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_WORDS_HELD = 300_000


class _Hashes(dict):
    """64-bit hashes of words, kept for words seen before, within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_HELD:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes | None) -> list[bytes]:
    """``bytes`` lower and split by ASCII alone, as asked for."""
    return (text or b"").lower().split()


def shingle_set(words: list[bytes], hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text's words."""
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(ids) - WIDTH + 1
    if n < 1:
        return _mixed(np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64))
    total = ids[:n] * _POSITIONS[0]
    for k in range(1, WIDTH):
        total = total + ids[k : k + n] * _POSITIONS[k]
    return np.unique(_mixed(total))


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    if len(words) < WIDTH:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(WIDTH)), strict=False))


def signature(shingles: np.ndarray) -> bytes:
    """``SYMBOLS`` symbols of ``BITS`` bits, each from the smallest of the shingles under its own permutation."""
    least = np.full(SYMBOLS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096, None] * _FACTORS + _SHIFTS
        np.minimum(least, part.min(axis=0), out=least)
    return (_mixed(least) >> np.uint64(64 - BITS)).astype("<u2").tobytes()


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``same`` (SHA-256 of the words) and ``sig`` per row; the last two are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]):
        hashes = _Hashes()
        for batch in batches:
            sizes, same, sigs = [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                words = words_of(text.as_py())
                s = shingle_set(words, hashes)
                sizes.append(len(s))
                same.append(hashlib.sha256(b" ".join(words)).digest() if words else None)
                sigs.append(signature(s) if words else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "same", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, same binary, sig binary")


def hot_bound(total: int) -> int:
    return max(HOT_LEAST, total // HOT_SHARE)


def hot_join(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """``left`` joined to ``right``, which has each key once, with ``n``, how many of the ``total`` rows of ``left`` have it at most.

    Keys that would fill a task are told apart by a list: as each has a share of at least 1 / ``HOT_SHARE``, or ``HOT_LEAST`` rows of a
    small table, there are no more than ``HOT_SHARE`` of them. Their rows stay where they are and meet a broadcast; all
    others are shuffled by their key.
    """
    more = [c for c in right.columns if c not in (key, "n")]
    keys = [r[0] for r in right.filter(F.col("n") >= hot_bound(total)).select(key).collect()]  # HOT_SHARE at most
    side = right.select(key, *more)
    if not keys:
        return left.join(side, key).select(*left.columns, *more)
    hot = F.col(key).isin(keys)
    found = left.filter(~hot).join(side.filter(~hot), key).unionByName(left.filter(hot).join(F.broadcast(side.filter(hot)), key))
    return found.select(*left.columns, *more)


def index_keys(classes: DataFrame) -> DataFrame:
    """``key`` (the symbols of a chunk that must agree, with the chunk and the choice), ``which`` (chunk and choice) and ``id``: CHUNKS * CHUNK rows for each row of ``classes``."""
    keep = [[p for p in range(CHUNK) if p != out] for out in range(CHUNK)]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
            powers = np.uint64(1) << (np.arange(CHUNK - 1, dtype=np.uint64) * np.uint64(BITS))
            keys = np.stack([(symbols[:, :, p] * powers).sum(axis=2, dtype=np.uint64) for p in keep], axis=2)
            which = np.arange(CHUNKS * CHUNK, dtype=np.uint64).reshape(CHUNKS, CHUNK)
            keys = _mixed(keys ^ _mixed(which + np.uint64(1)))  # one number for symbols, chunk and choice
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), CHUNKS * CHUNK)
            places = np.tile(which.reshape(-1).astype(np.int8), len(symbols))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).astype(np.int64)), pa.array(places), pa.array(ids)], ["key", "which", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long, which tinyint, id long")


def near(a: pa.ChunkedArray | pa.Array, b: pa.Array) -> np.ndarray:
    """Symbols in which the signatures of ``a`` and ``b`` differ, row by row."""
    x, y = (np.frombuffer(b"".join(v.to_pylist()), "<u2").reshape(-1, SYMBOLS) for v in (a, b))
    return (x != y).sum(axis=1)


def screened(pairs: DataFrame, classes: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Of ``pairs`` (a, b) those whose set sizes and signatures allow the similarity."""
    side = lambda name: classes.select(F.col("id").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"))
    often = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    both = hot_join(pairs.join(side("a"), "a"), side("b").join(often, "b"), "b", pairs.count())
    sizes = F.least("n_a", "n_b") * denominator >= F.greatest("n_a", "n_b") * numerator

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                yield batch.select([0, 1]).filter(pa.array(near(batch.column(2), batch.column(3)) <= SCREEN_DISTANCE))

    return both.filter(sizes).select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def texts_of(scratch: Scratch, docs: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """``id``, ``text``: the texts of ``ids``, each once. Ids are broadcast only after they have been counted; beyond the bound it is a shuffled join."""
    few = ids.count() <= BROADCAST_IDS
    found = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return scratch.cut(found.dropDuplicates(["id", "text"]) if repeated else found, "texts")


class _Held:
    """A text's words and its set."""

    def __init__(self, text: bytes, hashes: dict):
        self.words = words_of(text)
        self.set = shingle_set(self.words, hashes)

    def linked(self, other: _Held, numerator: int, denominator: int) -> bool:
        shared = len(np.intersect1d(self.set, other.set, assume_unique=True))
        margin = denominator * shared - numerator * (len(self.set) + len(other.set) - shared)
        if abs(margin) > SLACK * (numerator + denominator):
            return margin > 0
        a, b = shingles(self.words), shingles(other.words)
        return denominator * len(a & b) >= numerator * len(a | b)


def confirmed(scratch: Scratch, pairs: DataFrame, docs: DataFrame, numerator: int, denominator: int, repeated: bool) -> DataFrame:
    """Of ``pairs`` (a, b) those with ``denominator * |A & B| >= numerator * |A | B|`` on their full sets.

    The text of ``b`` goes once to the task that compares it with its partners; a ``b`` with many partners goes to several.
    """
    total = pairs.count()
    ids = scratch.cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids")
    texts = texts_of(scratch, docs, ids, repeated)
    bound = hot_bound(total)
    hubs = pairs.groupBy("b").count().filter(F.col("count") >= bound).select("b", F.ceil(F.col("count") / bound).alias("salts"))  # at most HOT_SHARE rows
    salted = pairs.join(F.broadcast(hubs), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    members = salted.join(texts.withColumnRenamed("id", "a"), "a").select("b", "salt", "a", "text")
    centres = salted.select("b", "salt").distinct().join(texts.withColumnRenamed("id", "b"), "b").select("b", "salt", F.lit(None).cast("long").alias("a"), "text")

    def run(batches: Iterator[pa.RecordBatch]):
        hashes, now, held = _Hashes(), None, []
        for batch in batches:
            b, salt, a = (batch.column(k).to_pylist() for k in range(3))
            found = []
            for i, text in enumerate(batch.column(3).cast(pa.large_binary())):
                one = _Held(text.as_py(), hashes)
                if a[i] is None:  # the texts of b come before its partners
                    if now != (b[i], salt[i]):
                        now, held = (b[i], salt[i]), []
                    held.append(one)
                elif any(x.linked(one, numerator, denominator) for x in held):
                    found.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    dealt = centres.unionByName(members).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long")


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """``id``, ``root`` (the smallest id reachable) for each id in ``links`` (a, b) that is not its own root.

    Every label hooks to its smallest neighbour, chains of hooks are halved until they are flat, and links
    between labels are what the next round sees; the number of rounds grows with the logarithm of
    the longest path. Each round is a written table, so a lost executor costs no more than a round.
    A label with many links is one row of the other side of each join, which adaptive execution splits.
    """
    spark = links.sparkSession
    edges = scratch.cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = scratch.cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("id").alias("root"), F.col("root").alias("up"))
            jumped = scratch.cut(hooks.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root"), (F.coalesce("up", "root") != F.col("root")).alias("moved")), "hooks")
            moved = jumped.filter("moved").limit(1).count()
            hooks = jumped.drop("moved")
            if not moved:
                break
        if labels is None:
            labels = hooks
        else:
            step = hooks.select(F.col("id").alias("root"), F.col("root").alias("up"))
            labels = scratch.cut(labels.join(step, "root", "left").select("id", F.coalesce("up", "root").alias("root")), "labels")
        at = lambda name: hooks.select(F.col("id").alias(name), F.col("root").alias(f"r{name}"))  # noqa: E731,B023
        edges = scratch.cut(edges.join(at("a"), "a").join(at("b"), "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if labels is None:
        return spark.createDataFrame([], "id long, root long")
    return labels.filter("id <> root")


def shared_keys(scratch: Scratch, classes: DataFrame) -> DataFrame:
    """``key``, ``which``, ``id``, ``low`` (the key's smallest id) for the members of keys that two ids or more share."""
    with Scratch(classes.sparkSession, "near-dup") as inner:
        return _shared_keys(scratch, inner, classes)


def _shared_keys(scratch: Scratch, inner: Scratch, classes: DataFrame) -> DataFrame:
    keys = inner.cut(index_keys(classes), "keys")
    lows = inner.cut(keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).filter("low < top").drop("top"), "lows")
    return scratch.cut(hot_join(keys, lows, "key", keys.count()), "shared-keys")


def left_over(scratch: Scratch, keys: DataFrame, links: DataFrame, turn: int) -> DataFrame:
    """``key``, ``which``, ``id``, ``root`` for the members of keys that hold two components or more, with one member of each key (``b``, of component ``b_root``), drawn by a hash."""
    with Scratch(links.sparkSession, "near-dup") as inner:
        roots = inner.cut(components(inner, links), "roots")
        of = inner.cut(keys.select("key", "which", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "members")
        drawn = F.min(F.struct(F.xxhash64("id", "key", F.lit(turn)).alias("h"), "id", "root")).alias("c")
        open_keys = of.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), drawn).filter("low < high")
        open_keys = inner.cut(open_keys.select("key", F.col("c.id").alias("b"), F.col("c.root").alias("b_root"), "n"), "open-keys")
        return scratch.cut(hot_join(of, open_keys, "key", of.count()), "left-over")


def whole_sets(scratch: Scratch, docs: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """``id``, ``set``: the sorted hashes of the sets of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]):
        hashes = _Hashes()
        for batch in batches:
            sets = [shingle_set(words_of(t.as_py()), hashes).astype("<u8").tobytes() for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    return texts_of(scratch, docs, ids, repeated).select("id", "text").mapInArrow(run, "id long, set binary")


def shared_with(dense: np.ndarray, offsets: np.ndarray, i: int, others: np.ndarray, flag: np.ndarray, at_once: int = 4_000_000) -> np.ndarray:
    """How many hashes set ``i`` shares with each of ``others``. ``dense``: the sets one after another, as numbers below ``len(flag)``."""
    mine = dense[offsets[i] : offsets[i + 1]]
    flag[mine] = True
    sizes = offsets[others + 1] - offsets[others]
    found = []
    for part in np.split(np.arange(len(others)), np.flatnonzero(np.diff(np.cumsum(sizes) // at_once)) + 1):
        n = sizes[part]
        ends = np.cumsum(n)
        places = np.arange(ends[-1]) + np.repeat(offsets[others[part]] - ends + n, n)
        found.append(np.add.reduceat(flag[dense[places]], ends - n, dtype=np.int64))
    flag[mine] = False
    return np.concatenate(found)


def cell_pairs(scratch: Scratch, members: DataFrame, classes: DataFrame, docs: DataFrame, numerator: int, denominator: int, repeated: bool, cell: int = CELL) -> DataFrame:
    """(a, b): links that join all components of a key which its pairs link, each from the first key that the two share; counts within ``SLACK`` of the threshold are still to be confirmed.

    A key with n members is dealt into ceil(n / cell) blocks (more, if their sets are large), and each pair of blocks is a
    cell, so no task holds more than two blocks, and still each pair meets. Whole sets are compared there;
    components that are linked in a cell are one from then on, so few pairs leave it.
    """
    about = scratch.cut(classes.select("id", "n_shingles", "sig", "same").join(members.select("id").distinct(), "id", "left_semi"), "left-over-classes")
    sized = scratch.cut(members.join(about.groupBy("id").agg(F.max("n_shingles").alias("size")), "id"), "sized")
    many = F.greatest(F.count(F.lit(1)) / cell, F.sum("size") / CELL_SHINGLES)
    blocks = scratch.cut(sized.groupBy("key").agg(F.ceil(many).cast("int").alias("blocks")), "blocks")
    dealt = sized.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("key", "which", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "root")
    sets = scratch.cut(whole_sets(scratch, docs, about.select("id").distinct(), repeated), "sets")
    whole_rows = cells.join(about.select("id", "sig").dropDuplicates(["id"]), "id").join(sets.filter(F.length("set") > 0), "id")

    def run(key, whole):
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        ids, roots, blocks_ = (whole.column(k).to_numpy() for k in ("id", "root", "block"))
        roots = roots.copy()
        sigs = np.frombuffer(b"".join(whole.column("sig").to_pylist()), "<u2").reshape(-1, SYMBOLS)
        which, x, y = (k.as_py() for k in key[1:])
        parts = whole.column("set").to_pylist()
        sizes = np.array([len(v) // 8 for v in parts])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        distinct, dense = np.unique(np.frombuffer(b"".join(parts), "<u8"), return_inverse=True)
        flag, slack = np.zeros(len(distinct), bool), SLACK * (numerator + denominator)
        left, right = np.flatnonzero(blocks_ == x), np.flatnonzero(blocks_ == y)
        for i in left:
            others = right[right > i] if x == y else right
            others = others[roots[others] != roots[i]]
            low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
            others = others[low * denominator >= high * numerator]
            differ = (sigs[others] != sigs[i]).reshape(-1, CHUNKS, CHUNK)
            errors = differ.sum(axis=2)
            chunk = (errors <= CHUNK_ERRORS).argmax(axis=1)
            here = np.arange(len(others))
            choice = np.where(errors[here, chunk] > 0, differ[here, chunk].argmax(axis=1), 0)
            others = others[(chunk * CHUNK + choice == which) & (errors.sum(axis=1) <= SCREEN_DISTANCE)]
            if not len(others):
                continue
            shared = shared_with(dense, offsets, i, others, flag)
            margin = denominator * shared - numerator * (sizes[i] + sizes[others] - shared)
            sure = others[margin > slack]
            _, first = np.unique(roots[sure], return_index=True)
            doubtful = others[np.abs(margin) <= slack]
            linked = np.concatenate([sure[first], doubtful[~np.isin(roots[doubtful], roots[sure])]])
            roots[np.isin(roots, roots[sure])] = roots[i]
            found.append((np.maximum(ids[linked], ids[i]), np.minimum(ids[linked], ids[i])))
        return pa.table({"a": np.concatenate([x[0] for x in found]), "b": np.concatenate([x[1] for x in found])})

    return whole_rows.groupBy("key", "which", "x", "y").applyInArrow(run, "a long, b long")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for each row of ``docs``.

    Null and empty texts have an empty set and are linked with nothing, whatever else their id holds. Rows of one id and set give equal
    rows; an id with several texts links them, and what is near any of them. A row without an id is a document of its
    own: its ``component_id`` is null and it is kept. Very long texts are compared whole. An empty table gives no rows.
    """
    with Scratch(docs.sparkSession, "near-dup") as scratch:
        return _linked(scratch, docs, id_col, text_col, numerator, denominator, keep=True)


def _linked(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, numerator: int, denominator: int, keep: bool) -> DataFrame:
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = scratch.cut(sketched(named), "sketches", keep)
    known = sketches.filter("doc_id is not null and n_shingles > 0")
    classes = scratch.cut(known.groupBy("same").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")
    again = scratch.cut(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), (F.min(F.xxhash64("same")) != F.max(F.xxhash64("same"))).alias("several")).filter("n > 1"), "repeated-ids")
    repeated = again.limit(1).count() > 0
    keys = shared_keys(scratch, classes)

    def tested(make: Callable[[Scratch], DataFrame], screen: bool = True) -> DataFrame:
        with Scratch(docs.sparkSession, "near-dup") as inner:
            pairs = inner.cut(make(inner), "met")
            if screen:
                pairs = inner.cut(screened(pairs, classes, numerator, denominator).distinct(), "pairs")
            return scratch.cut(confirmed(inner, pairs, named, numerator, denominator, repeated), "links")

    # Whoever was compared with all other members of a key leaves it, so a key of two is done with its first comparison.
    rest = keys.filter("id > low")
    links = tested(lambda _: rest.select(F.col("id").alias("a"), F.col("low").alias("b")).distinct())
    for turn in range(ROUNDS + 1):
        rest = left_over(scratch, rest, links, turn)
        if not rest.limit(1).count():
            break
        if turn < ROUNDS:
            links = links.union(tested(lambda _, rest=rest: rest.filter("root <> b_root").select(F.col("id").alias("a"), "b").distinct()))
            rest = rest.filter("id <> b")
        else:
            links = links.union(tested(lambda inner, rest=rest: cell_pairs(inner, rest, classes, named, numerator, denominator, repeated).distinct(), screen=False))
    if repeated:  # ids with several texts join their classes
        of = known.join(again.filter("several").select("doc_id"), "doc_id", "left_semi").join(classes.select("same", "id"), "same").select("doc_id", F.col("id").alias("a")).distinct()
        links = links.union(of.join(of.groupBy("doc_id").agg(F.min("a").alias("b")), "doc_id").select("a", "b"))
    with Scratch(docs.sparkSession, "near-dup") as inner:
        roots = scratch.cut(components(inner, links), "components")
    # Only classes with copies, or below another root, change anything; those that would fill a task are broadcast.
    moved = classes.select("same", "id", "n").join(roots, "id", "left").filter("n > 1 or root is not null").select("same", F.coalesce("root", "id").alias("component_id"), "n")
    moved = scratch.cut(moved, "moved", keep)
    bound = hot_bound(sketches.count())
    hot = moved.filter(F.col("n") >= bound).select("same", F.col("component_id").alias("hot"))  # at most HOT_SHARE rows
    marked = sketches.join(F.broadcast(hot), "same", "left")
    # A row that has its root, or has no words, gets a key of its own, which no class has.
    key = F.when(F.col("hot").isNull() & F.col("same").isNotNull(), F.col("same")).otherwise(F.unhex(F.hex(F.xxhash64("doc_id"))))
    joined = marked.withColumn("key", key).join(moved.filter(F.col("n") < bound).select(F.col("same").alias("key"), "component_id"), "key", "left")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("hot", "component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; of repeated rows of it, one."""
    (gone_id,) = fresh(docs, "gone")
    with Scratch(docs.sparkSession, "near-dup") as scratch:
        found = _linked(scratch, docs, id_col, text_col, numerator, denominator, keep=False)
        gone = scratch.cut(found.filter("not kept").select(F.col("doc_id").alias(gone_id)).distinct(), "gone", keep=True)
        repeated = found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    few = gone.count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(gone) if few else gone, docs[id_col] == gone[gone_id], "left_anti")
    if not repeated:
        return left
    has_id = F.col(id_col).isNotNull()
    return left.filter(has_id).dropDuplicates([id_col]).unionByName(left.filter(~has_id))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents").select("doc_id", "text"))
