"""A quality classifier: random-indexing word vectors pooled per document, and a small calibrated network.

1. Words are counted over all documents. Those that are frequent enough (``least_frequent``) have a vector each; all others
   share ``REST`` vectors by a hash, and each word also has the vector of its shape. No word is left out.
2. A vector is the sum, over all documents, of the sparse random index vectors of a word's neighbours. A task
   sends on one row of sums per vector that it met, whatever it reads; rows are added by vector.
3. A document is pooled from its words' vectors once, and the pooled numbers are written.
4. The network learns from a bounded sample of labelled training rows on the driver (``SAMPLE``), its
   temperature from a part that it didn't learn from; then it scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, table

#: Most words with a vector of their own, vectors that all other words share, vectors of shapes; together fewer than 65,536.
VOCABULARY, REST, SHAPES = 1 << 15, 1 << 13, 1 << 9
ROWS = VOCABULARY + REST + SHAPES
#: Longer words (in bytes) have no vector of their own, so the vocabulary's size is bounded.
LONGEST_WORD = 64
DIM, NONZERO, WINDOW = 64, 4, 2
#: Frequencies are told apart in so many steps for each doubling.
STEPS = 8
#: Words that are worked on at once.
AT_ONCE = 400_000
#: Labelled rows that the network may learn from, those with the smallest hashes.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 0.01, 1e-4
PREDICT_FROM = 0.7
HELD_OUT = 2
FEATURES = 4 * DIM + 3
_WORDS_HELD = 300_000
_KINDS = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c > 127 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(?s)(.)\1+")


def shape(word: bytes) -> bytes:
    """The kinds of a word's characters, runs as one: ``Word!!`` has the shape ``Aa!``."""
    return _RUN.sub(rb"\1", word.translate(_KINDS))


class _Words(dict):
    """Row of a word and of its shape, as one number, kept for words seen before, within a bound."""

    def __init__(self, vocabulary: list[bytes]):
        super().__init__()
        self.own = {w: i for i, w in enumerate(vocabulary)}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_HELD:
            self.clear()
        low = word.lower()
        own = self.own.get(low)
        if own is None:
            own = VOCABULARY + xxhash.xxh3_64_intdigest(low) % REST
        like = VOCABULARY + REST + xxhash.xxh3_64_intdigest(shape(word)) % SHAPES
        value = self[word] = own | like << 32
        return value


def index_vectors() -> np.ndarray:
    """For each row ``NONZERO`` ones or minus ones at random places (a place drawn twice keeps the last)."""
    random = np.random.Generator(np.random.PCG64(7))
    made = np.zeros((ROWS, DIM), np.int8)
    places, signs = random.integers(0, DIM, (ROWS, NONZERO)), random.choice(np.array([-1, 1], np.int8), (ROWS, NONZERO))
    np.put_along_axis(made, places, signs, axis=1)
    return made


def _rows_of(texts, words: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For about ``AT_ONCE`` words of whole texts at once: row of each word, of its shape, and number of words per text."""
    own, sizes, held = [], [], 0
    for text in texts:
        tokens = (text or b"").split()
        own.append(np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens)))
        sizes.append(len(tokens))
        held += len(tokens)
        if held > AT_ONCE:
            yield _split(own, sizes)
            own, sizes, held = [], [], 0
    if sizes:
        yield _split(own, sizes)


def _split(own: list, sizes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = np.concatenate(own)
    return (both & 0xFFFF).astype(np.uint16), (both >> 32).astype(np.uint16), np.array(sizes)


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[bytes | None]:
    return (x.as_py() for x in batch.column(at).cast(pa.large_binary()))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word``, ``n``: how often each lower-cased word of up to ``LONGEST_WORD`` bytes stands in all texts."""

    def count(batches: Iterator[pa.RecordBatch]):
        held: Counter = Counter()

        def told():
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for text in _texts(batch, 0):
                held.update((text or b"").lower().split())
                if len(held) > _WORDS_HELD:
                    yield told()
        yield told()

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word binary, n long")
    return parts.filter(F.octet_length("word") <= LONGEST_WORD).groupBy("word").agg(F.sum("n").alias("n"))


def least_frequent(counts: DataFrame, most: int = VOCABULARY) -> int:
    """The lowest step of frequency from which on there are at most ``most`` words. One row per step (some hundred) comes to the driver."""
    steps = sorted(((r.step, r.n) for r in counts.groupBy(_step()).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    words, least = 0, (steps[0][0] + 1 if steps else 0)
    for step, n in steps:
        words += n
        if words > most:
            break
        least = step
    return least


def _step():
    return F.floor(F.log2("n") * STEPS).cast("int").alias("step")


def vocabulary(scratch: Scratch, docs: DataFrame, text_col: str = "text") -> list[bytes]:
    """The words with a vector of their own, in order: those as frequent as the bound on their number allows, over all documents."""
    counts = scratch.cut(word_counts(docs, text_col), "word-counts")
    rows = counts.filter(_step() >= least_frequent(counts)).select("word").collect()  # at most VOCABULARY words of LONGEST_WORD bytes
    return sorted(bytes(r.word) for r in rows)


def neighbour_sums(own: np.ndarray, like: np.ndarray, sizes: np.ndarray, index: np.ndarray, total: np.ndarray, shapes: np.ndarray) -> None:
    """Adds to ``total`` the index vectors of the neighbours within ``WINDOW`` of each word and of their shapes, by the word's row, and to ``shapes`` how often two shapes are neighbours."""
    place = np.arange(len(own)) + WINDOW * np.repeat(np.arange(len(sizes)), sizes)  # texts with empty places between them
    first_shape = ROWS - SHAPES
    for start in range(0, len(own), AT_ONCE):  # a long text takes several turns
        low, high = max(0, start - WINDOW), min(len(own), start + AT_ONCE + WINDOW)
        at = place[low:high] - place[low] + WINDOW
        context = np.zeros((at[-1] + WINDOW + 1, DIM), np.int8)
        context[at] = index[own[low:high]] + index[like[low:high]]
        around, kinds = np.zeros_like(context), np.full(len(context), SHAPES, np.int64)
        kinds[at] = like[low:high].astype(np.int64) - first_shape
        inner = slice(start - low, min(len(own), start + AT_ONCE) - low)
        here = at[inner]
        for step in range(1, WINDOW + 1):
            around[step:] += context[:-step]
            around[:-step] += context[step:]
            for other in (here - step, here + step):
                shapes += np.bincount(kinds[here] * (SHAPES + 1) + kinds[other], minlength=shapes.size)
        rows, columns = own[low:high][inner], np.ascontiguousarray(around[here].T)
        for d in range(DIM):
            total[d] += np.bincount(rows, columns[d], ROWS)  # whole numbers, exact in doubles


def with_shapes(total: np.ndarray, shapes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """A row of sums for each row of ``index``: those of ``total`` (a column each), and for the shapes the index vectors of the shapes that are their neighbours."""
    total = total.T.astype(np.int64)
    total[ROWS - SHAPES :] = shapes.reshape(SHAPES + 1, SHAPES + 1)[:SHAPES, :SHAPES] @ index[ROWS - SHAPES :].astype(np.int64)
    return total


def word_vectors(docs: DataFrame, words: list[bytes], text_col: str = "text") -> np.ndarray:
    """``ROWS`` x ``DIM`` unit rows (11 MB), from the neighbours of every word of every text; a row that no word has is zero."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]):
        known, index, total, shapes = _Words(sent.value), index_vectors(), np.zeros((DIM, ROWS)), np.zeros((SHAPES + 1) ** 2, np.int64)
        for batch in batches:
            for own, like, sizes in _rows_of(_texts(batch, 0), known):
                if len(own):
                    neighbour_sums(own, like, sizes, index, total, shapes)
        total = with_shapes(total, shapes, index)
        met = np.flatnonzero(total.any(axis=1))
        for part in np.array_split(met, max(1, len(met) // 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([_packed(x) for x in total[part]], pa.binary())], ["row", "sums"])

    def add(batches: Iterator[pa.RecordBatch]):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = _unpacked(data.as_py())
                totals[row] = totals[row] + x if row in totals else x
        unit = [(x / max(np.linalg.norm(x), 1e-9)).astype("<f4").tobytes() for x in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(unit, pa.binary())], ["row", "sums"])

    schema = "row int, sums binary"
    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, schema)
    vectors = np.zeros((ROWS, DIM), np.float32)
    for row in parts.repartition("row").mapInArrow(add, schema).collect():  # at most ROWS rows of one size
        vectors[row.row] = np.frombuffer(row.sums, "<f4")
    return vectors


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them all."""
    most = np.abs(x).max()
    return x.astype("<i1" if most < 128 else "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // DIM}").astype(np.int64)


def _distinct(rows: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows of each of ``n`` texts in order, how often each stands there, and where each text's begin."""
    keys = np.sort(text << 16 | rows)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    keys = keys[first]
    return keys & 0xFFFF, np.diff(np.append(first, len(rows))), np.searchsorted(keys, np.arange(n + 1) << 16)


def pooled_rows(own: np.ndarray, like: np.ndarray, sizes: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each text: mean vector of its words, of their shapes, of its distinct words, spread of the shapes, and three counts."""
    n = len(sizes)
    x = np.zeros((n, FEATURES), np.float32)
    text = np.repeat(np.arange(n), sizes)
    words, often, begin = _distinct(own, text, n)
    kinds, of_kinds, kinds_begin = _distinct(like, text, n)
    for i in np.flatnonzero(sizes):
        a, b, c, d = begin[i], begin[i + 1], kinds_begin[i], kinds_begin[i + 1]
        shares = np.stack([often[a:b] / sizes[i], np.full(b - a, 1 / (b - a))]).astype(np.float32)
        x[i, :DIM], x[i, 2 * DIM : 3 * DIM] = shares @ v[words[a:b]]
        share, shapes = (of_kinds[c:d] / sizes[i]).astype(np.float32), v[kinds[c:d]]
        mean = share @ shapes
        x[i, DIM : 2 * DIM], x[i, 3 * DIM : 4 * DIM] = mean, np.sqrt(np.maximum(share @ shapes**2 - mean**2, 0))
    some = np.maximum(sizes, 1)
    x[:, -3], x[:, -2], x[:, -1] = np.log1p(sizes) / 8, np.diff(begin) / some, np.diff(kinds_begin) / some
    return x


def pooled(docs: DataFrame, words: list[bytes], vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``x``: the pooled numbers of each row's whole text (``pooled_rows``), as float16."""
    sent = docs.sparkSession.sparkContext.broadcast((words, vectors))

    def run(batches: Iterator[pa.RecordBatch]):
        known, v = _Words(sent.value[0]), sent.value[1]
        for batch in batches:
            out = [x.astype("<f2").tobytes() for own, like, sizes in _rows_of(_texts(batch, 1), known) for x in pooled_rows(own, like, sizes, v)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x binary")


class Network:
    """Two layers; ``fit`` leaves the temperature at which held-back rows are likeliest."""

    def __init__(self, constant: float = 0.5):
        self.constant, self.temperature, self.layers = constant, 1.0, None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        random = np.random.Generator(np.random.PCG64(11))
        if len(y):
            self.constant = float(y.mean())
        if len(y) < 20 or len(np.unique(y)) < 2:
            return self
        order = random.permutation(len(y))
        back, learn = order[: len(y) // 6], order[len(y) // 6 :]
        self.mean, self.scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        layers = [random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
        for _ in range(max(EPOCHS, min(400, 200_000 // len(learn)))):
            for at in np.array_split(random.permutation(learn), max(1, len(learn) // BATCH)):
                h = np.tanh(z[at] @ layers[0] + layers[1])
                d = (1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3], -30, 30))) - y[at]) / len(at)
                dh = d[:, None] * layers[2] * (1 - h**2)
                step += 1
                for i, g in enumerate((z[at].T @ dh + DECAY * layers[0], dh.sum(axis=0), h.T @ d + DECAY * layers[2], d.sum(keepdims=True))):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g**2
                    layers[i] = layers[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        self.layers = layers
        if len(back):
            logits = self.logits(x[back])
            loss = lambda t: np.logaddexp(0, np.where(y[back] == 1, -logits, logits) / t).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.tanh(z @ self.layers[0] + self.layers[1]) @ self.layers[2] + self.layers[3]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32(id as text) mod 4 is ``HELD_OUT``; a null id is not one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == HELD_OUT, F.lit(False))


def train(features: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Learns from at most ``sample`` labelled rows outside the held-out part, those with the smallest hashes of their ids.

    Null labels and ids teach nothing. Of an id labelled twice the higher label holds; of an id with several texts
    the one whose numbers come first, so reruns learn the same.
    """
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = features.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).orderBy("doc_id").collect()  # ``sample`` rows at most
    x = np.array([np.frombuffer(r.x, "<f2") for r in rows], np.float64).reshape(-1, FEATURES)
    return Network().fit(x, np.array([r.quality for r in rows], float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` per row of ``docs``; null and empty texts are scored as texts without words.

    Without labels the score is 0.5 throughout; with labels of one kind it is that label. Repeated rows have equal
    scores. A text is read whole, however long. An empty table gives no rows.
    """
    docs, labels = docs.select("doc_id", "text"), labels.select("doc_id", "quality")
    with Scratch(docs.sparkSession, "quality-model") as scratch:
        words = vocabulary(scratch, docs)
        features = scratch.cut(pooled(docs, words, word_vectors(docs, words)), "pooled", keep=True)
    sent = docs.sparkSession.sparkContext.broadcast(train(features, labels))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f2").reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.probabilities(x.astype(np.float64)))], ["doc_id", "score"])

    scored = features.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
