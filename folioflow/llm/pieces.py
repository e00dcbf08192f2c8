"""SentencePiece encoding and decoding: distinct marked words of a batch, sorted into a trie, share their prefixes' forward scores.

The words of a batch that are new are sorted, which makes the batch a trie in depth-first order: each
word starts from the forward state of the prefix it shares with the word before, its best score and last
piece (Viterbi). So a prefix is worked out once, however many words share it.

Viterbi needs piece scores that add up. Unigram models have them. A BPE model's scores are only the order of its
merges; ``unigram_reading`` turns that order into log probabilities by a rule, which makes a unigram model of the same
pieces and ids (nothing is trained; the library gives the same ids for that model). With ``viterbi=False`` a
BPE model is applied by its merges instead: the forward state is then the last piece of the prefix's own
encoding, of the pieces that end there the one that merges with what precedes it nowhere.

Work is per partition: no word table is shuffled, and what a worker remembers is bounded.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words that a worker remembers.
REMEMBERED = 150_000
#: Words with more characters are encoded by themselves, with the same ids: states of so many prefixes aren't kept for the next word.
LONGEST = 200
UNKNOWN_PENALTY = 10.0


#: The session setting that names a model file; where it is unset, the module ``public_tokenizers`` of the environment is asked, if it is there.
MODEL_SETTING = "spark.folioflow.pieces.model"
#: ``unigram_reading`` gives the piece of rank r the score -ln(r + FLATTEN), in steps of 1 / STEPS (so that sums are exact).
FLATTEN, STEPS = 1000, 256


def default_model(spark: SparkSession | None = None) -> str:
    """The path of the model in use.

    Unigram and BPE models are taken; those with a character map, with ``remove_extra_whitespaces`` (the default of
    training), with user-defined pieces, or BPE models with unused pieces raise ``ValueError``.
    """
    if spark is not None and (path := spark.conf.get(MODEL_SETTING, None)):
        return path
    try:
        import public_tokenizers
    except ImportError as gone:
        raise RuntimeError(f"no model: pass model_path or set {MODEL_SETTING}") from gone
    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def unigram_reading(data: bytes) -> bytes:
    """A unigram model file with the pieces, ids, types and settings of a BPE model's; other models are given back as they are.

    Pieces rank by their merges' order and score as ranks do by Zipf's law, flattened at the top, so an encoding
    takes few pieces, and of equally few the more usual ones.
    """
    held = list(_fields(data))
    spec = next((dict(_fields(v)) for n, v in held if n == 2), {})
    if spec.get(3, UNIGRAM) != BPE:
        return data
    pieces = [dict(_fields(v)) for n, v in held if n == 1]
    scores = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
    ranked = sorted((i for i, p in enumerate(pieces) if p.get(3, NORMAL) in (NORMAL, UNUSED)), key=lambda i: (-scores[i], i))
    for rank, i in enumerate(ranked):
        scores[i] = -round(math.log(rank + FLATTEN) * STEPS) / STEPS
    out = [_field(1, _field(1, p.get(1, b"")) + _field(2, float(s)) + _field(3, p.get(3, NORMAL))) for p, s in zip(pieces, scores, strict=True)]
    out.append(_field(2, b"".join(_field(n, v) for n, v in (spec | {3: UNIGRAM}).items() if isinstance(v, int))))
    return b"".join(out + [_field(3, b"".join(_field(n, x) for n, x in _fields(v))) for n, v in held if n == 3])


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """A SentencePiece model file: pieces, scores, types and the few settings that encoding needs."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        kind, byte_fallback, dummy, unk = UNIGRAM, False, True, None
        squeeze, charmap = True, b""
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                kind, byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                charmap, dummy, squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if charmap or squeeze or kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models without text normalisation are supported")
        if USER_DEFINED in self.types or kind == BPE and UNUSED in self.types:
            raise ValueError("models with user-defined pieces, and BPE models with unused ones, aren't supported")
        self.kind, self.dummy_prefix = kind, dummy
        self.unk = self.types.index(UNKNOWN)
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE} if byte_fallback else {}
        self.least = min((s for s, t in zip(self.scores, self.types, strict=True) if t == NORMAL), default=0.0)
        #: Whether the merge rules leave two pieces as they are where they stand side by side.
        self._apart: dict[int, bool] = {}
        #: Pieces that an encoding may hold: with BPE, those that the merge rules make out of their characters.
        self.made = {p: k for p, k in self.ids.items() if len(p) == 1 or kind == UNIGRAM or self.merged(p) == [p]}
        self._build_automaton()

    def _build_automaton(self) -> None:
        """The pieces as an automaton: a node stands for the longest end of what was read that begins a piece.

        ``_ends`` holds for each node the pieces that end there as (length, id), longest first. Nodes are numbered in steps
        of ``1 << 21``, so a node and a character make one key.
        """
        step, fail, ends, order = {}, [0], [()], [[]]
        for piece, k in self.made.items():
            node = 0
            for depth, char in enumerate(map(ord, piece)):
                if (after := step.get(node | char)) is None:
                    after = step[node | char] = len(ends) << 21
                    ends.append(())
                    fail.append(0)
                    if len(order) <= depth + 1:
                        order.append([])
                    order[depth + 1].append((node, char, after))
                node = after
            ends[node >> 21] = ((len(piece), k),)
        for level in order[2:]:  # a node's own pieces, then those of the longest end that is a node too
            for node, char, after in level:
                back = fail[node >> 21]
                while back and back | char not in step:
                    back = fail[back >> 21]
                fail[after >> 21] = step.get(back | char, 0)
                more = ends[fail[after >> 21] >> 21]
                ends[after >> 21] = ends[after >> 21] + more if ends[after >> 21] else more
        self._step, self._fail, self._ends = step, fail, ends

    def _next(self, node: int, char: int) -> int:
        """The node after one more character, remembered within a bound."""
        step, back = self._step, node
        while back and back | char not in step:
            back = self._fail[back >> 21]
        found = step.get(back | char, 0)
        if len(step) < 400_000:
            step[node | char] = found
        return found

    def opening(self) -> set[str]:
        """ASCII characters other than letters that no piece holds after a character that is neither one of them nor a mark.

        So no piece reaches over the place before one of them that follows another character.
        """
        found = {chr(c) for c in range(128) if not chr(c).isalpha()}
        pairs = {(x, y) for p in self.ids for x, y in zip(p, p[1:], strict=False) if x != MARK}
        while late := {y for x, y in pairs if y in found and x not in found}:
            found -= late
        return found

    # BPE by its merge rules, for short strings and for what the forward states can't tell.

    def merged(self, word: str, border: int = 0) -> list[str]:
        """The pieces that merging the best-scored neighbours first, the leftmost of equals, leaves; none, once a merge reaches over ``border``."""
        parts: list[str | None] = list(word)
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (k := self.ids.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-self.scores[k], i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            if j == border:
                return []
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def id_list(self, pieces: Iterable[str]) -> list[int]:
        out = []
        for piece in pieces:
            if (k := self.ids.get(piece)) is not None:
                out.append(k)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            elif not out or out[-1] != self.unk:  # neighbours that are unknown are one
                out.append(self.unk)
        return out

    # Forward states along a trie.

    def encode_sorted(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """The ids of each of ``words``, which are sorted; forward states are kept for the prefix shared with the next word."""
        forward = self._forward_bpe if self.kind == BPE else self._forward_unigram
        state: list = [(0, -1, (), 0.0)]
        last = ""
        for word in words:
            if len(word) > LONGEST:
                yield word, self._alone(word)
                continue
            if self.kind == BPE and MARK * 2 in word:  # pieces of marks have equal scores: only the rules tell
                yield word, tuple(self.id_list(self.merged(word)))
                continue
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del state[shared + 1 :]
            forward(word, state)
            last = word
            yield word, state[-1][2]

    def _alone(self, word: str) -> tuple[int, ...]:
        if self.kind == BPE:
            return tuple(self.id_list(self.merged(word)))
        step, ends, node, scores, back = self._step, self._ends, 0, [0.0], [(0, None)]
        for end, char in enumerate(word, 1):
            if (after := step.get(node | ord(char))) is None:
                after = self._next(node, ord(char))
            node = after
            start, score, k = end - 1, scores[end - 1] + self.least - UNKNOWN_PENALTY, None
            for n, own in ends[node >> 21]:
                if (value := scores[end - n] + self.scores[own]) > score:
                    start, score, k = end - n, value, own
            scores.append(score)
            back.append((start, k))
        found, end = [], len(word)
        while end:
            start, k = back[end]
            found.append(self.pieces[k] if k is not None else word[end - 1])
            end = start
        return tuple(self.id_list(reversed(found)))

    def _joined(self, ids: tuple[int, ...], piece: str) -> tuple[int, ...]:
        """``ids`` and those of a piece, which may be unknown."""
        more = tuple(self.id_list([piece]))
        return ids if more == (self.unk,) == ids[-1:] else ids + more

    def _forward_unigram(self, word: str, state: list) -> None:
        """States (node, last piece's id, ids, best score) of the prefixes of ``word`` that ``state`` doesn't hold yet."""
        step, ends, scores = self._step, self._ends, self.scores
        node = state[-1][0]
        for end in range(len(state), len(word) + 1):
            char = word[end - 1]
            if (after := step.get(node | ord(char))) is None:
                after = self._next(node, ord(char))
            node = after
            start, score, k = end - 1, state[end - 1][3] + self.least - UNKNOWN_PENALTY, None
            for n, own in ends[node >> 21]:
                if (value := state[end - n][3] + scores[own]) > score:
                    start, score, k = end - n, value, own
            ids = state[start][2]
            state.append((node, k, ids + (k,) if k is not None else self._joined(ids, char), score))

    def _forward_bpe(self, word: str, state: list) -> None:
        """States (node, last piece's id, ids) of the prefixes of ``word`` that ``state`` doesn't hold yet; an unknown character's id is its code point's negative less two."""
        step, ends, apart, names = self._step, self._ends, self._apart, self.pieces
        node = state[-1][0]
        for end in range(len(state), len(word) + 1):
            char = word[end - 1]
            if (after := step.get(node | ord(char))) is None:
                after = self._next(node, ord(char))
            node = after
            for n, k in ends[node >> 21]:
                before, ids = state[end - n][1:3]
                if n < end:
                    key = before << 20 | k
                    fits = apart.get(key)
                    if fits is None:
                        left = names[before] if before >= 0 else chr(-before - 2)
                        if len(apart) > 400_000:
                            apart.clear()
                        fits = apart[key] = self.merged(left + names[k], len(left)) == [left, names[k]]
                    if not fits:
                        continue
                state.append((node, k, ids + (k,)))
                break
            else:
                state.append((node, -ord(char) - 2, self._joined(state[end - 1][2], char)))


class Encoder:
    """Ids of whole texts, with the words of earlier batches remembered."""

    def __init__(self, model: Model):
        self.model, self.known, self.older = model, {}, {}
        opening = "".join(map(re.escape, sorted(model.opening())))
        rest = f"[^{MARK}{opening}]"
        self._words = re.compile(f"{MARK}+[{opening}]*{rest}*|[{opening}]+{rest}*|{rest}+")
        whole = [p.replace(MARK, " ") for p in model.pieces]
        self.text_of = {i: p for i, (p, t) in enumerate(zip(whole, model.types, strict=True)) if t in (NORMAL, UNUSED)}
        self.byte_of = {i: b for b, i in model.bytes.items()}

    def split(self, text: str) -> list[str]:
        """Marked words: no piece reaches over a mark that follows another character, nor over what ``Model.opening`` tells."""
        if not text:
            return []
        marked = (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        return self._words.findall(marked)

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        split = [self.split(t or "") for t in texts]
        words = set(chain.from_iterable(split))
        fresh = words.difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, self.older = {}, self.known
            fresh = words
        if self.older:
            again = fresh.intersection(self.older)
            self.known.update((w, self.older[w]) for w in again)
            fresh = fresh.difference(again)
        self.known.update(self.model.encode_sorted(sorted(fresh)))
        for words in split:
            yield np.fromiter(chain.from_iterable(map(self.known.__getitem__, words)), np.int32)

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; bytes that are no text become U+FFFD, control ids nothing, unknown ids a mark of the unknown."""
        text = self.decode_pieces(ids)
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def decode_pieces(self, ids: Sequence[int]) -> str:
        """The same with the space that the model puts before a text."""
        try:
            return "".join(map(self.text_of.__getitem__, ids))
        except KeyError:  # bytes, unknown or control ids
            pass
        out, held = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.text_of.get(i, " ⁇ " if i == self.model.unk else ""))
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)


_ENCODERS: dict[bytes, Encoder] = {}


def encoder_of(data: bytes) -> Encoder:
    """The worker's encoder for a model file: later tasks of the worker find its words."""
    key = hashlib.sha256(data).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Model(data))
    return _ENCODERS[key]


def _batches(column: pa.Array, size: int = 2000) -> Iterator[list[str | None]]:
    for at in range(0, len(column), size):
        yield column.slice(at, size).to_pylist()


def encoded_rows(encoder: Encoder, texts: list[str | None], check: bool) -> list[pa.Array]:
    """``n_tokens``, ``ids`` and, with ``check``, ``round_trip``: whether each row of ``ids``, as it stands in the array, decodes to its text."""
    ids = list(encoder.encode_batch(texts))
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    rows = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
    columns = [pa.array(np.diff(offsets).astype(np.int64)), rows]
    if check:
        columns.append(pa.array([encoder.decode(rows[i].values.to_numpy().tolist()) == (t or "") for i, t in enumerate(texts)], pa.bool_()))
    return columns


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, check: bool = True, viterbi: bool = True) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and, with ``check``, ``round_trip`` (decoding gives the text back) per row.

    Null and empty texts have no ids; texts and words of any length are encoded whole; repeated rows give repeated results.
    U+2581 in a text is the model's own mark for a space and is read as one, so such a text has no round trip.
    ``viterbi``: whether a BPE model is read as ``unigram_reading`` tells, or applied by its merges.
    The model's bytes are read on the driver and travel with the task, so executors need no file.
    """
    with open(model_path or default_model(docs.sparkSession), "rb") as f:
        data = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(unigram_reading(data) if viterbi else data)

    def run(batches: Iterator[pa.RecordBatch]):
        encoder = encoder_of(sent.value)
        for batch in batches:
            at = 0
            for texts in _batches(batch.column(1)):
                columns = [batch.column(0).slice(at, len(texts)), *encoded_rows(encoder, texts, check)]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "round_trip"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>" + ", round_trip boolean" * check)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """``doc_id``, ``text`` for rows of ids; null ids give null."""
    with open(model_path or default_model(encoded.sparkSession), "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]):
        encoder = encoder_of(sent.value)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
