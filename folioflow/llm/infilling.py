"""Fill-in-the-middle: texts cut between tokens into prefix, middle and suffix, and put together in another order.

A text becomes an array of its code points. Each has a class, letter (A-Z, a-z) or other; a token begins where a
code point is no letter or its class differs from its neighbour's before, so the places of ``flatnonzero`` are the
boundaries, and no regular expression walks the text. Two ranks among them, drawn from a hash of the id, are
the cuts. The pieces are slices of the array, encoded again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of a hundred texts as many are transformed, and of a hundred transformed ones as many begin with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Texts that are held as arrays and outputs at once.
AT_ONCE = 256
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Where tokens ``[A-Za-z]+|[^A-Za-z]`` begin."""
    letter = ((codes | 32) - np.uint32(97)) < 26
    begins = ~letter
    begins[1:] |= letter[1:] != letter[:-1]
    begins[:1] = True
    return np.flatnonzero(begins)


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """Four unsigned numbers of 32 bits from the seed and the id; a null id is hashed as an empty one."""
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(told[i : i + 8], 16) for i in (0, 8, 16, 24))


def infill(text: str, doc_id: int | None, seed: int = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """Number of tokens, form, code points of prefix and of middle (null where plain), and the output."""
    codes = code_points(text)
    starts = boundaries(codes)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= transformed or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(starts[rank]) if rank < n else len(codes) for rank in (first, second))
    prefix, middle, suffix = (codes[x:y].tobytes().decode("utf-32-le") for x, y in ((0, a), (a, b), (b, len(codes))))
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``SCHEMA``: a row for each row of ``docs``, with the whole output text.

    Null and empty texts give an empty plain output and no tokens. Texts that hold a mark stay plain, as their pieces couldn't be told
    apart. The cuts depend on id and text alone, so repeated rows are transformed alike and reruns agree; rows of
    one id with several texts are each cut in their own tokens. A text is one row's work, however long; its array
    takes four bytes a code point. No rows give no rows, and other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for part in (batch.slice(at, AT_ONCE) for batch in batches for at in range(0, batch.num_rows, AT_ONCE)):
            made = [(i, *infill(text or "", i, seed, transformed, suffix_first)) for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], t) for k, t in enumerate(types)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No piece holds a mark, so each mark is found where it was put."""
    between = lambda before, after: F.substring_index(F.substring_index(output, after, 1), before, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
    CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d
), c AS (
  SELECT *, len(w) AS n, CAST(least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS BIGINT) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w
), p AS (
  SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
