"""Quality rules by repetition coverage (operator 4).

Rolling hashes of word n-grams of several lengths, computed in numpy over the
text buffers of whole Arrow batches, mark the n-grams and lines that a text
repeats; the share of its characters inside them decides. Texts are rows, so
the operator is one pass without a shuffle.

Defined cases: a null or empty text has no words and fails the base rule; a
null id is kept as null; repeated rows are judged one by one; an empty table
gives an empty result; other columns of the input are neither read nor used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm import arrays as A
from kiln.llm.common import read, ship

# Largest accepted share of a text's word characters inside later occurrences
# of repeated word n-grams, by n-gram length.
NGRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
# The same for lines that repeat an earlier line.
LINE_LIMIT = 0.30
MIN_WORDS = 50

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
          "dup_line_chars", "dup_ngram_chars")
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, dup_line_chars long, dup_ngram_chars long")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ROLL = np.uint64(0xD6E8FEB86659FD93)


def _covered(marked: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside a marked window of n words."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, marked, 1)
    np.subtract.at(edge, marked + n, 1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: pa.Array, ngram_limits: dict[int, float] = NGRAM_LIMITS,
            line_limit: float = LINE_LIMIT) -> dict[str, np.ndarray]:
    """The rule values of every text of one chunk, by column name."""
    data, offsets = A.utf8(texts)
    n = len(offsets) - 1
    spans, points = A.span_hasher(data), A.code_points(data)
    starts, ends, row = A.words(data, offsets)
    size = len(starts)
    chars = points[ends] - points[starts]
    out = {"n_words": np.bincount(row, minlength=n).astype(np.int64),
           "word_chars": np.bincount(row, chars, minlength=n).astype(np.int64),
           "n_symbols": A.per_row(_SYMBOL[data], offsets)}

    in_row = lambda r: A.mix(r.astype(np.uint64) + np.uint64(1))
    ls, le, lrow = A.lines(data, offsets)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~A.SPACE[data], out=solid[1:])
    full = solid[le] > solid[ls]
    ls, le, lrow = ls[full], le[full], lrow[full]
    _, again = A.groups(spans(ls, le) ^ in_row(lrow))
    out["n_dup_lines"] = np.bincount(lrow[again], minlength=n).astype(np.int64)
    word_points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~A.SPACE[data] & ((data & 0xC0) != 0x80), out=word_points[1:])
    out["dup_line_chars"] = np.bincount(lrow[again], (word_points[le] - word_points[ls])[again],
                                        minlength=n).astype(np.int64)

    # rolling hash of the n words from each position; a window that repeats
    # at n + 1 words repeats at n, so each length looks at the survivors only
    word = spans(starts, ends)
    roll = word.copy()
    alive = np.arange(size)
    worst = np.zeros(n, np.int64)
    too_much = np.zeros(n, bool)
    out["n_repeat_words"] = np.zeros(n, np.int64)
    for length in range(2, max(ngram_limits) + 1):
        alive = alive[alive + length <= size]
        alive = alive[row[alive] == row[alive + length - 1]]
        roll[alive] = roll[alive] * _ROLL + word[alive + length - 1]
        if length < 3 or length not in (3, *ngram_limits):
            continue
        twice, again = A.groups(A.mix(roll[alive]) ^ in_row(row[alive]))
        if length == 3:
            inside = _covered(alive[twice], 3, size)
            out["n_repeat_words"] = np.bincount(row[inside], minlength=n).astype(np.int64)
        if length in ngram_limits:
            inside = _covered(alive[again], length, size)
            covered = np.bincount(row[inside], chars[inside], minlength=n).astype(np.int64)
            worst = np.maximum(worst, covered)
            too_much |= covered > ngram_limits[length] * out["word_chars"]
        alive = alive[twice]
    out["dup_ngram_chars"] = worst
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    too_much |= out["dup_line_chars"] > line_limit * out["word_chars"]
    out["kept"] = ~out["base_failed"] & ~too_much
    return out


def _measured(texts: pa.Array, ngram_limits: dict[int, float], line_limit: float) -> dict[str, np.ndarray]:
    parts = [measure(texts.slice(lo, hi - lo), ngram_limits, line_limit) for lo, hi in A.chunks(texts)]
    return {k: np.concatenate([p[k] for p in parts]) for k in FIELDS}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          ngram_limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """One row per input row: the id, the base values, the coverage and the verdict."""
    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = _measured(batch.column("text"), ngram_limits, line_limit)
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(values[k]) for k in FIELDS)],
                                                 names=["id", *FIELDS])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, text_col: str = "text", ngram_limits: dict[int, float] = NGRAM_LIMITS,
         line_limit: float = LINE_LIMIT) -> DataFrame:
    """The input rows that the rules accept, with all their columns."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    # plain names on the way through Arrow, whatever the columns are called
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_measured(batch.column(at), ngram_limits, line_limit)["kept"]))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
