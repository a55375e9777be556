"""Language-model scores by context-tree weighting (operator 5).

A text is its UTF-8 bytes and one end byte; each byte is eight binary decisions,
and a decision's context is the bits of its byte so far and the ``depth`` bytes
before it (``DEPTH``, at most 6: a run of a context and its byte is one 64-bit
code, nearest byte first, so that the contexts of any depth are ranges of the sorted codes). Every node of the context tree keeps Krichevsky-Trofimov counts of
the training texts. Bottom-up, a node's weighted probability is the mean of its
own estimate and the product of its children's; top-down, the posterior weights
mix the estimates of all depths into one probability for each decision.

The corpus is cut into blocks of whole texts. One pass counts the (context,
byte) runs and words that each block holds, and packs them by deal, a hash of the three
bytes before the byte: sorted keys as differences, with their counts, in one compressed row. Grouped by deal, sums
give the corpus's counts; the tree from its deepest level up to the third is
evaluated inside a deal, in slices of whole three-byte contexts, and sums by the last two bytes and then
the last one give the upper levels. Each block then gets back the
probabilities and counts of just the runs and words it holds, again one packed row for each deal,
and its texts are scored against them. Only levels 1 and 0 of the tree pass the
driver: at most 256 * 255 nodes.

The base score is the add-one unigram model over words and one end token.
Words are compared by 64-bit hashes.

Defined cases: a null text is empty and has the end token only; a null id counts
as training; rows that repeat an id are texts of their own; with no training
text all counts are 0; an empty table gives an empty result; other columns are
neither read nor used.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm import arrays as A
from kiln.llm.common import read, ship, stored, text_or_empty

#: Context bytes.
DEPTH = 5
#: Deeper runs do not fit a signed 64-bit code.
MAX_DEPTH = 6
#: Stands before and after each text; no UTF-8 text holds it.
EDGE = 0xFF
BLOCK_BYTES = 32_000_000
RUN, WORD = 0, 1
#: Into how many deals the runs, and the words, of the corpus are split.
DEALS = 256
#: Runs of a deal that are evaluated at once, but for a longer three-byte context.
SLICE = 100_000
#: Log10 probabilities travel as multiples of this.
UNIT = 2.0**-40


def runs(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, row) for every byte and end byte: the ``depth`` bytes before it,
    the nearest highest, and the byte itself, as 64 bits."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    starts = offsets[:-1] + np.arange(n) * (depth + 1) + depth
    x = np.full(len(data) + n * (depth + 1) + 1, EDGE, np.int64)
    row = np.repeat(np.arange(n), sizes + 1)
    inner = np.repeat(starts - offsets[:-1], sizes) + np.arange(len(data))
    x[inner] = data
    at = np.repeat(starts - offsets[:-1] - np.arange(n), sizes + 1) + np.arange(len(row))
    code = x[at]
    for k in range(1, depth + 1):
        code |= x[at - k] << (8 * (depth - k + 1))
    return code, row


def deal(keys: np.ndarray, kind: int, depth: int) -> np.ndarray:
    """The deal of runs, by the three nearest bytes, or of hashed words."""
    return (A.mix((keys >> (8 * (depth - 2)) if kind == RUN else keys).astype(np.uint64)) % np.uint64(DEALS)).astype(np.int64)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series at x + 8."""
    y = x + 8.0
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - shift


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of counts under the Krichevsky-Trofimov estimate."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - 1.1447298858494002


def _mixed(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, children) - np.log(2.0)


def _stop(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Posterior weight of a node's own estimate."""
    return 1.0 / (1.0 + np.exp(np.clip(children - own, -700, 700)))


def _decisions(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, bit), each (runs, 8): the place of a decision in the byte's tree, and its outcome."""
    symbol = (code & 0xFF).astype(np.int64)[:, None]
    k = np.arange(8)
    return (1 << k) | (symbol >> (8 - k)), (symbol >> (7 - k)) & 1


def _level(context: np.ndarray, node: np.ndarray, bit: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node keys, index of each decision, zeros, ones) of one depth."""
    keys, at = np.unique((context[:, None] << 8) | node, return_inverse=True)
    at = at.reshape(node.shape)
    ones = np.bincount(at.ravel(), (count[:, None] * bit).ravel(), minlength=len(keys))
    both = np.bincount(at.ravel(), np.broadcast_to(count[:, None], node.shape).ravel(), minlength=len(keys))
    return keys, at, both - ones, ones


def _lower(code: np.ndarray, count: np.ndarray, depth: int):
    """Levels ``depth`` to 3 of the tree over runs that hold all of their level-3
    contexts, each (keys, index of each decision, zeros, ones, log probability of
    the children; none below the deepest)."""
    node, bit = _decisions(code)
    levels = []
    for d in range(depth, 2, -1):
        keys, at, zeros, ones = _level(code >> 8 * (depth - d + 1), node, bit, count)
        below = None
        if levels:
            deeper, _, z, o, children = levels[-1]
            own = kt(z, o)
            parent = np.searchsorted(keys, (deeper >> 16 << 8) | (deeper & 0xFF))
            below = np.bincount(parent, own if children is None else _mixed(own, children), minlength=len(keys))
        levels.append((keys, at, zeros, ones, below))
    return node, bit, levels


def third_level(code: np.ndarray, count: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(last two bytes, node, zeros, ones, log weighted probability) of level-3 nodes, summed by the last two bytes."""
    k3, _, z3, o3, below = _lower(code, count, depth)[2][-1]
    own = kt(z3, o3)
    keys, at = np.unique((k3 >> 16 << 8) | (k3 & 0xFF), return_inverse=True)
    weighted = own if below is None else _mixed(own, below)
    return keys >> 8, keys & 0xFF, *(np.bincount(at, v, minlength=len(keys)) for v in (z3, o3, weighted))


class Upper:
    """Levels 1 and 0 as dense tables: the mixture above level 2 is ``add[bit] + rest * (below)``."""

    def __init__(self, byte: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        z, o, b = (np.zeros((256, 256)) for _ in range(3))
        z[byte, node], o[byte, node], b[byte, node] = zeros, ones, below
        own1 = kt(z, o)
        z0, o0 = z.sum(0), o.sum(0)
        w0 = _stop(kt(z0, o0), _mixed(own1, b).sum(0))
        w1 = _stop(own1, b)
        one0, one1 = (o0 + 0.5) / (z0 + o0 + 1), (o + 0.5) / (z + o + 1)
        self.one = w0 * one0 + (1 - w0) * w1 * one1
        self.zero = w0 * (1 - one0) + (1 - w0) * w1 * (1 - one1)
        self.rest = (1 - w0) * (1 - w1)


class Second(NamedTuple):
    """Level-2 nodes by (last two bytes, node), sorted."""
    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    below: np.ndarray


def log10_probability(code: np.ndarray, count: np.ndarray, second: Second, upper: Upper, depth: int) -> np.ndarray:
    """Log10 probability of each run's last byte after the bytes before it."""
    node, bit, levels = _lower(code, count, depth)
    deep = None
    for _, at, zeros, ones, below in levels:
        one = (ones + 0.5) / (zeros + ones + 1)
        p = np.where(bit == 1, one[at], 1 - one[at])
        if deep is not None:
            stop = _stop(kt(zeros, ones), below)[at]
            p = stop * p + (1 - stop) * deep
        deep = p
    at = np.searchsorted(second.keys, (code >> 8 * (depth - 1))[:, None] << 8 | node)
    one = (second.ones + 0.5) / (second.zeros + second.ones + 1)
    stop = _stop(kt(second.zeros, second.ones), second.below)[at]
    deep = stop * np.where(bit == 1, one[at], 1 - one[at]) + (1 - stop) * deep
    byte = (code >> 8 * depth)[:, None]
    top = np.where(bit == 1, upper.one[byte, node], upper.zero[byte, node])
    return np.log10(top + upper.rest[byte, node] * deep).sum(1)


def slices(code: np.ndarray, depth: int) -> Iterator[slice]:
    """Runs of at most ``SLICE`` codes that do not cut a three-byte context, unless one is longer."""
    context = code >> 8 * (depth - 2)
    ends = np.append(np.flatnonzero(context[1:] != context[:-1]) + 1, len(code)) if len(code) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(code):
        k = max(int(np.searchsorted(ends, lo + SLICE, side="right")) - 1, int(np.searchsorted(ends, lo, side="right")))
        yield slice(lo, int(ends[k]))
        lo = int(ends[k])


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, train, blob): texts dealt into blocks of whole texts as they are
    read, each row a compressed Arrow stream of (id, held_out, text) and the number of its training texts."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))
    picked = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), text_or_empty(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            for lo, hi in A.chunks(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                data, _ = A.utf8(part.column("text"))
                if size and size + len(data) > BLOCK_BYTES:
                    block, size = block + 1, 0
                size += len(data)
                train = hi - lo - pc.sum(part.column("held_out")).as_py()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([train]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                                 names=["block", "train", "blob"])

    return picked.mapInArrow(run, "block long, train long, blob binary")


def _texts(blob: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob.as_buffer()).read_next_batch()


def _token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = A.LOWER[data]
    starts, ends, row = A.words(data, offsets)
    return A.span_hasher(data)(starts, ends).astype(np.int64), row


class _Counts:
    """Distinct keys with their training counts, merged as they grow."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.merged = 0

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        for part, weight in ((keys[train], 1), (keys[~train], 0)):
            if len(part):
                k, n = np.unique(part, return_counts=True)
                self.merge(k, n * weight)

    def merge(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.size += len(keys)
        if self.size > 2 * self.merged + 1_000_000:
            self.parts = [self.sums()]
            self.size = self.merged = len(self.parts[0][0])

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        n = np.concatenate([n for _, n in self.parts])
        return keys.astype(np.int64), np.bincount(at, n, minlength=len(keys)).astype(np.int64)


_HELD = "block long, kind int, deal long, n long, blob binary"


def _rows(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in columns.items()], names=list(columns))


_KINDS = {"kind": pa.int32(), "blob": pa.binary()}


def _held(blocks: DataFrame, depth: int) -> DataFrame:
    """(block, kind, deal, n, blob): what a block's texts hold, with training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, None

        def told() -> Iterator[pa.RecordBatch]:
            for kind in (RUN, WORD) if found else ():
                keys, n = found[kind].sums()
                place = deal(keys, kind, depth)
                order = np.argsort(place, kind="stable")
                keys, n, bounds = keys[order], n[order], np.searchsorted(place[order], np.arange(DEALS + 1)).tolist()
                some = [(d, lo, hi) for d, (lo, hi) in enumerate(zip(bounds, bounds[1:])) if hi > lo]
                yield _rows({"block": [at] * len(some), "kind": [kind] * len(some), "deal": [d for d, _, _ in some],
                             "n": [hi - lo for _, lo, hi in some], "blob": [A.pack(keys[lo:hi], n[lo:hi]) for _, lo, hi in some]}, _KINDS)

        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob")):
                if block != at:
                    yield from told()
                    at, found = block, {RUN: _Counts(), WORD: _Counts()}
                part = _texts(blob)
                texts, train = part.column("text"), ~part.column("held_out").to_numpy(zero_copy_only=False)
                data, offsets = A.utf8(texts)
                for kind, (keys, row) in ((RUN, runs(data, offsets, depth)), (WORD, _token_hashes(data, offsets))):
                    found[kind].add(keys, train[row])
        yield from told()

    return blocks.select("block", "blob").mapInArrow(run, _HELD)


def _sums(held: DataFrame) -> DataFrame:
    """(kind, deal, n, blob, total, seen): the corpus's counts, one row for each
    deal, their sum and how many are not 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, None

        def told() -> Iterator[pa.RecordBatch]:
            if found:
                keys, n = found.sums()
                yield _rows({"kind": [at[0]], "deal": [at[1]], "n": [len(keys)], "blob": [A.pack(keys, n)], "total": [int(n.sum())], "seen": [int((n > 0).sum())]}, _KINDS)

        for batch in batches:
            for *key, n, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "deal", "n")), batch.column("blob")):
                if key != at:
                    yield from told()
                    at, found = key, _Counts()
                found.merge(*A.unpack(blob, n))
        yield from told()

    placed = held.repartition("kind", "deal").sortWithinPartitions("kind", "deal")
    return placed.mapInArrow(run, "kind int, deal long, n long, blob binary, total long, seen long")


_NODES = ("zeros", "ones", "below")


def _levels(sums: DataFrame, depth: int) -> tuple[DataFrame, Upper]:
    """(deal, two, node, zeros, ones, below) of the level-2 nodes above each deal's runs, and the levels above."""
    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, n, blob in zip(batch.column("deal").to_pylist(), batch.column("n").to_pylist(), batch.column("blob")):
                code, count = A.unpack(blob, n)
                for some in slices(code, depth):
                    columns = third_level(code[some], count[some], depth)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), place)), *(pa.array(c) for c in columns)],
                                                     names=["deal", "two", "node", *_NODES])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two, node, z, o, below = (batch.column(c).to_numpy() for c in ("two", "node", *_NODES))
            columns = two >> 8, node, z, o, _mixed(kt(z, o), below)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["byte", "node", *_NODES])

    nodes = "node long, zeros double, ones double, below double"
    add = [F.sum(c).alias(c) for c in _NODES]
    below = stored(sums.where(F.col("kind") == RUN).select("deal", "n", "blob").mapInArrow(third, f"deal long, two long, {nodes}"), "lm-third")
    second = stored(below.groupBy("two", "node").agg(*add), "lm-second")
    rows = second.mapInArrow(first, f"byte long, {nodes}").groupBy("byte", "node").agg(*add).collect()  # levels 1 and 0: at most 256 * 255 nodes
    upper = Upper(*(np.array([r[i] for r in rows], np.int64 if i < 2 else np.float64) for i in range(5)))
    return below.select("deal", "two").distinct().join(second, "two"), upper


def _values(held: DataFrame, sums: DataFrame, second: DataFrame, upper: Upper, depth: int) -> DataFrame:
    """``held`` rows with the corpus's count of each word, or the log10
    probability of each run, in place of their own counts."""
    empty = lambda name, kind: F.lit(None).cast(kind).alias(name)
    shape = ["kind", "deal", "rank", "block", "two", "node", *_NODES, "n", "blob"]
    nodes = second.select("*", F.lit(RUN).alias("kind"), F.lit(0).alias("rank"), empty("block", "long"), empty("n", "long"), empty("blob", "binary"))
    none = [empty("two", "long"), empty("node", "long"), *(empty(c, "double") for c in _NODES)]
    whole = sums.select("kind", "deal", F.lit(1).alias("rank"), empty("block", "long"), *none, "n", "blob")
    rows = held.select("kind", "deal", F.lit(2).alias("rank"), "block", *none, "n", "blob")
    placed = (nodes.select(shape).unionByName(whole).unionByName(rows)
              .repartition("kind", "deal").sortWithinPartitions("kind", "deal", "rank", "block", "two", "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, keys, values = None, [], None, None
        for batch in batches:
            kind, place, rank = (batch.column(c).to_numpy() for c in ("kind", "deal", "rank"))
            for lo, hi in zip(*_ranges((place << 8) | (kind << 4) | rank)):
                if (kind[lo], place[lo]) != at:
                    at, parts = (kind[lo], place[lo]), []
                part = batch.slice(lo, hi - lo)
                if rank[lo] == 0:
                    two, node, *numbers = (part.column(c).to_numpy() for c in ("two", "node", *_NODES))
                    parts.append(((two << 8) | node, *numbers))
                    continue
                sizes, blobs = part.column("n").to_pylist(), part.column("blob")
                if rank[lo] == 1:
                    keys, values = A.unpack(blobs[0], sizes[0])
                    if kind[lo] == RUN:
                        second = Second(*(np.concatenate(c) for c in zip(*parts)))
                        found = [log10_probability(keys[s], values[s], second, upper, depth) for s in slices(keys, depth)]
                        values = np.round(-np.concatenate(found) / UNIT).astype(np.int64)
                    continue
                for block, n, blob in zip(part.column("block").to_pylist(), sizes, blobs):
                    mine = A.unpack(blob, n)[0]
                    yield _rows({"block": [block], "kind": [int(kind[lo])], "n": [n], "blob": [A.pack(mine, values[np.searchsorted(keys, mine)])]}, _KINDS)

    return placed.mapInArrow(run, "block long, kind int, n long, blob binary")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens,
    base_score, score and bits_per_byte (the model's code length, end byte included)
    of a tree of ``depth`` context bytes, 3 to 6."""
    if not 3 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 3 to {MAX_DEPTH}, not {depth}")
    ship(docs.sparkSession)
    blocks = stored(_blocks(docs, id_col, text_col), "lm-blocks")
    held = stored(_held(blocks, depth), "lm-held")
    sums = stored(_sums(held), "lm-sums")
    totals = sums.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("seen"), F.lit(0)).alias("v")).first()
    ends = blocks.agg(F.coalesce(F.sum("train"), F.lit(0))).first()[0]
    train_tokens, kinds = totals["n"] + ends, totals["v"] + (ends > 0)
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    both = (_values(held, sums, *_levels(sums, depth), depth)
            .unionByName(blocks.select("block", F.lit(2).alias("kind"), F.lit(None).cast("long").alias("n"), "blob"))
            .repartition("block").sortWithinPartitions("block", "kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = float(train_tokens + kinds + 1)
        at, parts, tables = None, {}, {}
        for batch in batches:
            for block, rank, n, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "n")), batch.column("blob")):
                if block != at:
                    at, parts, tables = block, {RUN: [], WORD: []}, {}
                if rank < 2:
                    parts[rank].append(A.unpack(blob, n))
                    continue
                if not tables:
                    for k, got in parts.items():
                        keys, values = (np.concatenate(c) for c in zip(*(got or [(np.zeros(0, np.int64),) * 2])))
                        order = np.argsort(keys)
                        tables[k] = keys[order], values[order] * (-UNIT if k == RUN else 1)
                    parts = {}
                yield from _scored(_texts(blob), tables, total, ends, train_tokens, depth)

    fields = ("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
    return both.mapInArrow(run, f"id {kind}, {fields}").withColumnRenamed("id", id_col)


def _ranges(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(ids)) if len(ids) else starts


def _scored(part: pa.RecordBatch, tables: dict, total: float, ends: int, train_tokens: int, depth: int) -> Iterator[pa.RecordBatch]:
    texts = part.column("text")
    for a, b in A.chunks(texts):
        n = b - a
        data, offsets = A.utf8(texts.slice(a, n))
        # each distinct run is looked up once, running through the table in order
        distinct, place = np.unique(runs(data, offsets, depth)[0], return_inverse=True)
        keys, values = tables[RUN]
        each = values[np.searchsorted(keys, distinct)][place]
        size = np.diff(offsets) + 1
        score_ = np.add.reduceat(each, np.cumsum(size) - size)
        word, of = _token_hashes(data, offsets)
        keys, values = tables[WORD]
        count = values[np.searchsorted(keys, word)] if len(word) else np.zeros(0)
        n_tokens = np.bincount(of, minlength=n) + 1
        n_known = np.bincount(of, count > 0, minlength=n).astype(np.int64) + int(ends > 0)
        base = np.bincount(of, np.log10((count + 1) / total), minlength=n) + np.log10((ends + 1) / total)
        cols = [pa.array(n_tokens.astype(np.int64)), pa.array(n_known), pa.array(np.full(n, train_tokens, np.int64)), pa.array(base), pa.array(score_),
                pa.array(-score_ / np.log10(2.0) / size)]
        yield pa.RecordBatch.from_arrays([part.column("id").slice(a, n), part.column("held_out").slice(a, n), *cols],
                                         names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
