"""Packing along a space-filling curve (operator 2).

A document's token ids are hashed into a signed vector, projected to a few
dimensions and placed on a Hilbert curve. Documents are range-sorted by that
key and laid end to end, so a sequence holds neighbours on the curve; cuts fall
every ``length`` ids and the last, shorter stretch is cut into sequences whose
lengths are powers of two, so no sequence needs padding.

Only (row, token count, key) is sorted; the ids are written once and meet their
place in one join. Equal keys (copies) are spread by a hash of the id, so a
group of copies is many range partitions.

Defined cases: a null or empty text is the end id alone; rows that repeat an id
are packed one by one (their pieces carry the same id); a null id is kept; an
empty table gives no pieces; other columns are neither read nor used.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm import arrays as A
from kiln.llm.common import read, ship, stored

LENGTH = 2048
END_ID = 1
#: Hashed vector size, dimensions of the curve and bits of each.
VECTOR, DIMENSIONS, BITS = 256, 4, 12
#: Distinct words whose ids a worker remembers; others are encoded each time.
REMEMBERED = 400_000
TEXT_BYTES = 10_000_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    return Encoder(path)


class Encoder:
    """Token ids of whole texts. White space never is part of a token of the
    word tokenizer, so a text's ids are those of its words one after another,
    and a word's ids are looked up once. The tokenizer lower-cases, and it
    parts letters from marks: a word of ASCII letters before full stops or
    commas is looked up by its small letters, the marks by themselves."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.known: dict[str, bytes] = {}

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(self.known) < REMEMBERED:
            self.known[word] = ids
        return ids

    def _ids(self, words: list[str]) -> list[bytes]:
        get = self.known.get
        out = [get(w) for w in words]
        rest = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            w = words[i]
            core = w.rstrip(".,")
            if not (core.isalpha() and core.isascii()):
                rest.append(i)
                continue
            small = core.lower()
            ids = get(small)
            if ids is None:
                ids = self._keep(small, np.array([t.id for t in self.model.tokenize(small)], "<u4").tobytes())
            if len(core) != len(w):
                marks = w[len(core):]
                ids = ids + (get(marks) or self._encode([marks])[0])
            out[i] = ids if small == w else self._keep(w, ids)
        for i, ids in zip(rest, self._encode([words[i] for i in rest])):
            out[i] = ids
        return out

    def _encode(self, words: list[str]) -> list[bytes]:
        found = self.whole.encode_batch_fast(words, add_special_tokens=False)
        return [self._keep(w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(words, found)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = split.flatten().dictionary_encode()
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        index = words.indices.to_numpy()
        ids = self._ids(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), "<u4")
        first = np.cumsum(sizes) - sizes
        each = sizes[index]
        ends = np.zeros(len(each) + 1, np.int64)
        np.cumsum(each, out=ends[1:])
        at = np.repeat(first[index] - ends[:-1], each) + np.arange(ends[-1])
        return flat[at], ends[bounds[1:]] - ends[bounds[:-1]]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of grid coordinates, by
    Skilling's transposition (2004)."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, counts: np.ndarray, vector: int = VECTOR, dimensions: int = DIMENSIONS,
               bits: int = BITS) -> np.ndarray:
    """Hilbert key of each document: signed feature hashing of its ids, unit
    length, a Gaussian projection, and each coordinate by its normal rank."""
    n = len(counts)
    h = A.mix(np.arange(int(ids.max(initial=0)) + 1, dtype=np.uint64) + np.uint64(0x51ED27))
    slot = (h % np.uint64(vector)).astype(np.int64)
    sign = np.where((h >> np.uint64(63)) == 0, 1.0, -1.0)
    at = np.repeat(np.arange(n) * vector, counts)
    at += slot[ids]
    v = np.bincount(at, sign[ids], minlength=n * vector).reshape(n, vector)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    plane = np.random.default_rng(20240801).standard_normal((vector, dimensions))
    rank = 1.0 / (1.0 + np.exp(-1.702 * (v / np.where(norm > 0, norm, 1.0)) @ plane))
    return hilbert(np.minimum((rank * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(row, id, ids, n, curve): ``ids`` are the document's ids with the end
    id, as compressed little-endian 32-bit numbers; ``row`` numbers input rows."""
    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, row = pa.Codec("zstd", 1), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in A.chunks(texts, TEXT_BYTES):
                ids, counts = encoder(path)(texts.slice(lo, hi - lo))
                ends = np.cumsum(counts)
                packed = [codec.compress(np.append(ids[e - c:e], np.uint32(end_id)).astype("<u4").tobytes(), asbytes=True)
                          for e, c in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + hi - lo)), batch.column("id").slice(lo, hi - lo),
                     pa.array(packed, pa.binary()), pa.array(counts + 1), pa.array(curve_keys(ids, counts))],
                    names=["row", "id", "ids", "n", "curve"])
                row += hi - lo

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"row long, id {kind}, ids binary, n long, curve long")


def _places(encoded: DataFrame) -> tuple[DataFrame, int]:
    """((row, at): where each row starts when rows lie end to end in curve
    order; the length of all). One number for each range partition, its total,
    passes the driver."""
    spark = encoded.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("id", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(ends - n), pa.array(ends), pa.array(np.full(len(n), part, np.int64))],
                names=["row", "at", "upto", "part"])
            at = int(ends[-1]) if len(ends) else at

    local = (encoded.select("row", "n", "curve", tie.alias("tie"))
             .repartitionByRange(parts, "curve", "tie", "row").sortWithinPartitions("curve", "tie", "row")
             .select("row", "n").mapInArrow(run, "row long, at long, upto long, part long"))
    local = stored(local, "packing-order")
    sums = sorted((r["part"], r["size"]) for r in local.groupBy("part").agg(F.max("upto").alias("size")).collect())
    before, total = [], 0
    for part, size in sums:
        before.append((part, total))
        total += size
    offsets = spark.createDataFrame(before, "part long, before long")
    return local.join(F.broadcast(offsets), "part").select("row", (F.col("at") + F.col("before")).alias("at")), total


def cuts(total: int, length: int = LENGTH) -> list[int]:
    """Bounds of the sequences that follow the last full one: powers of two, largest first."""
    at = total // length * length
    out = [at]
    for b in range(length.bit_length(), -1, -1):
        if (total - at) & (1 << b) and (total - out[0]) & (1 << b):
            out.append(out[-1] + (1 << b))
    return out


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start (ids of the document before it), length,
    ids (little-endian 32-bit), doc_tokens, sequence_id, offset in the sequence."""
    encoded = stored(encode(docs, path or tokenizer_path(), id_col, text_col, end_id), "packing-ids")
    places, total = _places(encoded.select("row", "id", "n", "curve"))
    tail = np.array(cuts(total, length), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            out = []
            for i, (raw, n, at) in enumerate(zip(batch.column("ids"), batch.column("n").to_pylist(), batch.column("at").to_pylist())):
                ids = codec.decompress(raw.as_buffer(), 4 * n, asbytes=True)
                begin = at
                while begin < at + n:
                    if begin < tail[0]:
                        sequence, first, stop = begin // length, begin // length * length, (begin // length + 1) * length
                    else:
                        k = int(np.searchsorted(tail, begin, side="right")) - 1
                        sequence, first, stop = int(tail[0]) // length + k, int(tail[k]), int(tail[k + 1])
                    stop = min(stop, at + n)
                    out.append((i, begin - at, stop - begin, ids[4 * (begin - at):4 * (stop - at)], n, sequence, begin - first))
                    begin = stop
            if out:
                doc, *rest = zip(*out)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(doc)), *(pa.array(c, k) for c, k in zip(rest, kinds))],
                    names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = encoded.schema["id"].dataType.simpleString()
    joined = encoded.join(places, "row").select("id", "ids", "n", "at")
    pieces = joined.mapInArrow(
        run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): each sequence's ids in order, little-endian 32-bit.
    A sequence has at most as many pieces as ids, so a group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h"))))
    return (pieces.groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id", F.unhex(F.array_join(F.col("parts.h"), "")).alias("ids")))


def digest(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(read(spark, sf_dir, "documents")))
