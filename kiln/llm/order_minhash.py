"""MinHash near-duplicates by order min-hash (operator 10).

A text is the sequence of its 5-word shingles, each labelled with how many
equal ones came before. A sketch takes the ``TAKEN`` shingles with the least
seeded hashes and hashes them in text order, so it agrees for texts that share
these shingles in the same order; ``SKETCHES`` sketches with different seeds
give the candidates. A candidate pair is verified by banded alignment of the
two shingle sequences: the most shingles that match in order within the band
that a similarity of ``SIMILARITY`` leaves, over the shingles of either text.
Two texts of more than ``SHORT`` shingles at similarity 0.8 share a sketch with
probability 0.998 or more (0.9998 for long ones). A text of ``LEAST`` to ``SHORT``
shingles has keys besides, its sequence and the sequence without each one of its shingles:
two such texts at 0.8 differ by at most one shingle each, so they share a key for certain;
shorter ones are equal.

Equal word sequences become one node first. Each member of a bucket is compared
with the bucket's least node, and connected components of these links settle
most buckets; where a bucket still spans several components, its members outside
the largest one are compared, block by block, with all members of the other
components, so no link inside a bucket is lost and no pair list is written.

Words are runs of characters other than space and tab..carriage return, with A-Z
lower-cased. Defined cases: a text of fewer than five words is one shingle; null
and empty texts are equal texts; a null id takes part, and a class's id is its
least id that is not null (null if there is none); rows that repeat an id are
rows of their own; an empty table gives an empty result; other columns are
neither read nor used (``keep`` carries them along).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kiln.llm import arrays as A
from kiln.llm.common import bounded, read, ship, stored, text_or_empty, whole_row
from kiln.llm.graph import connected_components

WORDS, SIMILARITY = 5, 0.8
SKETCHES, TAKEN = 16, 4
#: Texts of so many shingles get exact keys: fewer than the least must be equal, more
#: than the most may differ by two shingles.
LEAST, SHORT = 4, 9
#: Nodes of a bucket that one group compares with as many others.
BLOCK = 512

_FEW = 10 * TAKEN


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    data, offsets = A.utf8(texts)
    data = A.LOWER[data]
    starts, ends, row = A.words(data, offsets)
    return A.span_hasher(data)(starts, ends), row, len(offsets) - 1


def _firsts(row: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(n + 1))


def sketch(value: np.ndarray, row: np.ndarray, n: int, sketches: int = SKETCHES, taken: int = TAKEN) -> np.ndarray:
    """(n, sketches) order min-hashes of the labelled shingles of n texts."""
    bounds = _firsts(row, n)
    size = np.diff(bounds)
    out = np.zeros((n, sketches), np.uint64)
    # enough shingles lie below this share of the hash range in nearly every text
    part = np.minimum(_FEW / np.maximum(size, 1), 1.0)
    below = np.minimum(part, 0.5) * 2.0**64 * (1 - 1e-9)
    limit = np.where(part > 0.5, np.uint64(2**64 - 1), below.astype(np.uint64))[row]
    for k in range(sketches):
        h = A.mix(value + np.uint64((k + 1) * 0xA24BAED4963EE407 % 2**64))
        low = h <= limit
        missing = np.bincount(row[low], minlength=n) < np.minimum(taken, size)
        if missing.any():
            low |= missing[row]
        at = np.flatnonzero(low)
        at = at[np.lexsort((h[at], row[at]))]
        of = row[at]
        begin = np.ones(len(at), bool)
        begin[1:] = of[1:] != of[:-1]
        place = np.arange(len(at))
        rank = place - np.maximum.accumulate(np.where(begin, place, 0))
        at = np.sort(at[rank < taken])
        of = row[at]
        begin = np.ones(len(at), bool)
        begin[1:] = of[1:] != of[:-1]
        place = np.arange(len(at))
        rank = place - np.maximum.accumulate(np.where(begin, place, 0))
        for r in range(taken):
            pick = rank == r
            out[of[pick], k] = A.mix(out[of[pick], k] * np.uint64(0x9FB21C651E98DF25) + value[at[pick]] + np.uint64(r + 1))
        out[:, k] = A.mix(out[:, k] + np.uint64(k + 1))
    return out


def short_keys(value: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): of each text of ``LEAST`` to ``SHORT`` labelled shingles a hash
    of the sequence, and, above the least, of the sequence without each of its shingles."""
    bounds = _firsts(row, n)
    size = np.diff(bounds)
    keys, rows = [], []
    for k in range(LEAST, SHORT + 1):
        of = np.flatnonzero(size == k)
        if not len(of):
            continue
        whole = value[bounds[of][:, None] + np.arange(k)]
        for out in range(-1, k if k > LEAST else 0):
            h = np.full(len(of), 0x2545F4914F6CDD1D, np.uint64)
            for j in range(k):
                if j != out:
                    h = A.mix(h * np.uint64(0x9FB21C651E98DF25) + whole[:, j])
            keys.append(h)
            rows.append(of)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def _sequence_hash(word: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each text's words in order."""
    bounds = _firsts(row, n)
    place = (np.arange(len(word)) - bounds[row]).astype(np.uint64)
    out = []
    for salt in (0x632BE59BD9B4E019, 0x9E6C63D0876A9A47):
        each = A.mix(word ^ A.mix(place + np.uint64(salt)))
        total = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(each, out=total[1:])
        out.append(A.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).astype(np.int64))
    return out[0], out[1]


def _sketched(docs: DataFrame) -> DataFrame:
    """(id, t1, t2, h1, h2, sketches) of rows (id, text): hashes of the text and
    of its word sequence, and its order min-hashes."""
    ship(docs.sparkSession)
    picked = docs.select("id", F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in A.chunks(texts):
                word, row, n = _word_hashes(texts.slice(lo, hi - lo))
                h1, h2 = _sequence_hash(word, row, n)
                value, of = A.shingles(word, row, WORDS)
                exact, whose = short_keys(value, of, n)
                found = np.concatenate([sketch(value, of, n).ravel(), exact]).astype(np.int64)
                owner = np.concatenate([np.repeat(np.arange(n), SKETCHES), whose])
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found[np.argsort(owner, kind="stable")]))
                keep = [batch.column(c).slice(lo, hi - lo) for c in ("id", "t1", "t2")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(h1), pa.array(h2), lists], names=["id", "t1", "t2", "h1", "h2", "sketches"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, t1 long, t2 int, h1 long, h2 long, sketches array<long>")


def _words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, words): 32-bit word hashes, little-endian, of the wanted nodes
    (node, id, t1, t2)."""
    to = wanted.select("node", F.col("id").alias("w_id"), F.col("t1").alias("w_t1"), F.col("t2").alias("w_t2"))
    texts = docs.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.hash("text")).join(
        bounded(to), F.col("id").eqNullSafe(F.col("w_id")) & (F.col("t1") == F.col("w_t1")) & (F.col("t2") == F.col("w_t2")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in A.chunks(texts):
                word, row, n = _word_hashes(texts.slice(lo, hi - lo))
                short, bounds = (word >> np.uint64(32)).astype("<u4"), _firsts(row, n)
                raw = [short[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), pa.array(raw, pa.binary())], names=["node", "words"])

    return (texts.select("node", "text").mapInArrow(run, "node long, words binary")
            .groupBy("node").agg(F.first("words").alias("words")))


def _labelled(raws: list[bytes]) -> list[np.ndarray]:
    """The labelled shingles of each word sequence, in text order."""
    sizes = np.fromiter(map(len, raws), np.int64, len(raws)) >> 2
    word = A.mix(np.frombuffer(b"".join(raws), "<u4").astype(np.uint64))
    row = np.repeat(np.arange(len(raws)), sizes)
    value, of = A.shingles(word, row, WORDS)
    return np.split(value, np.searchsorted(of, np.arange(1, len(raws))))


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Banded alignment of two labelled shingle sequences. A label occurs once
    in a sequence, so the matches in order are an increasing run of places."""
    both = len(a) + len(b)
    if not both:
        return True
    need = int(np.ceil(similarity * both / (1 + similarity) - 1e-9))
    if min(len(a), len(b)) < need:
        return False
    _, pa_, pb = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    pb = pb[np.argsort(pa_)]
    pa_ = np.sort(pa_)
    near = np.abs(pa_ - pb) <= both - 2 * need
    pb = pb[near]
    if len(pb) < need:
        return False
    if (np.diff(pb) > 0).all():
        return True
    ends: list[int] = []
    for p in pb.tolist():
        i = bisect_left(ends, p)
        ends[i:i + 1] = [p]
    return len(ends) >= need


def _links(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) that the alignment confirms."""
    left = words.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n = part.num_rows
                seq = _labelled(part.column("wa").to_pylist() + part.column("wb").to_pylist())
                yield part.select(["a", "b"]).filter(pa.array([aligned(seq[i], seq[n + i]) for i in range(n)], pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _block_links(group: pa.Table) -> list[tuple[int, int]]:
    """Links across components among the rows of one group: first those pairs
    whose common shingles suffice, counted for all at once, then the alignment
    until their components are joined."""
    node, comp, side = (group[c].to_numpy() for c in ("node", "comp", "side"))
    seq = _labelled(group["words"].to_pylist())
    size = np.array([len(s) for s in seq])
    flat = np.concatenate(seq)
    _, label, count = np.unique(flat, return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(seq)), size)
    shared = count[label] > 1
    label, of = label[shared], of[shared]
    dense = np.unique(label, return_inverse=True)[1] if len(label) else label
    left, right = (side == 0, side == 1) if (side == 1).any() else (side == 0, side == 0)
    li, ri = np.flatnonzero(left), np.flatnonzero(right)
    common = np.zeros((len(li), len(ri)), np.float32)
    for lo in range(0, int(dense.max(initial=-1)) + 1, 4096):
        pick = (dense >= lo) & (dense < lo + 4096)
        m = np.zeros((len(seq), 4096), np.float32)
        m[of[pick], dense[pick] - lo] = 1
        common += m[li] @ m[ri].T
    both = size[li][:, None] + size[ri][None, :]
    near = (common * (1 + SIMILARITY) >= SIMILARITY * both - 1e-3) & (comp[li][:, None] != comp[ri][None, :])
    root = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(near)):
        a, b = li[i], ri[j]
        x, y = find(int(comp[a])), find(int(comp[b]))
        if x != y and aligned(seq[a], seq[b]):
            root[x] = y
            out.append((int(node[a]), int(node[b])))
    return out


def _rest(members: DataFrame, components: DataFrame, words: DataFrame, block: int) -> DataFrame:
    """Links in buckets (key, node) that still span several components."""
    placed = (members.join(components, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp")))
    per = stored(placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")), "omh-spans")
    open_ = (per.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("all"))
             .where("comps > 1").select("key", F.col("most.comp").alias("main"), F.ceil(F.col("most.n") / block).cast("int").alias("mains"),
                                        F.ceil((F.col("all") - F.col("most.n")) / block).cast("int").alias("others")))
    rows = placed.join(stored(open_, "omh-open"), "key")
    chunk = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    task = lambda kind, p, q, side: F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"), side.alias("side"))
    o, m = chunk(F.col("others")), chunk(F.col("mains"))
    all_others, all_mains = F.sequence(F.lit(0), F.col("others") - 1), F.sequence(F.lit(0), F.col("mains") - 1)
    zero, one = F.lit(0), F.lit(1)
    outside = F.concat(
        F.transform(all_others, lambda x: task(0, F.least(o, x), F.greatest(o, x), F.when(o > x, one).otherwise(zero))),
        F.transform(all_mains, lambda x: task(1, o, x, zero)))
    inside = F.transform(all_others, lambda x: task(1, x, m, one))
    tasks = rows.select("key", "node", "comp", F.explode(F.when(F.col("comp") == F.col("main"), inside).otherwise(outside)).alias("t"))
    tasks = (tasks.select("key", "t.kind", "t.p", "t.q", "t.side", "node", "comp").join(words, "node")
             .repartition("key", "kind", "p", "q").sortWithinPartitions("key", "kind", "p", "q", "side", "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("key", "kind", "p", "q")
        for table in A.whole_groups(batches, keys):
            at = np.stack([table[k].to_numpy() for k in keys], 1)
            starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(1)]))
            out = []
            for lo, hi in zip(starts, np.append(starts[1:], len(at))):
                if hi - lo > 1:
                    out += _block_links(table.slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return tasks.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, t1, t2, class_id) of every input row; t1, t2 are hashes of the text."""
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("string").alias("text"))
    rows = stored(_sketched(texts), "omh-rows")
    nodes = stored(rows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.min(F.struct("id", "t1", "t2")).alias("any"),
                                                 F.first("sketches").alias("sketches"))
                   .withColumn("node", F.monotonically_increasing_id()), "omh-nodes")
    # equal sketches of different seeds differ, as the seed is hashed in
    keyed = nodes.select("node", F.explode("sketches").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a"),
                    "omh-buckets")
    members = stored(keyed.join(shared, "key").select("key", "a", "node"), "omh-members")
    wanted = stored(nodes.join(members.select("node").distinct(), "node").select("node", "any.*"), "omh-wanted")
    words = stored(_words_of(texts, wanted), "omh-words")
    pairs = members.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    links = stored(_links(pairs, words), "omh-links")
    components = stored(connected_components(links), "omh-components")
    more = stored(_rest(members.select("key", "node"), components, words, block), "omh-more")
    if more.count():
        both = components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
        components = stored(connected_components(both), "omh-components")
    named = stored(nodes.select("node", "h1", "h2", "least").join(components, "node", "left")
                   .select("h1", "h2", "least", F.coalesce("component", "node").alias("component")), "omh-named")
    least = named.groupBy("component").agg(F.min("least").alias("class_id"))
    answer = stored(named.join(least, "component").select("h1", "h2", "class_id"), "omh-answer")
    return rows.join(answer, ["h1", "h2"]).select("id", "t1", "t2", "class_id")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One input row of each class, with all its columns: the row whose id is
    the class's; of several rows with that id the first by text hash. Rows
    without an id stay if their class has none."""
    found = stored(classes(docs, id_col, text_col).groupBy("id", "t1", "t2", "class_id").agg(F.count(F.lit(1)).alias("n")),
                   "omh-classes")
    own = found.where("id = class_id")
    best = own.groupBy("id").agg(F.min(F.struct("t1", "t2", "n")).alias("best")).select("id", "best.*")
    again = best.where("n > 1").select("id", "t1", "t2", F.lit(True).alias("again"))
    gone = (found.where(~F.col("id").eqNullSafe(F.col("class_id"))).select("id", "t1", "t2")
            .unionByName(own.join(best, ["id", "t1", "t2"], "left_anti").select("id", "t1", "t2"))
            .withColumn("again", F.lit(False)).unionByName(again))
    gone = stored(gone.select(F.col("id").alias("g_id"), F.col("t1").alias("g_t1"), F.col("t2").alias("g_t2"), "again"), "omh-gone")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keyed = docs.select(whole_row(docs).alias("row"), docs[id_col].alias("id"),
                        F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"))
    met = keyed.join(bounded(gone), F.col("id").eqNullSafe(F.col("g_id")) & (F.col("t1") == F.col("g_t1")) & (F.col("t2") == F.col("g_t2")),
                     "left")
    one = (met.where("again").withColumn("k", F.row_number().over(Window.partitionBy("id", "t1", "t2").orderBy(F.xxhash64("row"))))
           .where("k = 1").select("row.*"))
    return met.where("again IS NULL").select("row.*").unionByName(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))
