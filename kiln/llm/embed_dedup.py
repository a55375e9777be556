"""Embedding near-duplicates by random-hyperplane hashing (operator 7).

Equal vectors become one node with a count. Each node is hashed by the signs of
its products with random planes, in several tables; nodes that share a bucket
are compared exactly, and links lead to distributed connected components. A
bucket of more than ``BLOCK`` nodes is cut into blocks and compared block
against block, each in its own group; pairs are counted inside the group, in
the first table in which they meet, and only counts and one link per node leave.

The number of planes follows the number of nodes, so that a bucket holds a
handful of unrelated ones at every size, and the number of tables follows the
planes, so that a pair at the wanted cosine meets with probability ``RECALL``,
and closer pairs more surely (14 planes, 32 tables for 50,000 nodes at 0.95).

Defined cases: a vector that is null, empty or zero, or holds null, infinite or
NaN components, has no links and is its own component; vectors of different
lengths never link; rows that repeat an id are vectors of their own; a row
without an id takes part and is kept unless its component has an id; an empty
table gives an empty result; other columns are neither read nor used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.llm import arrays as A
from kiln.llm.common import read, ship, stored
from kiln.llm.graph import connected_components

COSINE = 0.95
#: Least probability that a pair at the wanted cosine shares a bucket.
RECALL = 0.9997
#: Unrelated nodes that a bucket is planned to hold.
CROWD = 4
#: Nodes of a bucket that one task compares with each other.
BLOCK = 1024


def plan(nodes: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(planes, tables) for a number of nodes."""
    count = max(8, math.ceil(math.log2(max(nodes, 1) / CROWD)))
    meet = (1 - math.acos(cosine) / math.pi) ** count
    return count, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def planes(size: int, count: int, tables: int) -> np.ndarray:
    return np.random.default_rng(7919 + size).standard_normal((size, tables * count))


def signatures(vectors: np.ndarray, count: int, tables: int) -> np.ndarray:
    """One hash per vector and table."""
    signs = (vectors @ planes(vectors.shape[1], count, tables) > 0).reshape(len(vectors), tables, count)
    return (signs * (1 << np.arange(count))).sum(2)


def _usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, float64 matrix) for each vector length among the usable vectors."""
    column = column.cast(pa.large_list(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column)
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        m = values[(ends[rows] - size)[:, None] + np.arange(size)]
        with np.errstate(over="ignore", invalid="ignore"):
            good = np.isfinite(m).all(1) & (np.abs(m).max(1) > 0)
        yield rows[good], m[good]


def _units(raw: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision) by length, from binary columns of ``kind``."""
    sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        m = np.frombuffer(b"".join(raw.take(pa.array(rows)).to_pylist()), kind).reshape(len(rows), -1).astype(np.float64)
        m = m / np.abs(m).max(1, keepdims=True)
        yield rows, m / np.linalg.norm(m, axis=1, keepdims=True)


def _pairs(run: np.ndarray, block: np.ndarray, inside: np.ndarray, m: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs within runs of equal group numbers; in a group of two
    blocks only pairs across them count."""
    left, right = [], []
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    sizes = np.diff(np.append(starts, len(run)))
    for s, n in zip(starts[sizes > 64], sizes[sizes > 64]):
        part = m[s:s + n]
        hit = np.triu(part @ part.T >= cosine, 1)
        if not inside[s]:
            hit &= block[s:s + n, None] != block[None, s:s + n]
        i, j = np.nonzero(hit)
        left.append(i + s)
        right.append(j + s)
    small = np.repeat(sizes <= 64, sizes)
    for d in range(1, int(sizes[sizes <= 64].max(initial=0))):
        i = np.flatnonzero(small[:-d] & (run[d:] == run[:-d]) & (inside[:-d] | (block[d:] != block[:-d])))
        for k in range(0, len(i), 100_000):
            part = i[k:k + 100_000]
            part = part[np.einsum("ij,ij->i", m[part], m[part + d]) >= cosine]
            left.append(part)
            right.append(part + d)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _compare(group: pa.Table, kind: str, cosine: float, count: int, tables: int) -> pa.RecordBatch:
    """(a, b, links): the links counted for node a, or a link from a to b."""
    node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
    block, inside = group["block"].to_numpy(), group["p"].to_numpy() == group["q"].to_numpy()
    key = np.stack([group[c].to_numpy() for c in ("bucket", "p", "q")], 1)
    run = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(1))])
    table = (key[:, 0] >> count) % tables
    parts = []
    for rows, m in _units(group["v"].combine_chunks(), kind):
        i, j = _pairs(run[rows], block[rows], inside[rows], m, cosine)
        if not len(i):
            continue
        used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        sig = signatures(m[used], count, tables)
        si, sj = back[:len(i)], back[len(i):]
        i, j = rows[i], rows[j]
        fresh = np.ones(len(i), bool)
        for t in range(int(table[i].max())):
            fresh &= (sig[si, t] != sig[sj, t]) | (t >= table[i])
        links = np.zeros(len(node), np.int64)
        np.add.at(links, i[fresh], copies[j[fresh]])
        np.add.at(links, j[fresh], copies[i[fresh]])
        root = np.arange(len(node))
        while True:
            low = np.minimum(root[i], root[j])
            if (root[i] == low).all() and (root[j] == low).all():
                break
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
        counted, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(node)))
        parts.append((np.concatenate([node[counted], node[moved]]), np.concatenate([node[counted], node[root[moved]]]),
                      np.concatenate([links[counted], np.zeros(len(moved), np.int64)])))
    a, b, n = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*parts) if parts else ([], [], [])))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "links"])


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
         recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_links, component_id (least id of the
    component) and kept (whether that is the row's own id)."""
    spark = vectors.sparkSession
    ship(spark)
    picked = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    id_kind = picked.schema["id"].dataType.simpleString()
    # single-precision input is carried as it is; all sums are in double precision
    kind = "<f4" if picked.schema["vector"].dataType == T.ArrayType(T.FloatType()) else "<f8"

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = [None] * batch.num_rows
            for rows, m in _usable(batch.column("vector")):
                for r, x in zip(rows, m + 0.0):  # + 0.0: a negative zero is a zero
                    out[r] = x.astype(kind).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "v"])

    rows = stored(picked.mapInArrow(raw, f"id {id_kind}, v binary")
                  .select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("salt"), "v").alias("h2")), "vectors")
    nodes = stored(rows.where("v IS NOT NULL").groupBy("h1", "h2")
                   .agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
                   .withColumn("node", F.monotonically_increasing_id()), "vector-nodes")

    count, tables = plan(nodes.count(), cosine, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, m in _units(batch.column("v"), kind) if batch.num_rows else ():
                key = (signatures(m, count, tables) + (np.arange(tables) << count)
                       + (m.shape[1] * tables << count))
                node = batch.column("node").to_numpy()[part]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, tables)), pa.array(key.astype(np.int64).ravel())],
                                                 names=["node", "bucket"])

    placed = stored(nodes.select("node", "v").mapInArrow(hashed, "node long, bucket long"), "vector-buckets")
    full = stored(placed.groupBy("bucket").count().where("count > 1")
                  .select("bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "vector-full")
    met = (placed.join(full, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("bucket", "node", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
           .join(nodes.select("node", "v", "copies"), "node"))
    met = met.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "node")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in A.whole_groups(batches, ("bucket", "p", "q")):
            yield _compare(group, kind, cosine, count, tables)

    found = stored(met.mapInArrow(compared, "a long, b long, links long"), "vector-links")
    counts = found.groupBy(F.col("a").alias("c_node")).agg(F.sum("links").alias("n"))
    components = connected_components(found.select("a", "b"))
    own = (nodes.select("node", "h1", "h2", "copies", "least").join(components, "node", "left")
           .withColumn("component", F.coalesce("component", "node"))
           .join(counts, F.col("node") == F.col("c_node"), "left"))
    own = stored(own.select("h1", "h2", "component", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
                 "vector-result")
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = stored(own.join(least, "component").select("h1", "h2", "n_links", "component_id"), "vector-answer")
    usable = F.col("v").isNotNull()
    return (rows.select("id", "h1", "h2", usable.alias("usable"))
            .join(answer.withColumn("found", F.lit(True)),
                  (rows["h1"] == answer["h1"]) & (rows["h2"] == answer["h2"]) & F.col("usable"), "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("found"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "embeddings"))
