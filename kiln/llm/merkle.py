"""Merkle manifest of a dataset by nested-interval labels (operator 13).

Every row is a leaf. Within a part (a language) leaves are ranked in the order
of their ids; a tree node is labelled with the interval [lo, hi) of leaf ranks it covers, and
with its parent's interval, which follows from its own. Levels are taken in bands: nodes that share a
bucket (their ``lo`` divided by the width of the band's top) are hashed up to
that top together, so a band is one shuffle and a bucket holds at most ``arity ** levels`` nodes. Coming
down again, a containment join inside each bucket attaches to a node everything
that lies in an ancestor's interval but not in the interval of the ancestor's child on
the way down: the difference of the two intervals, the siblings that a
proof needs. A band's nodes then take over the path of the bucket's top from
the band above. The parts' roots are the leaves of one more tree of the same kind.

No rank, digest or proof passes the driver; it learns only the largest part's size,
which sets the number of bands. Ranks come from a range sort with a row number as the
last key, so rows equal in id, of whatever number, are spread over tasks.

Defined cases: a null field counts as ``-``; a null part and a null id sort
first; rows that repeat an id are leaves in the order of their digests; a row
with a null id is not tampered with, and a null field stays null under tampering;
a table of one row has that leaf as its root and an empty proof; an empty
table gives an empty result; other columns are neither read nor used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kiln.llm.common import read, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
#: Levels of a band: a bucket holds at most ARITY ** LEVELS nodes.
LEVELS = 6


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Sha-256 of the fields, each with its byte length before it."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def _ranked(leaves: DataFrame, name: str) -> DataFrame:
    """``leaves`` with ``lo``, their rank within ``part`` by (id, digest), and ``n``, the part's size."""
    order = [F.col("part").asc(), F.col("id").asc_nulls_first(), F.col("digest").asc(), F.col("tie").asc()]
    tasks = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(leaves.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()),
                    name).withColumn("task", F.shiftright("at", 33))
    # one row for each task and part that meet: at most tasks + parts rows
    sizes = placed.groupBy("part", "task").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = F.sum("rows").over(Window.partitionBy("part").orderBy("task")) - F.col("rows")
    sizes = sizes.select("part", "task", (before - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("part")).alias("n"))
    return placed.join(sizes, ["part", "task"]).withColumn("lo", F.col("at") + F.col("shift")).drop("at", "task", "shift", "tie")


def _chunks(nodes: Column, arity: int) -> Column:
    """The parents of a bucket's sorted nodes of one level."""
    def parent(i: Column) -> Column:
        run = F.slice(nodes, i * arity + 1, F.lit(arity))
        return F.struct(F.element_at(run, 1)["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"),
                        F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), ""), 256).alias("digest"))
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / arity).cast("int") - 1), parent)


def _band(nodes: DataFrame, low: int, levels: int, arity: int) -> DataFrame:
    """(part, n, bucket, level, lo, hi, digest) of all nodes of levels ``low`` to ``low + levels``."""
    top = arity ** (low + levels)
    found = nodes.groupBy("part", "n", F.floor(F.col("lo") / top).alias("bucket")).agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("lowest"))
    # a part whose level has one node has reached its root, which goes up as it is
    climbed = F.aggregate(
        F.sequence(F.lit(low), F.lit(low + levels - 1)), F.array("lowest"),
        lambda acc, level: F.concat(acc, F.array(F.when(F.col("n") > F.pow(F.lit(float(arity)), level).cast("long"), _chunks(F.element_at(acc, -1), arity))
                                                 .otherwise(F.element_at(acc, -1)))))
    return (found.select("part", "n", "bucket", F.posexplode(climbed).alias("step", "row"))
            .select("part", "n", "bucket", (F.col("step") + low).alias("level"), F.explode("row").alias("v")).select("part", "n", "bucket", "level", "v.*"))


def _height(arity: int, most: int) -> Column:
    """Levels above the leaves of a part of ``n`` leaves."""
    return sum(((F.col("n") > arity ** k).cast("int") for k in range(most)), F.lit(0))


def _steps(nodes: DataFrame, band: DataFrame, low: int, levels: int, arity: int, carried: Sequence[str]) -> DataFrame:
    """``nodes`` of level ``low`` with ``bucket`` and ``steps``: for each level
    of the band up to the part's root, the digests of the siblings to the left
    and to the right of the ancestor at that level."""
    width = F.pow(F.lit(float(arity)), F.col("level") + 1).cast("long")
    begin = F.col("lo") - F.col("lo") % width
    inner = (band.where((F.col("level") < low + levels) & (F.col("n") > F.pow(F.lit(float(arity)), F.col("level")).cast("long")))
             .select("part", "bucket", "level", F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"), begin.alias("p_lo"),
                     F.least(begin + width, "n").alias("p_hi"), F.col("digest").alias("s_digest")))
    mine = nodes.withColumn("bucket", F.floor(F.col("lo") / arity ** (low + levels)))
    me = mine.select("part", "n", "bucket", "lo", *carried)
    within = (F.col("me.part") == F.col("s.part")) & (F.col("me.bucket") == F.col("s.bucket"))
    # in the parent's interval, outside the interval on the way down
    within &= (F.col("p_lo") <= F.col("lo")) & (F.col("lo") < F.col("p_hi")) & ~((F.col("s_lo") <= F.col("lo")) & (F.col("lo") < F.col("s_hi")))
    met = me.alias("me").join(inner.alias("s"), within, "left")
    siblings = F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", F.col("s_lo").alias("at"), F.col("s_digest").alias("digest")))))
    grouped = met.groupBy("me.part", "me.bucket", "lo").agg(F.first("n").alias("n"), *[F.first(c).alias(c) for c in carried], siblings.alias("beside"))
    tops = F.least(_height(arity, low + levels), F.lit(low + levels)) - 1
    joined = lambda level, left: F.array_join(F.transform(F.filter(
        "beside", lambda s: (s["level"] == level) & ((s["at"] < F.col("lo")) if left else (s["at"] > F.col("lo")))), lambda s: s["digest"]), "")
    each = F.transform(F.sequence(F.lit(low), tops), lambda level: F.struct(joined(level, True).alias("left"), joined(level, False).alias("right")))
    none = F.array().cast("array<struct<left:string,right:string>>")
    return grouped.withColumn("steps", F.when(tops >= low, each).otherwise(none)).drop("beside")


def _tree(leaves: DataFrame, name: str, arity: int, levels: int) -> tuple[DataFrame, list[DataFrame]]:
    """(ranked leaves, stored bands of nodes from the leaves up)."""
    ranked = _ranked(leaves, f"{name}-ranked")
    most = ranked.agg(F.max("n")).first()[0] or 0
    bands, low = [], 0
    nodes = ranked.select("part", "n", "lo", (F.col("lo") + 1).alias("hi"), "digest")
    while not bands or arity ** low < most:
        bands.append(stored(_band(nodes, low, levels, arity), f"{name}-band"))
        low += levels
        nodes = bands[-1].where(F.col("level") == low).select("part", "n", "lo", "hi", "digest")
    return ranked, bands


def _roots(bands: list[DataFrame], levels: int) -> DataFrame:
    """(part, subroot): the digest of each part's root."""
    return bands[-1].where(F.col("level") == levels * len(bands)).select("part", F.col("digest").alias("subroot"))


def _paths(ranked: DataFrame, bands: list[DataFrame], above: DataFrame, arity: int, levels: int, carried: Sequence[str]) -> DataFrame:
    """Leaves with ``path`` to the root and the other columns of ``above``
    (part, path, ...), which goes on from each part's root."""
    told = [c for c in above.columns if c not in ("part", "path")]
    up = above.withColumn("bucket", F.lit(0).cast("long"))
    for i in reversed(range(len(bands))):
        low = i * levels
        nodes = ranked if i == 0 else bands[i - 1].where((F.col("level") == low)).select("part", "n", "lo", "digest")
        keep = [*carried, "digest"] if i == 0 else ["digest"]
        steps = _steps(nodes, bands[i], low, levels, arity, keep)
        joined = steps.join(up.withColumnRenamed("path", "rest"), ["part", "bucket"])
        up = joined.select("part", F.col("lo"), F.concat("steps", "rest").alias("path"), *keep, *told)
        if i:
            up = up.drop("digest").withColumn("bucket", F.floor(F.col("lo") / arity ** low)).drop("lo")
    return up


def manifest(docs: DataFrame, id_col: str = "doc_id", part_col: str = "lang", fields: Sequence[str] = FIELDS, tamper_col: str = "n_chars",
             arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """(id, lo, leaf, forged, subroot, root, path) of every row: its rank in its part, its
    digest, the digest it would have with 1 added to ``tamper_col`` where 7
    divides the crc32 of its id (else null), the roots, and the proof as steps from the leaf up, each
    the siblings' digests to the left and to the right."""
    picked = [F.col(f"`{f}`") for f in fields]
    forged = [c + 1 if f == tamper_col else c for f, c in zip(fields, picked)]
    key = F.col(f"`{id_col}`")
    hit = F.crc32(key.cast("string")) % 7 == 0
    part = F.col(f"`{part_col}`").cast("string")
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), part), F.lit("")).alias("part"), key.alias("id"), leaf_digest(picked).alias("digest"),
                         F.when(hit, leaf_digest(forged)).alias("forged"), F.monotonically_increasing_id().alias("tie"))
    ranked, bands = _tree(stored(leaves, "merkle-leaves"), "merkle", arity, levels)
    # the parts' roots, in the order of the parts, are the leaves of the upper tree
    subroots = stored(_roots(bands, levels), "merkle-roots")
    upper = subroots.select(F.lit("").alias("part"), F.col("part").alias("id"), F.col("subroot").alias("digest"), F.lit(0).alias("tie"))
    over, over_bands = _tree(upper, "merkle-parts", arity, levels)
    root = _roots(over_bands, levels).select("part", F.col("subroot").alias("root"))
    none = F.array().cast("array<struct<left:string,right:string>>")
    above = _paths(over, over_bands, root.withColumn("path", none), arity, levels, ["id"])
    above = stored(above.select(F.col("id").alias("part"), "path", F.col("digest").alias("subroot"), "root"), "merkle-parts")
    found = _paths(ranked, bands, above, arity, levels, ["id", "forged"])
    return found.select(F.col("id").alias(id_col), "lo", F.col("digest").alias("leaf"), "forged", "subroot", "root", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def verify(found: DataFrame) -> DataFrame:
    """``manifest`` rows with ``proof_sha256``, ``folded_root`` and ``verified``, folded from the forged leaf where there is one."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = found.withColumn("proof_sha256", F.sha2(siblings, 256)).withColumn("folded_root", fold(F.coalesce("forged", "leaf"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(manifest(read(spark, sf_dir, "documents"))).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


# Level by level over positions; a node's sibling is the other of its pair.
ORACLE_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
marked AS (SELECT documents.*, xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS hit FROM documents, crc_table),
fields AS (SELECT doc_id, lang, hit,
  coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
  coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') AS chars, coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS forged_chars,
  coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM marked),
leaves AS (SELECT doc_id, lang, sha256(head || chars || tail) AS leaf,
  sha256(head || CASE WHEN hit THEN forged_chars ELSE chars END || tail) AS shown FROM fields),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes(lang, level, pos, digest, n) AS (
  SELECT lang, 0, pos, leaf, n FROM ranked
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS parts FROM nodes WHERE n = 1),
tops(level, pos, digest, n) AS (
  SELECT 0, place, subroot, parts FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
climbed(lang, first, level, pos, n, acc, siblings) AS (
  SELECT lang, pos, 0, pos, n, shown, '' FROM ranked
  UNION ALL
  SELECT c.lang, c.first, c.level + 1, c.pos // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.pos % 2 = 1 THEN s.digest || c.acc ELSE c.acc || coalesce(s.digest, '') END), c.siblings || coalesce(s.digest, '')
  FROM climbed c LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.pos = xor(c.pos, 1) WHERE c.n > 1),
higher(lang, first, level, pos, n, acc, siblings, subroot) AS (
  SELECT c.lang, first, 0, place, parts, acc, siblings, subroot FROM climbed c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT c.lang, c.first, c.level + 1, c.pos // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.pos % 2 = 1 THEN s.digest || c.acc ELSE c.acc || coalesce(s.digest, '') END), c.siblings || coalesce(s.digest, ''), c.subroot
  FROM higher c LEFT JOIN tops s ON s.level = c.level AND s.pos = xor(c.pos, 1) WHERE c.n > 1)
SELECT doc_id, leaf, subroot, digest AS root, sha256(siblings) AS proof_sha256, acc AS folded_root, acc = digest AS verified
FROM ranked r JOIN higher h ON h.lang IS NOT DISTINCT FROM r.lang AND h.first = r.pos AND h.n = 1, (SELECT digest FROM tops WHERE n = 1)
"""
