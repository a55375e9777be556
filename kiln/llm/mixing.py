"""Mixing sources to target weights by hierarchical budgeting (operator 9).

A token budget flows down a domain - language - source tree. At each node it is
shared among the children by weight; a child that cannot use its share (its
subtree holds too few tokens, counted with repeated epochs) leaves the rest to
its siblings, and only what a whole subtree cannot use goes to its parent's
siblings. Each leaf takes whole epochs of its documents and then a prefix of one
more, in an order seeded by epoch: documents are taken while the tokens before
them are below the leaf's budget.

The prefix of a leaf is found by sums over hash buckets, and only the documents
of the one bucket in which it ends are sorted, so a leaf with a third of all
rows is never one task. Everything is DataFrame functions.

Defined cases: a null text has no tokens; a null domain, language or source is a
value of its own; rows that repeat an id are separate rows; a leaf without
tokens gets no budget and gives no rows; a weight of 0 gives no rows; an empty
table gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kiln.llm.common import read, stored, text_or_empty, whole_row

SEED = "mix-1"
#: Weights of a level's values among their siblings; values not named weigh 1.
WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 6, "de": 3, "fr": 2, "es": 1}, "source": {}}
#: The budget in per cent of all tokens, and how often a document may be taken.
PERCENT, EPOCHS = 80, 2
#: Hex digits of the order hash that number the buckets of a leaf.
DIGITS = 3
LEVELS = ("domain", "lang", "source")
KEYS = ("k1", "k2", "k3")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def domain_of(source: Column) -> Column:
    """The documents table names no domain: the source's number modulo 3 stands in."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.concat(F.lit("d"), (F.when(number != "", number.cast("decimal(38,0)")) % 3).cast("string"))


def _key(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def _weight(key: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for value, w in weights.items():
        out = F.when(key == f"={value}", F.lit(int(w))).otherwise(out)
    return out.cast("decimal(10,0)")


def share(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Water-fill: add ``given`` to rows (parent, key, cap, w, budget). In the
    order of cap / w, a node takes its cap while that is within its share of
    what is left; the others share the rest by weight, in whole tokens."""
    order = [F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double")).otherwise(F.lit(float("inf"))), F.col(key)]
    by = Window.partitionBy(*parent)
    before = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = by.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    dec = lambda c: c.cast("decimal(20,0)")
    out = (nodes.withColumn("left", dec(F.col("budget")) - F.coalesce(dec(F.sum("cap").over(before)), F.lit(0)))
           .withColumn("weights", dec(F.sum("w").over(onward)))
           .withColumn("full", (F.col("w") > 0) & (F.col("left") > 0) & (dec(F.col("cap")) * F.col("weights") <= F.col("left") * F.col("w"))))
    out = (out.withColumn("rest", dec(F.col("budget")) - F.coalesce(dec(F.sum(F.when(F.col("full"), F.col("cap"))).over(by)), F.lit(0)))
           .withColumn("among", dec(F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(by), F.lit(0))))
           .withColumn("floor", F.when(F.col("full"), F.col("cap"))
                       .when(F.col("among") > 0, F.expr("greatest(rest, 0) * w div among")).otherwise(F.lit(0)).cast("long"))
           .withColumn("over", F.col("rest") - F.sum(F.when(~F.col("full"), F.col("floor"))).over(by))
           .withColumn("turn", F.sum(F.when(~F.col("full") & (F.col("w") > 0), 1).otherwise(0)).over(
               by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))))
    one = ~F.col("full") & (F.col("w") > 0) & (F.col("among") > 0) & (F.col("turn") <= F.col("over"))
    return (out.withColumn("given", F.col("floor") + F.when(one, 1).otherwise(0))
            .drop("left", "weights", "full", "rest", "among", "floor", "over", "turn"))


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], percent: int, epochs: int) -> DataFrame:
    """(k1, k2, k3, total, given) of leaves (k1, k2, k3, total), from the root down."""
    sized = leaves.withColumn("cap", F.col("total") * epochs)
    top = sized.groupBy("k1").agg(F.sum("cap").cast("long").alias("cap"), F.sum("total").cast("long").alias("total"))
    top = top.withColumn("root", F.lit(0))
    whole = F.sum("total").over(Window.partitionBy("root"))
    top = top.withColumn("budget", F.floor(whole.cast("decimal(20,0)") * percent / 100).cast("long"))
    level = share(top.withColumn("w", _weight(F.col("k1"), weights[LEVELS[0]])), ["root"], "k1")
    level = level.select("k1", F.col("given").alias("budget"))
    for depth in (2, 3):
        keys = list(KEYS[:depth])
        nodes = sized.groupBy(*keys).agg(F.sum("cap").cast("long").alias("cap"), F.sum("total").cast("long").alias("total"))
        nodes = nodes.join(level.drop("total"), keys[:-1]).withColumn("w", _weight(F.col(keys[-1]), weights[LEVELS[depth - 1]]))
        level = share(nodes, keys[:-1], keys[-1]).select(*keys, "total", F.col("given").alias("budget"))
    return level.withColumnRenamed("budget", "given")


def _hash(seed: str, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit(""))))


def _plan(narrow: DataFrame, weights: dict[str, dict[str, int]], percent: int, epochs: int, seed: str) -> DataFrame:
    """One row per leaf with a budget: whole epochs, the tokens that remain, and
    the bucket in which the prefix ends with the tokens before that bucket."""
    leaves = narrow.groupBy(*KEYS).agg(F.sum("tokens").alias("total"))
    given = budgets(leaves, weights, percent, epochs).where("given > 0").select(
        *KEYS, F.expr("given div total").alias("epochs"), F.expr("given % total").cast("long").alias("remain"))
    given = stored(given, "mix-budgets")
    bucket = F.substring(_hash(seed, F.col("epochs"), F.col("id")), 1, DIGITS)
    sums = (narrow.join(given.where("remain > 0"), list(KEYS)).groupBy(*KEYS, bucket.alias("bucket"))
            .agg(F.sum("tokens").alias("size"), F.first("remain").alias("remain")))
    upto = Window.partitionBy(*KEYS).orderBy("bucket")
    ends = (sums.withColumn("before", F.sum("size").over(upto) - F.col("size"))
            .where("before < remain AND remain <= before + size").select(*KEYS, F.col("bucket").alias("last"), "before"))
    return stored(given.join(ends, list(KEYS), "left"), "mix-plan")


def choose(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS,
           seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None,
           lang: Column | None = None, source: Column | None = None) -> DataFrame:
    """(row, copies, tokens, k1, k2, k3): the input rows that are taken, as a
    struct of all their columns, with how many epochs take them."""
    source = F.col("source") if source is None else source
    levels = (domain_of(source) if domain is None else domain, F.col("lang") if lang is None else lang, source)
    keyed = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("id"),
                        text_or_empty(text_col).alias("text"), *[_key(c).alias(k) for c, k in zip(levels, KEYS)])
    narrow = stored(keyed.select("id", token_count(F.col("text")).alias("tokens"), *KEYS), "mix-tokens")
    placed = (keyed.join(_plan(narrow, weights, percent, epochs, seed), list(KEYS))
              .withColumn("order", _hash(seed, F.col("epochs"), F.col("id")))
              .withColumn("bucket", F.substring("order", 1, DIGITS)))
    out = ["row", F.col("epochs").cast("long").alias("copies"), token_count(F.col("text")).alias("tokens"), *KEYS]
    more = ["row", (F.col("epochs") + 1).cast("long").alias("copies"), token_count(F.col("text")).alias("tokens"), *KEYS]
    sure = placed.where("bucket < last").select(*more)
    past = placed.where("(last IS NULL OR bucket > last) AND epochs > 0").select(*out)
    edge = placed.where("bucket = last").withColumn("size", token_count(F.col("text")))
    by = Window.partitionBy(*KEYS).orderBy("order", "id", "size", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("inside", F.col("before") + F.coalesce(F.sum("size").over(by), F.lit(0)) < F.col("remain"))
    edge = edge.where("inside OR epochs > 0").select(
        "row", (F.col("epochs") + F.col("inside").cast("long")).cast("long").alias("copies"), F.col("size").alias("tokens"), *KEYS)
    return sure.unionByName(past).unionByName(edge)


def select_rows(docs: DataFrame, **kw) -> DataFrame:
    """The taken rows with all their columns, once for each epoch that takes them."""
    return (choose(docs, **kw).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda k: F.when(F.startswith(F.col(k), F.lit("=")), F.substr(F.col(k), F.lit(2)))
    return choose(read(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), *[value(k).alias(n) for k, n in zip(KEYS, LEVELS)], "tokens", "copies")


def _sql_weight(level: str, key: str) -> str:
    whens = " ".join(f"WHEN {key} = '={v}' THEN {w}" for v, w in WEIGHTS[level].items())
    return f"CASE {whens} ELSE 1 END" if whens else "1"


def _sql_share(name: str, nodes: str, parent: str, key: str) -> str:
    """The sharing rule over the rows (parent, key, cap, w, budget) of ``nodes``:
    a node is full if its cap is at most its part of what full nodes leave."""
    ordered = f"PARTITION BY {parent} ORDER BY cap::DOUBLE / w, {key}"
    return f"""
{name}_a AS (SELECT *, budget - coalesce(sum(cap) OVER ({ordered} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
    sum(w) OVER ({ordered} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heft FROM {nodes}),
{name}_b AS (SELECT *, room > 0 AND cap * heft <= room * w AS sated FROM {name}_a),
{name}_c AS (SELECT *, budget - coalesce(sum(cap) FILTER (sated) OVER (PARTITION BY {parent}), 0) AS rest,
    coalesce(sum(w) FILTER (NOT sated) OVER (PARTITION BY {parent}), 0) AS others FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN sated THEN cap ELSE greatest(rest, 0) * w // others END AS base FROM {name}_c),
{name} AS (SELECT *, base + CASE WHEN NOT sated AND count(*) FILTER (NOT sated) OVER ({ordered} ROWS UNBOUNDED PRECEDING)
    <= rest - sum(base) FILTER (NOT sated) OVER (PARTITION BY {parent}) THEN 1 ELSE 0 END AS given FROM {name}_d)"""


def oracle_sql(table: str = "documents", rows: str = "doc_id, domain, lang, source, tokens, copies") -> str:
    """DuckDB statement of the selection over ``table``."""
    digits = r"regexp_extract(source, '([0-9]+)$', 1)"
    key = lambda c: f"coalesce('=' || {c}, '-')"
    order = "md5('" + SEED + ":' || epochs || ':' || coalesce(doc_id::VARCHAR, ''))"
    return f"""
WITH mix_docs AS (SELECT *, CASE WHEN {digits} = '' THEN NULL ELSE 'd' || ({digits}::HUGEINT % 3) END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM {table}),
keyed AS (SELECT *, {key('domain')} AS k1, {key('lang')} AS k2, {key('source')} AS k3 FROM mix_docs),
leaf AS (SELECT k1, k2, k3, sum(tokens) AS total, sum(tokens) * {EPOCHS} AS cap FROM keyed GROUP BY ALL),
n1 AS (SELECT 0 AS root, k1, sum(cap) AS cap, {_sql_weight('domain', 'k1')} AS w,
    (SELECT sum(total) * {PERCENT} // 100 FROM leaf) AS budget FROM leaf GROUP BY k1),
{_sql_share('s1', 'n1', 'root', 'k1')},
n2 AS (SELECT k1, k2, sum(leaf.cap) AS cap, {_sql_weight('lang', 'k2')} AS w, any_value(given) AS budget
    FROM leaf JOIN s1 USING (k1) GROUP BY k1, k2),
{_sql_share('s2', 'n2', 'k1', 'k2')},
n3 AS (SELECT k1, k2, k3, leaf.cap, total, {_sql_weight('source', 'k3')} AS w, given AS budget FROM leaf JOIN s2 USING (k1, k2)),
{_sql_share('s3', 'n3', 'k1, k2', 'k3')},
chosen AS (SELECT k1, k2, k3, given // total AS epochs, given % total AS remain FROM s3 WHERE given > 0),
ranked AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY k1, k2, k3 ORDER BY {order}, doc_id, tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM keyed JOIN chosen USING (k1, k2, k3)),
mixed AS (SELECT *, (epochs + (ahead < remain)::INT)::BIGINT AS copies FROM ranked)
SELECT {rows} FROM mixed WHERE copies > 0"""


ORACLE_SQL = oracle_sql()
