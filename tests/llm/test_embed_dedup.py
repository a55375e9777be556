"""Embedding links and components against all pairs."""

import numpy as np
from pyspark.sql import types as T

from kiln.llm import embed_dedup as D
from kiln.llm.graph import connected_components

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("node", T.StringType())])


def brute(rows):
    n = len(rows)
    good = [i for i, (_, v, _) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [set() for _ in range(n)]
    for i in good:
        a = np.array(rows[i][1], np.float32).astype(float)
        for j in good:
            if i != j and len(rows[j][1]) == len(a):
                b = np.array(rows[j][1], np.float32).astype(float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.95:
                    links[i].add(j)
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i]] + [root[j] for j in links[i]]) for i in range(n)]
        if new == root:
            break
        root = new
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


def test_links_match_all_pairs(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((12, 16))
    rows = []
    for i in range(260):
        c = centres[i % 12] + r.standard_normal(16) * r.choice([0, 0.05, 0.15, 0.22, 1.0])
        rows.append((1000 - i, [float(np.float32(x)) for x in c * r.choice([1, 1, 2.5])], "x"))
    hot = rows[0][1]
    rows += [(2000 + i, hot, None) for i in range(60)]
    rows += [(5, None, None), (6, [], None), (7, [0.0] * 16, None), (8, [None] + hot[1:], None), (9, [float("nan")] + hot[1:], None),
             (10, [float("inf")] + hot[1:], None), (None, hot, None), (None, [1.0] * 16, None), (5, hot, None), (11, [1.0, 2.0], None), (12, [2.0, 4.0], None),
             (13, [0.0, -0.0, 1.0], None), (14, [-0.0, 0.0, 1.0], None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for block in (1024, 8):
        assert sorted((tuple(x) for x in D.link(df, block=block).collect()), key=str) == brute(rows)
    assert D.link(df.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000 + i, 1000) for i in range(500)] + [(7, 7), (None, 3), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(401)}, **{1000 + i: 1000 for i in range(500)}, 2000: 2000, 2001: 2000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
