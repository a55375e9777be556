"""Merkle manifest against a tree built level by level in Python, and its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from kiln.llm import merkle as M
from tests.llm.odd import no_docs, odd_docs, odd_rows

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(level, arity):
    """(root, for each leaf the steps of (left, right) siblings)."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        runs = [level[i:i + arity] for i in range(0, len(level), arity)]
        for k, path in enumerate(paths):
            run, place = runs[at[k] // arity], at[k] % arity
            path.append(("".join(run[:place]), "".join(run[place + 1:])))
            at[k] //= arity
        level = [h("".join(r)) for r in runs]
    return level[0], paths


def brute(rows, arity=2):
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append(r)
    order = sorted(parts, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in order:
        group = sorted(parts[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[k] = group, *climb([leaf(*r) for r in group], arity)
    root, above = climb([trees[k][1] for k in order], arity)
    out = []
    for k, upper in zip(order, above):
        group, subroot, paths = trees[k]
        for r, path in zip(group, paths):
            path = path + upper
            shown = list(r)
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                shown[3] += 1
            acc = leaf(*shown)
            for left, right in path:
                acc = h(left + acc + right)
            out.append((r[0], leaf(*r), subroot, root, h("".join(a + b for a, b in path)), acc, acc == root))
    return sorted(out, key=str)


def digest(df, **kw):
    return sorted((tuple(r) for r in M.verify(M.manifest(df, **kw)).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def made(n, langs, seed):
    r = random.Random(seed)
    return [(r.choice([i, i, i, None, 7, 28]), r.choice(["a", "b:1", None, "é"]), r.choices(langs, range(1, len(langs) + 1))[0], r.choice([None, 9, 99]),
             r.choice([None, "", "text", "tèxt 😀", "x" * 5000])) for i in range(n)]


@pytest.mark.parametrize("n, langs, arity, levels", [(1, ["en"], 2, 6), (2, [None, "en"], 2, 6), (150, [None, "de", "en", "Z", "é", ""], 2, 2), (90, ["en"], 3, 2),
                                                     (70, [f"l{k}" for k in range(23)], 4, 1)])
def test_matches_brute_force(spark, n, langs, arity, levels):
    rows = made(n, langs, n)
    got = digest(spark.createDataFrame(rows, SCHEMA).repartition(3), arity=arity, levels=levels)
    assert got == brute(rows, arity)


def test_tampering_is_found_where_it_happens(spark):
    rows = [(i, "s", "en", i, "t") for i in range(300)]
    got = digest(spark.createDataFrame(rows, SCHEMA))
    assert {r[0] for r in got if not r[-1]} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 0} != set()
    assert got == brute(rows)


def test_odd_rows_clashing_names_and_empty_table(spark):
    rows = [(i, source, lang, n, t) for i, t, lang, source, n, *_ in odd_rows()]
    df = odd_docs(spark).selectExpr("*", "1 AS lo", "2 AS n", "'p' AS part", "'q' AS digest", "0 AS level", "0 AS bucket")
    assert digest(df) == brute(rows)
    assert digest(spark.createDataFrame(rows * 20, SCHEMA)) == brute(rows * 20)
    assert digest(no_docs(spark)) == []


def test_intervals_nest(spark):
    leaves = spark.createDataFrame([("=en", i, f"{i:064x}", i) for i in range(100)], "part string, id long, digest string, tie long")
    bands = M._tree(leaves, "test-merkle", 2, 3)[1]
    nodes = [(r.level, r.lo, r.hi) for b in bands for r in b.collect()]
    for level, lo, hi in nodes:
        assert lo % 2 ** level == 0 and hi == min(lo + 2 ** level, 100)
    assert {(level, lo) for level, lo, _ in nodes} == {(k, i) for k in range(10) for i in range(0, 100, 2 ** k)}


def test_sql(spark):
    rows = made(60, [None, "de", "en"], 3)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(M.ORACLE_SQL).fetchall(), key=str) == brute(rows)
