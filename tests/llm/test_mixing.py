"""Mixing: water-filling and prefixes against a plain recursive version."""

import collections
import hashlib
import random
import re
from fractions import Fraction

from kiln.llm import mixing as M
from tests.llm.odd import no_docs, odd_docs, odd_rows


def fill(budget, nodes):
    """nodes: {key: (cap, weight)} -> {key: given}, by raising the water level node by node."""
    given, left = {}, budget
    todo = sorted((k for k in nodes if nodes[k][1] > 0), key=lambda k: (float(nodes[k][0]) / nodes[k][1], k))
    while todo:
        k, weights = todo[0], sum(nodes[x][1] for x in todo)
        if left <= 0 or Fraction(left * nodes[k][1], weights) < nodes[k][0]:
            break
        given[k] = nodes[k][0]
        left -= nodes[k][0]
        todo.pop(0)
    weights = sum(nodes[x][1] for x in todo)
    for k in todo:
        given[k] = max(left, 0) * nodes[k][1] // weights
    spare = max(left, 0) - sum(given[k] for k in todo)
    for k in todo[:spare]:
        given[k] += 1
    return given


def brute(rows, weights, percent, epochs, seed):
    """rows: (id, text, lang, source) -> Counter of (id, text, copies)."""
    key = lambda v: "-" if v is None else f"={v}"

    def domain(source):
        m = re.search("([0-9]+)$", source or "")
        return f"d{int(m[1]) % 3}" if m else None
    leaves, members = collections.Counter(), collections.defaultdict(list)
    for row in rows:
        leaf = (key(domain(row[3])), key(row[2]), key(row[3]))
        n = len(re.findall(r"[^\x20\x09-\x0D]+", row[1] or ""))
        leaves[leaf] += n
        members[leaf].append((row, n))
    weight = lambda level, k: weights[level].get(k[1:] if k != "-" else None, 1)

    def down(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            yield prefix, budget
            return
        caps = collections.Counter()
        for leaf, n in leaves.items():
            if leaf[:depth] == prefix:
                caps[leaf[depth]] += n * epochs
        given = fill(budget, {k: (c, weight(M.LEVELS[depth], k)) for k, c in caps.items()})
        for k, b in given.items():
            yield from down((*prefix, k), b)
    out = collections.Counter()
    for leaf, budget in down((), sum(leaves.values()) * percent // 100):
        if budget <= 0:
            continue
        whole, remain = divmod(budget, leaves[leaf])
        order = sorted(members[leaf], key=lambda m: (hashlib.md5(f"{seed}:{whole}:{'' if m[0][0] is None else m[0][0]}".encode()).hexdigest(), m[0][0] or 0, m[1]))
        ahead = 0
        for row, n in order:
            copies = whole + (ahead < remain)
            ahead += n
            if copies:
                out[(row[0], row[1], copies)] += 1
    return out


def rows_of(n):
    r = random.Random(n)
    return [(i, " ".join("w" for _ in range(r.choice([0, 3, 10, 200]))), r.choice(["en", "en", "de", "fr", None]),
             r.choice(["src0", "src0", "src0", "src1", "src2", "src4", "src15", "plain", None])) for i in range(n)]


def test_matches_recursion(spark):
    rows = rows_of(400)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for weights, percent, epochs in ((M.WEIGHTS, 80, 2), (M.WEIGHTS, 5, 1), (M.WEIGHTS, 190, 3), (M.WEIGHTS, 1000, 2),
                                     ({"domain": {"d0": 90, "d1": 0}, "lang": {"fr": 50}, "source": {"src15": 7, "src0": 0}}, 60, 2)):
        got = collections.Counter((r.row.doc_id, r.row.text, r.copies) for r in M.choose(df, weights, percent, epochs).collect())
        assert got == brute(rows, weights, percent, epochs, M.SEED)


def test_shortage_goes_to_siblings_before_ancestors(spark):
    # d1 holds too little of its language fr; the rest stays within d1 (its de), not with d0
    rows = [(i, "w " * 100, "en", "src3") for i in range(10)] + [(100, "w " * 10, "fr", "src1")] + [(200 + i, "w " * 100, "de", "src1") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    w = {"domain": {"d0": 1, "d1": 1}, "lang": {"fr": 1, "de": 1}, "source": {}}
    got = collections.Counter()
    for r in M.choose(df, w, 50, 1).collect():
        got[r.row.source, r.row.lang] += r.tokens
    assert got == {("src3", "en"): 600, ("src1", "fr"): 10, ("src1", "de"): 500}


def test_rows_repeat_by_epoch_and_odd_rows(spark):
    df, rows = odd_docs(spark), [(r[0], r[1], r[2], r[3]) for r in odd_rows()]
    got = collections.Counter((r.row.doc_id, r.row.text, r.copies) for r in M.choose(df).collect())
    assert got == brute(rows, M.WEIGHTS, M.PERCENT, M.EPOCHS, M.SEED)
    out = M.select_rows(df)
    assert out.schema == df.schema
    assert out.count() == sum(k[2] * n for k, n in got.items())
    assert M.choose(no_docs(spark)).count() == M.select_rows(no_docs(spark)).count() == 0
