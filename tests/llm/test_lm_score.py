"""Context-tree weighting against a plain recursive tree, the base against a counter."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kiln.llm import arrays as A
from kiln.llm import lm_score as L
from tests.llm.odd import no_docs, odd_docs, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Tree:
    """Counts of every context up to ``depth`` bytes, weighted by recursion from the deepest."""

    def __init__(self, texts, depth):
        self.depth, self.known = depth, {}
        self.count = collections.defaultdict(lambda: [0, 0])
        for (context, byte), n in sum((self.runs(t) for t in texts), collections.Counter()).items():
            for node, bit in self.decisions(byte):
                for d in range(depth + 1):
                    self.count[context[depth - d:], node][bit] += n
        self.children = collections.defaultdict(float)
        for d in range(depth, 0, -1):
            for (context, node) in [k for k in self.count if len(k[0]) == d]:
                own = self.own(context, node)
                weighted = own if d == depth else np.logaddexp(own, self.children[context, node]) - math.log(2)
                self.children[context[1:], node] += weighted

    def runs(self, text):
        x = b"\xff" * self.depth + (text or "").encode() + b"\xff"
        return collections.Counter((x[i - self.depth:i], x[i]) for i in range(self.depth, len(x)))

    @staticmethod
    def decisions(byte):
        return [((1 << 7 - k) | byte >> k + 1, byte >> k & 1) for k in range(7, -1, -1)]

    def own(self, context, node):
        a, b = self.count.get((context, node), (0, 0))
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def probability(self, context, node, bit):
        p = None
        for d in range(self.depth, -1, -1):
            c = context[self.depth - d:]
            n = self.count.get((c, node), (0, 0))
            estimate = (n[bit] + .5) / (sum(n) + 1)
            if p is None:
                p = estimate
            else:
                w = 1 / (1 + math.exp(max(-700, min(700, self.children.get((c, node), 0.0) - self.own(c, node)))))
                p = w * estimate + (1 - w) * p
        return p

    def score(self, text):
        total = 0.0
        for (context, byte), n in self.runs(text).items():
            if (context, byte) not in self.known:
                self.known[context, byte] = sum(math.log10(self.probability(context, node, bit)) for node, bit in self.decisions(byte))
            total += n * self.known[context, byte]
        return total


def test_lgamma():
    x = np.array([0.5, 1, 1.5, 2, 10, 1e3, 1e9])
    assert np.allclose(L._lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check(df, rows, depth=L.DEPTH):
    train = [t for i, t in rows if not held(i)]
    tree = Tree(train, depth)
    tokens = lambda t: [w.translate(LOWER) for w in WORD.findall(t or "")] + [0]
    count = collections.Counter(x for t in train for x in tokens(t))
    n, v = sum(count.values()), len(count)
    want = collections.defaultdict(list)
    for i, t in rows:
        w = tokens(t)
        want[str(i)].append((held(i), len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), tree.score(t)))
    got = collections.defaultdict(list)
    for r in L.score(df, depth=depth).collect():
        got[str(r.doc_id)].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert got.keys() == want.keys()
    for k in want:
        for a, b in zip(sorted(got[k]), sorted(want[k])):
            assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9) and math.isclose(a[5], b[5], rel_tol=1e-7), (k, a, b)
        assert len(got[k]) == len(want[k])


ROWS = [(r[0], r[1]) for r in odd_rows()] + [(20 + i, f"some words {i} of Text\nmore é {i % 3}") for i in range(40)]


def test_odd_rows_in_one_block_and_in_many(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    check(df.coalesce(1), ROWS)
    monkeypatch.setattr(L, "BLOCK_BYTES", 400)
    check(df.repartition(4), ROWS)
    assert L.score(no_docs(spark)).count() == 0
    assert L.score(odd_docs(spark).selectExpr("*", "'b' AS blob", "1 AS deal", "2 AS kind")).count() == len(odd_rows())


@pytest.mark.parametrize("depth", [3, 4, 6])
def test_other_depths(spark, monkeypatch, depth):
    monkeypatch.setattr(L, "BLOCK_BYTES", 4000)
    check(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3), ROWS, depth)


def test_slices_do_not_cut_contexts(monkeypatch):
    monkeypatch.setattr(L, "SLICE", 50)
    data = np.frombuffer(("abcabdabe" * 30 + "xyz" * 100 + "".join(map(str, range(300)))).encode(), np.uint8)
    for depth in (3, 5):
        code = np.unique(L.runs(data, np.array([0, len(data)]), depth)[0])
        parts = [code[s] for s in L.slices(code, depth)]
        assert np.array_equal(np.concatenate(parts), code) and len(parts) > 3
        contexts = [set((p >> 8 * (depth - 2)).tolist()) for p in parts]
        assert sum(map(len, contexts)) == len(set().union(*contexts))
        assert all(len(p) <= 50 or len(c) == 1 for p, c in zip(parts, contexts))
    assert list(L.slices(np.zeros(0, np.int64), 5)) == []


def test_packed_keys_come_back():
    r = np.random.default_rng(4)
    for keys in (np.zeros(0, np.int64), np.array([-5, -1]), r.integers(-2**63, 2**63, 1000), r.integers(0, 2**48, 1000)):
        keys = np.unique(keys.view(np.uint64)).view(np.int64)
        numbers = r.integers(0, 2**40, len(keys))
        got = A.unpack(pa.scalar(A.pack(keys, numbers), pa.binary()), len(keys))
        assert np.array_equal(got[0], keys) and np.array_equal(got[1], numbers)


def test_held_out_texts_cost_fewer_bits_than_under_an_untrained_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = [r for r in L.score(docs).collect() if r.held_out]
    size = {r.doc_id: len((r.text or "").encode()) + 1 for r in docs.collect()}
    bits = -sum(r.score for r in out) / math.log10(2) / sum(size[r.doc_id] for r in out)
    assert len(out) > 10 and bits < 3.0  # an untrained tree gives 8


def test_the_registered_model_beats_the_unigram_base_on_held_out_texts(spark):
    out = [r for r in L.query(spark, "/root/testdata/sf0.1").where("held_out").collect()]
    assert len(out) > 1000 and sum(r.score for r in out) > sum(r.base_score for r in out)
