"""Order min-hash classes against alignment of all pairs."""

import bisect
import collections
import random
import re

import numpy as np
import pyarrow as pa

from kiln.llm import arrays as A
from kiln.llm import order_minhash as O
from tests.llm.odd import no_docs, odd_docs, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    seen, out = collections.Counter(), []
    for i in range(max(1, len(w) - 4) if w else 0):
        s = tuple(w[i:i + 5])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def similar(a, b):
    if not a or not b:
        return not a and not b
    place, ends = {s: i for i, s in enumerate(b)}, []
    for s in a:
        if s in place:
            k = bisect.bisect_left(ends, place[s])
            ends[k:k + 1] = [place[s]]
    return len(ends) >= 0.8 * (len(a) + len(b) - len(ends)) - 1e-9


def brute(rows):
    seqs = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if similar(seqs[i], seqs[j]):
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return sorted(((d, min(ids[find(i)], default=None)) for i, (d, _) in enumerate(rows)), key=str)


def family(r, n, rate):
    base = [f"w{r.randrange(500)}" for _ in range(n)]
    while True:
        yield " ".join(r.choice([x, f"n{r.randrange(9999)}", x + " more", ""]) if r.random() < rate else x for x in base)


def rows_of():
    r = random.Random(4)
    rows = []
    for k in range(8):
        f = family(r, r.choice([40, 120, 300]), r.choice([0.005, 0.02, 0.04]))
        rows += [next(f) for _ in range(25)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [passage + " " + " ".join(f"z{r.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    rows += [rows[0].upper(), "  " + rows[0].replace(" ", "\n"), rows[1] * 2, "a b c", "A b  c", "a b c d"]
    r.shuffle(rows)
    return [(i * 3 % 1001, t) for i, t in enumerate(rows)]


def test_classes_match_all_pairs(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (512, 4):
        assert sorted(((r.id, r.class_id) for r in O.classes(df, block=block).collect()), key=str) == brute(rows)
    classes = {c for _, c in brute(rows)}
    kept = O.keep(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(classes) and len(classes) < len(rows) - 80


def test_sketch_is_the_ordered_minima_and_meets_its_recall():
    r = np.random.default_rng(1)
    hits = 0
    for _ in range(300):  # 90 of 110 shingles shared: similarity 0.818
        shared = r.integers(0, 2**63, 90, dtype=np.uint64)
        a, b = (np.insert(shared, np.sort(r.integers(0, 91, 10)), r.integers(0, 2**63, 10, dtype=np.uint64)) for _ in range(2))
        s = O.sketch(np.concatenate([a, b]), np.repeat([0, 1], 100), 2)
        hits += bool((s[0] == s[1]).any())
        back = O.sketch(a[::-1].copy(), np.zeros(100, np.int64), 1)
        assert (back[0] != s[0]).all()  # the same shingles in another order
    assert hits >= 299


def test_short_texts_lose_no_link(spark):
    r = random.Random(12)
    rows = []
    for k in range(250):
        base = [f"s{k}w{r.choice([i, i, 0])}" for i in range(r.randrange(1, 14))]
        cut = list(base)
        for _ in range(r.choice([1, 1, 2])):
            cut = r.choice([cut[:-1], cut[1:], [*cut, f"s{k}x"], [f"s{k}y", *cut]])
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(cut))]
    got = sorted(((r.id, r.class_id) for r in O.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    # texts of more shingles than have exact keys meet by sketches; none is missed here either
    assert got == brute(rows) and len({c for _, c in got}) < len(rows)


def test_short_keys_are_shared_by_all_similar_pairs():
    r = np.random.default_rng(5)
    for _ in range(400):
        a = r.integers(0, 2**63, r.integers(1, O.SHORT + 1), dtype=np.uint64)
        b = a
        for _ in range(2):
            if len(b) and r.random() < .5:
                b = np.delete(b, r.integers(len(b)))
            elif len(b) < O.SHORT:
                b = np.insert(b, r.integers(len(b) + 1), r.integers(0, 2**63, dtype=np.uint64))
        keys, row = O.short_keys(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        if len(b) and not np.array_equal(a, b) and O.aligned(a, b):
            assert set(keys[row == 0].tolist()) & set(keys[row == 1].tolist())


def test_labels_count_equal_shingles():
    data, offsets = A.utf8(pa.array(["x y " * 6, "x y " * 6, "x y"]))
    starts, ends, row = A.words(data, offsets)
    value, of = A.shingles(A.span_hasher(data)(starts, ends), row, 5)
    assert np.bincount(of).tolist() == [8, 8, 1] and len(set(value[:8].tolist())) == 8 and (value[:8] == value[8:16]).all()


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    df = odd_docs(spark)
    assert sorted(((r.id, r.class_id) for r in O.classes(df).collect()), key=str) == brute(rows)
    kept = O.keep(df)
    assert kept.schema == df.schema
    got = sorted((str(r.doc_id), r.text) for r in kept.collect())
    # class 1 has equal rows under id 1 and a copy under 8; the empty texts, one without an id, are one class
    assert [t for i, t in got if i == "1"].count("one two three four five six seven") == 1 and not [1 for i, _ in got if i == "8"]
    assert [i for i, t in got if not (t or "").strip()] == ["2"]
    assert O.classes(no_docs(spark)).count() == O.keep(no_docs(spark)).count() == 0
