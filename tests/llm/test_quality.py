"""Quality rules against brute force over plain Python strings."""

import collections
import random
import re

import pyarrow as pa

from kiln.llm import arrays as A
from kiln.llm import quality as Q
from tests.llm.odd import no_docs, odd_docs, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(i, i + 3)}
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
    chars = sum(map(len, w))
    worst, bad = 0, dup_chars > Q.LINE_LIMIT * chars
    for n, limit in Q.NGRAM_LIMITS.items():
        seen, cover = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i:i + n])
            if g in seen:
                cover.update(range(i, i + n))
            seen.add(g)
        covered = sum(len(w[i]) for i in cover)
        worst, bad = max(worst, covered), bad or covered > limit * chars
    failed = len(w) < Q.MIN_WORDS or 100 * len(inside) > 50 * len(w)
    return (len(w), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed, not failed and not bad, dup_chars, worst)


def random_text(r):
    words = [r.choice(["aa", "b", "çé", "ddd|", "e#", "😀f"]) for _ in range(r.randrange(1, 8))] if r.random() < .4 else [str(k) for k in range(60)]
    parts = []
    for _ in range(r.randrange(0, 40)):
        parts.append(" ".join(r.choices(words, k=r.randrange(1, 30))) if r.random() < .8 or not parts else r.choice(parts))
    return r.choice(["\n", " \n", "\n\n", " ", "\x0b"]).join(parts)


def test_measure_matches_brute_force():
    r = random.Random(11)
    texts = [random_text(r) for _ in range(400)] + [t[1] for t in odd_rows()]
    got = Q.measure(pa.array(texts))
    for i, t in enumerate(texts):
        assert tuple(got[k][i].item() for k in Q.FIELDS) == brute(t), t[:80]
    assert {x[6] for x in map(brute, texts)} == {True, False}


def test_chunks_cover_all_rows():
    texts = pa.array(["a" * n for n in (0, 5, 100, 3, 3, 3, 50)] + [None])
    assert list(A.chunks(texts, 10)) == [(0, 2), (2, 3), (3, 6), (6, 7), (7, 8)]
    assert list(A.chunks(pa.array([], pa.string()), 10)) == []


def test_operator_on_odd_rows(spark):
    df = odd_docs(spark)
    got = sorted((r.doc_id, tuple(r)[1:]) for r in Q.score(df).collect() if r.doc_id is not None)
    assert got == sorted((i, brute(t)) for i, t, *_ in odd_rows() if i is not None)
    kept = Q.keep(df)
    assert kept.schema == df.schema
    assert sorted(r.id for r in kept.collect()) == sorted(r[5] for r in odd_rows() if brute(r[1])[6])
    assert Q.score(no_docs(spark)).count() == Q.keep(no_docs(spark)).count() == 0
