"""Alignment against whole texts encoded at once and grouped in plain Python."""

import collections
import functools
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kiln.llm import token_align as T
from tests.llm.odd import no_docs, odd_docs, odd_rows

PATHS = T.vocabulary_paths()
BYTE_LEVEL = Tokenizer.from_file(PATHS[0])
BYTE_LEVEL.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
A_BYTES, B_BYTES = T.ByteLevel(PATHS[0]).bytes, T.Pieces(PATHS[1]).bytes


def brute_groups(text):
    """[(A ids, B ids)] of a text, or none."""
    if not text:
        return []
    want = b" " + text.encode()
    a, b = BYTE_LEVEL.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
    if b"".join(A_BYTES[i] for i in a) != want or b"".join(B_BYTES[i] for i in b) != want:
        return []
    ends_a, ends_b = np.cumsum([len(A_BYTES[i]) for i in a]).tolist(), np.cumsum([len(B_BYTES[i]) for i in b]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    assert (i, j) == (len(a), len(b))
    return groups


def brute(texts):
    links = [collections.Counter((x, y) for a, b in brute_groups(t) for x in a for y in b) for t in texts]
    count = collections.Counter(p for c in links for p in c)
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for t, c in zip(texts, links):
        g = brute_groups(t)
        whole = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]),
                    sum(n * count[p] for p, n in c.items()), hashlib.sha256(whole.encode()).hexdigest() if g else "", whole))
    return out


def random_text(r):
    words = ["the", "Token", "naïve", "日本語テキスト", "😀😀", "x1y2", "don't", "<|endoftext|>", "<s>", "</s>", "don't,", "2024-01-02", "ﬁn", "é", "á", "\x00", "\x85",
             " ", "　", "​", "ab\ncd", "\t", "\r\n", "internationalisation", "<0x41>", " ", "\x1c"]
    seps = [" "] * 12 + ["  ", "\n", "\n\n", " \n", "\t", "   ", " ", ""]
    text = "".join(r.choice(words) + r.choice(seps) for _ in range(r.randrange(60)))
    return r.choice(["", "", " ", "\n"]) + text + r.choice(["", "", "▁", " "][:3 if r.random() < .9 else 4])


def test_units_give_the_tokens_of_whole_texts():
    r = random.Random(3)
    texts = [random_text(r) for _ in range(600)] + [r[1] for r in odd_rows()]
    got = list(T.documents(T.Encoder(*PATHS)(pa.array(texts, pa.string()))))
    for t, d, w in zip(texts, got, brute(texts)):
        assert (d.n_a, d.n_b, d.n_groups, d.n_links, d.groups.decode()) == (*w[:4], w[7]), t[:60]
    assert any(d.n_groups for d in got) and any(t and not d.n_groups for t, d in zip(texts, got))


def test_forgetting_units_changes_nothing(monkeypatch):
    texts = pa.array(["one two three", "four five one two", "six seven one"])
    want = [d.groups for d in T.documents(T.Encoder(*PATHS)(texts))]
    monkeypatch.setattr(T, "REMEMBERED", 3)
    few = T.Encoder(*PATHS)
    assert [list(T.documents(few(texts.slice(i, 1))))[0].groups for i in range(3)] == want == [d.groups for d in T.documents(few(texts))]


def same(x, y):
    return all(np.array_equal(p, q) if isinstance(p, np.ndarray) else p == q for p, q in zip(x, y))


def test_fragments_compose_in_any_order():
    r = random.Random(8)
    enc = T.Encoder(*PATHS)
    for _ in range(60):
        text = random_text(r)
        tokens = enc(pa.array([text]))
        if not tokens.ok[0]:
            continue
        size = int(tokens.ends[0][-1])
        bounds = sorted({0, size, *(r.randrange(size + 1) for _ in range(r.randrange(9)))})
        parts = []
        for lo, hi in zip(bounds, bounds[1:]):
            mine = [(e > lo) & (e <= hi) for e in tokens.ends]
            parts.append(T.fragment([i[m] for i, m in zip(tokens.ids, mine)], [e[m] for e, m in zip(tokens.ends, mine)]))
        whole = T.fragment(tokens.ids, tokens.ends)
        left = functools.reduce(T.compose, parts)
        right = functools.reduce(lambda y, x: T.compose(x, y), reversed(parts))
        assert same(left, right) and same(left, whole)
        assert same(T.compose(T.Fragment(), whole), whole) and same(T.compose(whole, T.Fragment()), whole)
        assert T.closed(left).groups.decode() == brute([text])[0][7]


@pytest.mark.parametrize("chunk", [1, 7, 40, 1000])
def test_ranges_cover_the_text(chunk):
    r = random.Random(chunk)
    enc = T.Encoder(*PATHS)
    for _ in range(30):
        text = random_text(r) or "x"
        parts = []
        for units, lo, hi in T.ranges(text, chunk):
            tokens = enc(pa.array([units]))
            if not units:
                tokens = tokens._replace(ok=np.array([True]))
            mine = [(e > lo) & (e <= hi) for e in tokens.ends]
            parts.append(T.fragment([i[m] for i, m in zip(tokens.ids, mine)], [e[m] for e, m in zip(tokens.ends, mine)])._replace(ok=bool(tokens.ok[0])))
        d = T.closed(functools.reduce(T.compose, parts))
        assert (d.n_a, d.n_b, d.n_groups, d.n_links, d.groups.decode()) == (*brute([text])[0][:4], brute([text])[0][7])


def collected(df, **kw):
    return sorted(((r.doc_id, *tuple(r)[1:]) for r in T.align(df, keep_groups=True, **kw).collect()), key=str)


@pytest.mark.parametrize("chunk, fan", [(T.CHUNK, T.FAN), (50, 2), (300, 3)])
def test_operator_matches_brute_force(spark, chunk, fan):
    r = random.Random(21)
    texts = [random_text(r) for _ in range(120)] + ["same text in many rows"] * 30 + [None, "", "x" * 3000, "a b " * 900, "\n" * 500]
    got = collected(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), chunk=chunk, fan=fan)
    assert got == sorted(((i, *w) for i, w in enumerate(brute(texts))), key=str)


def test_blocks_share_counts(spark, monkeypatch):
    texts = [f"shared words here {i % 3} and {i}" for i in range(90)]
    monkeypatch.setattr(T, "BLOCK_BYTES", 100)
    got = collected(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert got == sorted(((i, *w) for i, w in enumerate(brute(texts))), key=str)


def test_odd_rows_and_empty_table(spark):
    texts = [r[1] for r in odd_rows()]
    want = sorted(((r[0], *w) for r, w in zip(odd_rows(), brute(texts))), key=str)
    clash = odd_docs(spark).selectExpr("*", "1 AS pair", "2 AS place", "'z' AS refs", "3 AS lo")
    assert collected(clash) == want
    assert collected(clash, chunk=1000, fan=2) == want
    assert T.align(no_docs(spark)).collect() == []
