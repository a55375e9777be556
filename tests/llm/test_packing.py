"""Packing: ids against the tokenizer itself, the curve, and every id in one piece."""

import random
import zlib

import numpy as np
import pyarrow as pa

from kiln.llm import packing as P
from tests.llm.odd import no_docs, odd_docs, odd_rows


def test_hilbert_key_is_a_walk_over_the_grid():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * n)).reshape(n, -1).T
        keys = P.hilbert(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_cuts_are_powers_of_two():
    for total in (0, 1, 5, 2047, 2048, 2049, 10_000):
        c = P.cuts(total)
        sizes = np.diff(c)
        assert c[-1] == total and c[0] == total // 2048 * 2048
        assert all(s & (s - 1) == 0 for s in sizes.tolist()) and len(set(sizes.tolist())) == len(sizes)


def test_ids_are_the_tokenizers():
    r = random.Random(1)
    encoder = P.encoder(P.tokenizer_path())
    alphabet = "ab'sS tT\n\t\x0b\x0c\x1c\x85 ́é<|>endoftext12 .,Σİ"
    texts = [t[1] or "" for t in odd_rows()] + ["a<|endoftext|> b", "<|STARTOFTEXT|>,", "The, the. THE.,. can't x's 12.3", "ΑΣ ΑΣ."] + [
        "".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(1500)]
    ids, counts = encoder(pa.array(texts))
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at:at + n].tolist() == encoder.whole.encode(text, add_special_tokens=False).ids, text
        at += n


def test_copies_and_neighbours_share_the_curve():
    encoder = P.encoder(P.tokenizer_path())
    base = "the cat sat on the mat and looked at the other cat by the door " * 20
    ids, counts = encoder(pa.array([base, base, base + "again", ""]))
    keys = P.curve_keys(ids, counts)
    assert keys[0] == keys[1] and abs(keys[0] - keys[2]) < 2**47


def check(spark, df, rows):
    encoder = P.encoder(P.tokenizer_path())
    want = sorted(tuple([*encoder.whole.encode(t or "", add_special_tokens=False).ids, 1]) for t in rows)
    pieces = P.pack(df).collect()
    for r in pieces:
        assert len(r.ids) == 4 * r.length > 0
    total = sum(r.length for r in pieces)
    assert total == sum(map(len, want))
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, r.ids))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    stream = b""
    for s in sorted(by_sequence):
        at = 0
        for offset, length, ids in sorted(by_sequence[s]):
            assert offset == at
            at += length
            stream += ids
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)
    flat = np.frombuffer(stream, "<u4")
    got, begin = [], 0
    for e in np.flatnonzero(flat == 1):
        got.append(tuple(flat[begin:e + 1].tolist()))
        begin = e + 1
    assert sorted(got) == want
    assert sum(s.ids.__len__() for s in P.sequences(P.pack(df)).collect()) == 4 * total
    return pieces


def test_every_id_is_in_one_piece(spark):
    rows = odd_rows()
    pieces = check(spark, odd_docs(spark), [r[1] for r in rows])
    assert {r.doc_id for r in pieces} == {r[0] for r in rows}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = check(spark, docs, [r.text for r in docs.collect()])
    d = {(r.doc_id, r.start): r for r in P.digest(P.pack(docs)).collect()}
    for r in pieces:
        assert d[(r.doc_id, r.start)].ids_crc32 == zlib.crc32(r.ids)
    assert P.pack(no_docs(spark)).count() == 0
