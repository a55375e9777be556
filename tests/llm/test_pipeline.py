"""The pipeline: its stages one after another, each against its operator's own test."""

import corpus_pipeline as C
from kiln.llm import line_dedup, packing, quality
from tests.llm import test_line_dedup, test_mixing, test_order_minhash, test_quality
from tests.llm.odd import no_docs, odd_docs

SF = "/root/testdata/sf0.001"


def test_stages_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {(r.doc_id, r.text): r for r in docs.collect()}
    names = [n for n, _ in C.STAGES]
    assert len(names) == 5
    frames = [docs]
    for _, stage in C.STAGES:
        frames.append(stage(spark, frames[-1], SF).checkpoint())
    rows = [f.collect() for f in frames]
    for f in frames[1:-1]:
        assert f.schema == docs.schema
    assert {(r.doc_id, r.text) for r in rows[1]} == {k for k in want if test_quality.brute(k[1])[6]}
    kept = [(r.doc_id, r.text) for r in rows[1]]
    lines = test_line_dedup.brute(kept, test_line_dedup.hashes(spark, kept))
    assert sorted((r.doc_id, r.text) for r in rows[2]) == sorted((i, t) for (i, _), t in zip(kept, lines))
    assert all(r.n_chars == len(r.text) for r in rows[2])
    assert sorted(r.doc_id for r in rows[3]) == sorted({c for _, c in test_order_minhash.brute([(r.doc_id, r.text) for r in rows[2]])})
    mixed = test_mixing.brute([(r.doc_id, r.text, r.lang, r.source) for r in rows[3]], *[getattr(test_mixing.M, k) for k in ("WEIGHTS", "PERCENT", "EPOCHS", "SEED")])
    assert len(rows[4]) == sum(k[2] * n for k, n in mixed.items()) and {(r.doc_id, r.text) for r in rows[4]} == {k[:2] for k in mixed}
    ids, counts = packing.encoder(packing.tokenizer_path())(__import__("pyarrow").array([r.text for r in rows[4]]))
    assert sum(r.length for r in rows[5]) == len(ids) + len(counts)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in C.run(spark, SF).collect()) == sorted(
        (r.doc_id, r.start, r.length, r.ids_crc32) for r in rows[5])


def test_stages_on_odd_rows(spark):
    for df in (odd_docs(spark), no_docs(spark)):
        for _, stage in C.STAGES:
            df = stage(spark, df, SF).checkpoint()
    assert df.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert quality.keep(odd_docs(spark)).count() == line_dedup.rewrite(quality.keep(odd_docs(spark))).count()
