"""Secret scans: the trigram queries, and all spans against Python's re."""

import random
import re

import pytest

from kiln.llm import secret_scan as S
from tests.llm.odd import no_docs, odd_docs, odd_rows


def brute(text):
    out = []
    for rank, rule in enumerate(S.RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), rank, rule.kind, m.end()))
    return sorted(out)


def test_trigram_queries():
    q = {r.kind: S.trigram_query(r.pattern) for r in S.RULES}
    assert q["hex"] == S.ALL
    assert q["access"] == ("and", (("tri", "aki"), ("tri", "kia")))
    assert ("and", (("tri", "tok"), ("tri", "oke"), ("tri", "ken"))) in q["assign"][1]
    assert S.trigram_query("ab") == S.trigram_query("(abc)?") == S.trigram_query("a.c") == S.trigram_query("abc|[0-9]+") == S.ALL
    assert S.trigram_query("abc|abcd") == ("tri", "abc")
    assert S.trigram_query("x(abc)+y")[0] in ("and", "tri")


@pytest.mark.parametrize("rule", S.RULES, ids=lambda r: r.kind)
def test_every_match_satisfies_its_query(rule):
    holds = lambda q, t: (q == S.ALL or (q[1] in t if q[0] == "tri"
                                         else (all if q[0] == "and" else any)(holds(p, t) for p in q[1])))
    q = S.trigram_query(rule.pattern)
    for text in ('PassWord = "abcdefgh"', "passwd:x.y.z.w.1", "api_key=12345678", "APIKEY: 'aaaaaaaaa'", "secret:zzzzzzzzz", "Token= 1234567890",
                 "AKIA" + "A1" * 8, "f" * 32, "-----BEGIN RSA PRIVATE KEY-----"):
        for m in re.finditer(rule.pattern, text):
            assert holds(q, text.lower()), text


def texts():
    r = random.Random(2)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", '"', "'", " ", ":", "=", "AKIA", "A1B2C3D4E5F6", "abcdefgh", "0123456789abcdef",
            "é", "😀", "\n", "short", ".", "-----BEGIN ", "PRIVATE KEY-----", "RSA "]
    return ["".join(r.choices(bits, k=r.randrange(1, 40))) for _ in range(600)] + [
        "password=token:abcdefgh", "token = secret=abcdefghijk", "AKIAAKIA" + "X" * 12, "a" * 31, "a" * 32, "0" * 64 + "g" + "1" * 32]


def test_spans_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for docs_per_segment in (4096, 7):
        got = {r.doc_id: [tuple(s) for s in r.spans] for r in S.find(df, segment_docs=docs_per_segment).collect()}
        for i, t in rows:
            assert got[i] == brute(t), t
    assert sum(map(len, got.values())) > 200


def test_other_rules_and_ids(spark):
    df = spark.createDataFrame([("a", "xyz1 gh_token"), ("b", "q")], "k string, text string")
    got = {r.k: [s.kind for s in r.spans] for r in S.find(df, (S.Rule("x", "xyz[0-9]"), S.Rule("y", "q")), "k").collect()}
    assert got == {"a": ["x"], "b": ["y"]}
    assert S.find(df, (S.Rule("y", "q"),), "k").count() == 2  # no rule with a trigram, so no index


def test_odd_rows(spark):
    extra = [(None, "token: abcdefghij", None, None, None, 90, "k", None, 0.5, 1, 2, "z"), (1, "token: abcdefghij", None, None, None, 91, "k", None, 0.5, 1, 2, "z")]
    df = odd_docs(spark).unionByName(spark.createDataFrame(extra, odd_docs(spark).schema))
    got = sorted((str(r.doc_id), r.text, [tuple(s) for s in r.spans]) for r in S.find(df).collect())
    assert got == sorted((str(r[0]), r[1] or "", brute(r[1])) for r in [*odd_rows(), *extra])
    assert S.find(no_docs(spark)).count() == 0
