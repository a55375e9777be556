"""License scans against a plain search for every phrase at every place."""

import math
import random
import re

import pytest

from kiln.llm import license_scan as L
from tests.llm.odd import no_docs, odd_docs, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEMPLATES = L.BASE + L.NOTICES


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]


def brute(texts):
    files = [split(t) for t in texts]
    vocabulary = {w for t in TEMPLATES for w in t.text.split()}
    df = {w: sum(w in set(f) for f in files) for w in vocabulary}
    idf = {w: math.log((len(files) + 1) / (n + 1)) + 1e-9 for w, n in df.items()}
    out = []
    for words in files:
        found, best = [], 0.0
        for t in TEMPLATES:
            text = t.text.split()
            keys = sorted((places(text, p)[0], p) for p in t.phrases)
            for start in places(words, keys[0][1]):
                lead = start - keys[0][0]
                shifts = [lead]
                for q, p in keys[1:]:
                    near = [s - q for s in places(words, p) if abs(s - q - lead) <= L.SLACK]
                    if near:
                        shifts.append(min(near, key=lambda d: (abs(d - lead), d)))
                if len(shifts) < len(keys):
                    continue
                same = 0.0
                for q, w in enumerate(text):
                    at = shifts[max(sum(k <= q for k, _ in keys) - 1, 0)] + q
                    same += idf[w] * (0 <= at < len(words) and words[at] == w)
                score = round(same / sum(idf[w] for w in text), 9)
                best = max(best, score)
                if score >= L.MIN_SCORE:
                    found.append((t.label, t.base, start))
        out.append((len(words), sorted(found), best))
    return out


def random_texts(n, seed):
    r = random.Random(seed)
    filler = "the of license public general cc by all rights reserved software a copy é under terms version 3 mit".split()
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(6)):
            words = r.choice(TEMPLATES).text.split()
            for _ in range(r.choice([0, 0, 1, 3])):
                k = r.randrange(len(words) + 1)
                words[k:k + r.choice([0, 1])] = [r.choice(filler)] * r.choice([0, 1, 4])
            parts += [r.choice([" ", "\n", "-", ", "]).join(r.choice([w, w.upper()]) for w in words), " ".join(r.choices(filler, k=r.randrange(9)))]
        texts.append(r.choice([" ", ". ", "\x00"]).join(parts))
    return texts


def check(rows, texts):
    for r, (n, found, best) in zip(rows, brute(texts)):
        assert r.n_words == n
        assert sorted((f.label, f.base, f.start) for f in r.found) == found
        assert r.score == pytest.approx(best, abs=1e-9)


def test_matches_brute_force(spark):
    texts = random_texts(250, 4)
    got = sorted(L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect(), key=lambda r: r.doc_id)
    check(got, texts)
    assert {f.label for r in got for f in r.found} == {t.label for t in TEMPLATES}


def test_digest(spark):
    rows = [(1, "All Rights\nReserved. CC-BY 4.0, GNU general public license; cc by"), (2, "plain words, cc,by? no: ccby"), (3, None), (4, "Released under the MIT License.")]
    got = {r.doc_id: tuple(r)[1:] for r in L.digest(L.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[1][:5] == (13, 4, 0, 11, "cc-by,gpl,reserved") and got[1][5].split(",") == ["cc-by", "cc-by-4.0", "gpl", "reserved"] and got[1][6] == 1.0
    assert got[2][:5] == (6, 1, 2, 2, "cc-by")
    assert got[3] == (0, 0, None, None, "", "", 0.0)
    assert got[4] == (5, 0, None, None, "", "mit", 1.0)


def test_a_word_in_every_file_and_one_in_none(spark):
    texts = ["mit license " * 400] * 30 + ["license"] * 5 + ["cc by " * 500]
    got = sorted(L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    check(got, texts)


def test_odd_rows_and_empty_table(spark):
    texts = {r[5]: r[1] for r in odd_rows()}
    want = brute(list(texts.values()))
    got = L.scan(odd_docs(spark)).collect()
    assert sorted((r.n_words, len(r.found)) for r in got) == sorted((n, len(f)) for n, f, _ in want)
    assert L.scan(no_docs(spark)).collect() == [] == L.digest(L.scan(no_docs(spark))).collect()
