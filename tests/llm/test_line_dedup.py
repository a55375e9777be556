"""Line dedup against brute force, with edits at every kind of place."""

import random

from pyspark.sql import functions as F

from kiln.llm import line_dedup as L
from kiln.llm.common import numbered
from tests.llm.odd import no_docs, odd_docs, odd_rows


def within_one(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + 1:] == b[p + 1:] if len(a) == len(b) else a[p:] == b[p + 1:]


def brute(rows, texts_hash):
    """Per row its text without dropped lines, by comparing each line with all earlier ones."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, texts_hash[rows[k][1]]))
    seen, short, out = [], set(), [None] * len(rows)
    for k in order:
        if rows[k][1] is None:
            continue
        keep = []
        for line in rows[k][1].split("\n"):
            if len(line) < L.MIN_CHARS:
                if line not in short:
                    keep.append(line)
                if line.strip(L.BLANK):
                    short.add(line)
            else:
                if not any(within_one(line, s) for s in seen):
                    keep.append(line)
                seen.append(line)
        out[k] = "\n".join(keep)
    return out


def hashes(spark, rows):
    texts = spark.createDataFrame([(t,) for _, t in rows], "text string").selectExpr("text", "hash(text) AS h").collect()
    return {r.text: r.h for r in texts}


def check(spark, rows, df=None):
    got = L.dedup(spark.createDataFrame(rows, "doc_id long, text string") if df is None else df).collect()
    want = brute(rows, hashes(spark, rows))
    key = lambda r: tuple((v is not None, v or "") for v in r)
    assert sorted([(str(g.row.doc_id), g.row.text, g.text) for g in got], key=key) == sorted([(str(i), t, w) for (i, t), w in zip(rows, want)], key=key)
    for g in got:
        left = 0 if not g.n_lines - g.n_dropped else len(g.text.split("\n"))
        assert (g.n_lines, g.n_lines - g.n_dropped) == ((0, 0) if g.row.text is None else (len(g.row.text.split("\n")), left))


def edited(r: random.Random, s: str) -> str:
    p = r.choice([0, len(s) - 1, len(s), r.randrange(len(s))])
    c = r.choice("xyzé😀 ")
    return r.choice([s[:p] + c + s[p:], s[:p] + c + s[p + 1:], s[:p] + s[p + 1:]])


def test_matches_brute_force(spark):
    r = random.Random(5)
    pool = ["".join(r.choice("abcdé fgh") for _ in range(n)) for n in (18, 19, 20, 21, 24, 31, 32, 40, 255, 256, 257, 511, 512, 513, 800)
            for _ in range(4)] + ["a" * 40, "ab" * 150, "same line of text that recurs 1", "same line of text that recurs 2"]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(r.randrange(0, 7)):
            s = r.choice(pool)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                s = edited(r, s)
            lines.append(r.choice([s, s, "short", ""]))
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (None, pool[8] + "\nwith a null id, first of all"), (201, ""), (202, rows[5][1]), (5, rows[5][1]), (203, "\n\n")]
    check(spark, rows)


def test_other_columns_pass_and_empty_table(spark):
    schema = "h1 string, pos int, doc_id long, text string, n_chars long, line string"
    df = spark.createDataFrame([("a", 1, 1, "a line that is long enough\nx", 28, "q"), ("b", 2, 2, "a line that is long enougH\ny", 28, None)], schema)
    out = L.rewrite(df)
    assert out.schema == df.schema
    assert [(r.doc_id, r.text, r.n_chars, r.h1, r.line) for r in out.orderBy("doc_id").collect()] == [
        (1, "a line that is long enough\nx", 28, "a", "q"), (2, "y", 1, "b", None)]
    assert L.rewrite(spark.createDataFrame([], schema)).count() == 0
    assert L.rewrite(spark.createDataFrame([("a", 1, 1, None, 2, "q")], schema)).collect()[0].n_chars is None


def test_exact_repeats_of_short_lines_go(spark):
    rows = [(1, "}\nshort\n\n  \nshort\nshoRt"), (2, "short\n\n \t\na line that is long enough\n}"), (3, "shor\n\na line that is long enougH"),
            (None, "first of all"), (4, "first of all"), (5, None)]
    got = L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.row.doc_id, r.text, r.n_dropped) for r in got} == {
        (1, "}\nshort\n\n  \nshoRt", 1), (2, "\n \t\na line that is long enough", 2), (3, "shor\n", 1),
        (None, "first of all", 0), (4, "", 1), (5, None, 0)}


def test_one_of_the_rows_equal_in_id_and_text_is_the_earliest(spark):
    line = "a line that is long enough"
    rows = [(None, line)] * 3 + [(1, "another line that is long\nx")] * 2 + [(2, line)]
    got = L.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.row.doc_id), r.text) for r in got) == sorted(
        [("None", line), ("None", ""), ("None", ""), ("1", "another line that is long\nx"), ("1", ""), ("2", "")])


def test_odd_rows_and_empty_table(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    check(spark, rows, odd_docs(spark).selectExpr("*", "1 AS rn", "2 AS pos", "'l' AS line", "3 AS th").withColumnRenamed("kept", "places"))
    check(spark, rows + [(10, "\n".join(f"line {k % 700}" for k in range(9_000)))])
    assert L.dedup(no_docs(spark)).count() == L.rewrite(no_docs(spark)).count() == 0
    assert L.rewrite(odd_docs(spark)).schema == odd_docs(spark).schema


def test_rows_of_files_are_numbered_by_their_place(spark, tmp_path):
    line = "a line that is long enough"
    rows = [(None, line)] * 3 + [(1, "another line that is long\nx")] * 2 + [(2, line), (2, line), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    numbers = numbered(df, "test-rows")
    assert "kiln-test-rows" not in "".join(numbers.inputFiles())
    assert len({(r.rf, r.rn) for r in numbers.collect()}) == len(rows)
    check(spark, rows, df)
    check(spark, rows, df.where("doc_id IS NULL OR doc_id < 9"))
    for other in (df.unionByName(df.limit(0)), df.withColumn("_metadata", F.lit(1))):  # no numbers of their own
        assert "kiln-test-rows" in "".join(numbered(other, "test-rows").inputFiles())
        check(spark, rows, other)
