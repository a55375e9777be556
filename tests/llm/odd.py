"""Odd rows every operator over documents must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, kept string, row string, h1 double, block int, words int, `x.y` string"
LONG = "long word " * 20_000


def odd_rows():
    texts = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (1, "another text of the same id"), (2, None),
             (3, ""), (4, " \n\t \x0b\n"), (None, "a text without an id, alone"), (None, None), (5, LONG), (6, "x" * 50_000), (7, "é😀 " * 40),
             (8, "one two three four five six seven"), (9, "a b c d e f g " * 30)]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"src{k}", None, k, "k", None, 0.5, 1, 2, "z") for k, (i, t) in enumerate(texts)]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
