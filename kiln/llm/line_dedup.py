"""Line deduplication over a deletion neighbourhood (operator 6).

A line is dropped if an earlier line of the corpus (by document id, then place)
is within one edit of it: one character inserted, deleted or substituted. Lines
shorter than ``MIN_CHARS``, where one edit joins unlike lines, are dropped if they
equal an earlier line, or kept if they are blank.

Equal lines are first brought together by hash. Two different lines within one
edit share an untouched first or last part, so only lines that share such a part
with another line (found by hashes alone) go on. Each of these emits all its
variants, the line itself and the line without one of its characters, as hashed
keys; equal keys meet, the edit distance is verified on the texts, and the
earliest stays. Lines that lose the same character position to the same variant
are all within one edit of each other, and a variant that is a line itself is
within one edit of the lines that lead to it, so a meeting needs least members
only, not pairs. As the lines that meet are distinct, a meeting is as small as
the alphabet, whatever the corpus. Everything is DataFrame functions.

Every row has a number (its file and place there, or one that is written with
the rows at the start); places are joined back by that number, so one of
several equal rows is the earliest.

Defined cases: a null text has no lines and stays null; a null id sorts first;
rows that repeat an id count in the order of their texts' hashes, and rows equal
in id and text one after another in an order of their own; an empty table gives an
empty result; other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kiln.llm.common import bounded, numbered, read, stored

MIN_CHARS = 20
#: A variant's hash is put together from hashes of blocks of this many
#: characters, so a long line costs a block for each character, not a line.
BLOCK = 256
#: A line of these characters alone is blank.
BLANK = " \t\r\x0b\x0c"

ORDER = ("id", "th", "rf", "rn", "pos")


def _filled(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK)) != ""


def _stays_anyway(line: Column, min_chars: int) -> Column:
    return (F.length(line) < min_chars) & ~_filled(line)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, th, rf, rn, pos, line, n) of every line but short blank ones."""
    parts = docs.select("id", F.hash("text").alias("th"), "rf", "rn", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return parts.withColumn("n", F.length("line")).where(~_stays_anyway(F.col("line"), min_chars))


def _line_key(line: str = "line") -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.hash(line).alias("h2")]


def _part(n: Column) -> Column:
    """Length of the first or last part that one edit must leave whole."""
    return F.floor(n / 8).cast("int") * 4


def _ends(line: Column, c: Column) -> list[Column]:
    return [F.xxhash64(F.lit("first"), F.substr(line, F.lit(1), c)), F.xxhash64(F.lit("last"), F.right(line, c))]


def variants(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """(h1, h2, order, key, at) for every line: the line's own keys (``at`` null,
    one for each block) and one key for each character left out (``at`` its place).

    A key hashes the block number, the blocks before, the block and the blocks
    after, cut every ``block`` characters of the variant; the hashes of the
    other blocks are taken once for each block, before its characters."""
    n, line, j = F.col("n"), F.col("line"), F.col("j")
    js = F.sequence(F.lit(0), F.floor(F.length("line") / block).cast("int"))
    piece = lambda at: F.xxhash64(F.substr(line, at, F.lit(block)))
    hashed = lines.select("h1", "h2", "order", "line", F.length("line").alias("n"), js.alias("js"),
                          F.transform(js, lambda k: piece(k * block + 1)).alias("here"),
                          F.transform(js, lambda k: piece(k * block + 2)).alias("shifted"))
    rest = lambda size: F.greatest(F.ceil(size / block).cast("int") - j - 1, F.lit(0))
    blocks = hashed.select("*", F.explode("js").alias("j")).select(
        "h1", "h2", "order", "n", "j", F.substr(line, j * block + 1, F.lit(block + 1)).alias("text"),
        F.element_at("here", j + 1).alias("own"), F.xxhash64(j, F.slice("here", F.lit(1), j)).alias("before"),
        F.xxhash64(F.slice("here", j + 2, rest(n)), n).alias("after"),
        F.xxhash64(F.slice("shifted", j + 2, rest(n - 1)), n - 1).alias("after_cut"))
    last = F.least(F.lit(block), n - j * block)
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(places, lambda t: F.struct(
        F.xxhash64("before", F.xxhash64(F.concat(F.substr("text", F.lit(1), t - 1), F.substr("text", t + 1))), "after_cut").alias("key"),
        (j * block + t).alias("at")))
    whole = F.array(F.struct(F.xxhash64("before", "own", "after").alias("key"), F.lit(None).cast("int").alias("at")))
    return blocks.select("h1", "h2", "order", F.explode(F.concat(whole, cut)).alias("v")).select("h1", "h2", "order", "v.key", "v.at")


def _suspects(occurrences: DataFrame) -> DataFrame:
    """(h1, h2) of lines that share a first or last part with another line."""
    ends = occurrences.select("h1", F.explode(F.array_compact(F.array("first", "last", "first2", "last2"))).alias("end"))
    shared = stored(ends.groupBy("end").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("end"),
                    "line-ends")
    ends = occurrences.select("h1", "h2", F.explode(F.array_compact(F.array("first", "last", "first2", "last2"))).alias("end"))
    return ends.join(bounded(shared), "end", "left_semi").select("h1", "h2").distinct()


def _closer(lines: DataFrame) -> DataFrame:
    """Of suspect lines, those that share a whole half with another line of
    the length that one edit allows."""
    half = lambda size: [F.xxhash64(size, F.lit("first"), F.substr(F.col("line"), F.lit(1), F.floor(size / 2).cast("int"))),
                         F.xxhash64(size, F.lit("last"), F.right(F.col("line"), size - F.floor(size / 2).cast("int")))]
    n = F.length("line")
    halves = lines.select("h1", "h2", F.explode(F.array(*half(n), *half(n - 1))).alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half")
    close = halves.join(shared, "half", "left_semi").select("h1", "h2").distinct()
    return lines.join(close, ["h1", "h2"], "left_semi")


def _near(lines: DataFrame) -> DataFrame:
    """(h1, h2) of the lines with an earlier line within one edit; ``lines``
    has distinct lines with ``order``, their earliest place."""
    me = F.struct("order", "h1", "h2")
    rows = variants(lines).withColumn("me", me)
    by = Window.partitionBy("key")
    own, cut = F.min(F.when(F.col("at").isNull(), F.col("me"))).over(by), F.min(F.when(F.col("at").isNotNull(), F.col("me"))).over(by)
    beside = F.min("me").over(Window.partitionBy("key", "at"))
    met = rows.select("h1", "h2", "order", "at", own.alias("own"), cut.alias("cut"), beside.alias("beside"))
    met = met.select("h1", "h2", "order", F.explode(F.array_compact(
        F.when(F.col("at").isNull(), F.array("cut")).otherwise(F.array("own", "beside")))).alias("other"))
    pairs = met.where("other.order < order").select("h1", "h2", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2")).distinct()
    text = lines.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("earlier"))
    checked = pairs.join(lines.select("h1", "h2", "line"), ["h1", "h2"]).join(text, ["o1", "o2"])
    return checked.where(F.levenshtein("line", "earlier", 1) >= 0).select("h1", "h2").distinct()


def _kept(docs: DataFrame, min_chars: int) -> DataFrame:
    """(rf, rn, places): the places of the lines of ``_lines`` that a row keeps."""
    lines = _lines(docs, min_chars)
    c, c2 = _part(F.col("n")), _part(F.col("n") - 1)
    # a short line has no ends, so it meets equal lines only
    long = lambda x: F.when(F.col("n") >= min_chars, x)
    other = lambda x: F.when((F.col("n") >= min_chars) & (c2 != c), x)
    first, last = _ends(F.col("line"), c)
    first2, last2 = _ends(F.col("line"), c2)
    occurrences = stored(lines.select(*ORDER, *_line_key(), long(first).alias("first"), long(last).alias("last"),
                                      other(first2).alias("first2"), other(last2).alias("last2")), "line-hashes")
    suspects = stored(_suspects(occurrences), "line-suspects")
    texts = (lines.select(*ORDER, "line", *_line_key()).join(bounded(suspects), ["h1", "h2"], "left_semi")
             .groupBy("h1", "h2").agg(F.first("line").alias("line"), F.min(F.struct(*ORDER)).alias("order")))
    near = stored(_near(stored(_closer(stored(texts, "line-texts")), "line-close")), "line-near")
    earliest = occurrences.groupBy("h1", "h2").agg(F.min(F.struct(*ORDER)).alias("order"))
    stay = earliest.join(bounded(near), ["h1", "h2"], "left_anti")
    return stay.groupBy(F.col("order.rf").alias("rf"), F.col("order.rn").alias("rn")).agg(F.collect_set("order.pos").alias("places"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, text, n_lines, n_dropped): every input row as a struct of all its
    columns, its text without the dropped lines, and line counts."""
    rows = numbered(docs, "line-rows")
    text = F.col("row")[text_col].cast("string").alias("text")
    kept = _kept(rows.select("rf", "rn", F.col("row")[id_col].alias("id"), text), min_chars)
    joined = rows.select("row", "rf", "rn", text).join(kept, ["rf", "rn"], "left")
    places = F.coalesce("places", F.array().cast("array<int>"))

    def written(parts: Column) -> Column:
        blank = F.filter(F.transform(parts, lambda line, i: F.when(_stays_anyway(line, min_chars), i)), lambda i: i.isNotNull())
        stays = F.array_sort(F.concat(places, blank))
        return F.struct(F.size(parts).alias("n"), F.size(stays).alias("kept"), F.array_join(F.transform(stays, lambda i: F.get(parts, i)), "\n").alias("text"))

    # a one-element array binds the lines once for all uses
    out = F.element_at(F.transform(F.array(F.split("text", "\n", -1)), written), 1)
    count = lambda c: F.coalesce(F.when(F.col("text").isNotNull(), c), F.lit(0)).cast("long")
    return (joined.select("row", "text", out.alias("out"))
            .select("row", F.when(F.col("text").isNotNull(), F.col("out.text")).alias("text"),
                    count(F.col("out.n")).alias("n_lines"), count(F.col("out.n") - F.col("out.kept")).alias("n_dropped")))


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars",
            min_chars: int = MIN_CHARS) -> DataFrame:
    """The input rows and columns with the dropped lines taken out of the text
    (and the character count, where there is one, of the new text)."""
    new = {text_col: F.col("text"), chars_col: F.length("text").cast("long")}
    return dedup(docs, id_col, text_col, min_chars).select(
        *[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents")).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "text")


# One edit leaves the first or the last ten characters of a line of twenty as
# they are; the first place where the lines differ then decides. Of equal short
# lines that are not blank the earliest stays.
ORACLE_SQL = f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
placed AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split),
long AS (SELECT line, min((doc_id, pos)) AS first FROM placed WHERE length(line) >= {MIN_CHARS} GROUP BY line),
close AS (
  SELECT DISTINCT * FROM (
    SELECT a.line AS x, b.line AS y FROM long a JOIN long b ON left(a.line, 10) = left(b.line, 10)
      AND length(b.line) BETWEEN length(a.line) AND length(a.line) + 1 AND a.line <> b.line
    UNION ALL
    SELECT a.line, b.line FROM long a JOIN long b ON right(a.line, 10) = right(b.line, 10)
      AND length(b.line) BETWEEN length(a.line) AND length(a.line) + 1 AND a.line <> b.line)
  WHERE levenshtein(x, y) <= 4),
differ AS (SELECT x, y, list_position(list_transform(range(1, length(y) + 1),
    lambda i: substr(x, i, 1) = substr(y, i, 1)), false) AS p FROM close),
near AS (SELECT x, y FROM differ WHERE substr(y, p + 1) = CASE WHEN length(x) = length(y) THEN substr(x, p + 1) ELSE substr(x, p) END),
pairs AS (SELECT x AS line, y AS other FROM near UNION SELECT y, x FROM near),
dropped AS (SELECT DISTINCT pairs.line FROM pairs JOIN long a ON a.line = pairs.line JOIN long b ON b.line = other WHERE b.first < a.first),
short AS (SELECT line, min((doc_id, pos)) AS first FROM placed
  WHERE length(line) < {MIN_CHARS} AND trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '' GROUP BY line),
kept AS (SELECT placed.*, CASE WHEN length(placed.line) < {MIN_CHARS} THEN short.line IS NULL OR (doc_id, pos) = short.first
    ELSE (doc_id, pos) = long.first AND dropped.line IS NULL END AS stays
  FROM placed LEFT JOIN long USING (line) LEFT JOIN dropped USING (line) LEFT JOIN short USING (line)),
whole AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '') AS text FROM kept GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
  CASE WHEN documents.text IS NOT NULL THEN whole.text END AS text
FROM documents LEFT JOIN whole USING (doc_id)
"""
