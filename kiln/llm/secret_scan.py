r"""Secret scans over a trigram inverted index (operator 1).

Each rule's regex is parsed and turned into a Boolean query over lower-case
trigrams that any match must contain. The index holds, for a segment of
documents and a trigram, the sorted list of the segment's documents with that
trigram; a rule's query intersects and unites these lists, and only the
documents it names are searched with the regex. A rule without a mandatory
trigram searches every text. A segment is a slice of the ids by hash that
holds a bounded number of documents, so a trigram that a third of all
documents have is many short lists, not one long one.

Everything runs in DataFrame functions: no Python reaches the executors.

Defined cases: a null text is empty and has no span; rows without an
id are not in the index and are searched by every rule; rows that repeat an id are scanned one by one; an empty
table gives an empty result; other columns are neither read nor used.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as K
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm.common import read, stored, text_or_empty

#: Documents that one segment of the index holds, on average.
SEGMENT_DOCS = 4096


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched leftmost and non-overlapping; a match counts if
    its group ``group`` has ``least`` characters or more."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # a run that is long enough is taken whole, and within a run that is too
    # short nothing longer starts, so the least length can stand in the regex
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

# A query is ("all",), ("tri", t), ("and", [...]) or ("or", [...]).
ALL = ("all",)


def _both(op: str, parts: list) -> tuple:
    if op == "and":
        parts = [p for p in parts if p != ALL]
        if not parts:
            return ALL
    elif ALL in parts:
        return ALL
    flat = list(dict.fromkeys(parts))
    if op == "or":  # a list of demands that includes another alternative's adds nothing
        flat = [p for p in flat if not any(_demands(o) < _demands(p) for o in flat)]
    return flat[0] if len(flat) == 1 else (op, tuple(flat))


def _demands(q: tuple) -> frozenset:
    return frozenset(q[1]) if q[0] == "and" else frozenset([q])


def _trigrams(text: str) -> tuple:
    return _both("and", [("tri", text[i:i + 3]) for i in range(len(text) - 2)])


#: A part of a pattern that stands for more strings than this counts as unknown.
_MOST = 64


def _strings(node) -> tuple[set[str] | None, tuple]:
    """(every lower-case string the parsed part can match, or None if there
    are too many to list; a query that holds for any text with a match)."""
    kind, arg = node
    if kind == K.LITERAL:
        return {chr(arg).lower()}, ALL
    if kind == K.IN and all(k == K.LITERAL for k, _ in arg):
        return {chr(c).lower() for _, c in arg}, ALL
    if kind == K.SUBPATTERN:
        return _sequence(arg[3])
    if kind == K.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        known = [s for s, _ in parts]
        if None not in known and len(u := set().union(*known)) <= _MOST:
            return u, ALL
        return None, _both("or", [_known(s, q) for s, q in parts])
    if kind in (K.MAX_REPEAT, K.MIN_REPEAT):
        low, high, inner = arg
        s, q = _sequence(inner)
        if low == 0:
            return (s | {""}, ALL) if high == 1 and s is not None else (None, ALL)
        return (s, q) if low == high == 1 else (None, _known(s, q))
    return None, ALL


def _known(s: set[str] | None, q: tuple) -> tuple:
    if s is None:
        return q
    return _both("and", [q, _both("or", [_trigrams(x) for x in sorted(s)])])


def _sequence(nodes) -> tuple[set[str] | None, tuple]:
    run, needs, whole = {""}, [], True
    for node in nodes:
        s, q = _strings(node)
        needs.append(q)
        if s is not None and len(run) * len(s) <= _MOST:
            run = {a + b for a in run for b in s}
            continue
        whole = False
        needs.append(_known(run, ALL))
        run = {""} if s is None else s
    if whole:
        return run, _both("and", needs)
    return None, _both("and", [*needs, _known(run, ALL)])


def trigram_query(pattern: str) -> tuple:
    """The Boolean trigram query of a regex; ``ALL`` if it has no mandatory trigram."""
    return _known(*_sequence(_parser.parse(pattern)))


def vocabulary(q: tuple) -> set[str]:
    if q[0] == "tri":
        return {q[1]}
    return set().union(*(vocabulary(p) for p in q[1])) if q[0] != "all" else set()


def build_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text",
                segments: int = 1) -> DataFrame:
    """(segment, trigram, docs): the sorted ids of the segment's documents
    that contain the trigram, for the trigrams of a rule set."""
    text = F.lower(text_or_empty(text_col))
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("text"), t))
    return (docs.select(F.col(id_col).alias("id"), text.alias("text"))
            .select("id", F.explode(held).alias("trigram"))
            .groupBy(_segment("id", segments).alias("segment"), "trigram")
            .agg(F.array_sort(F.collect_set("id")).alias("docs")))


def _segment(name: str, segments: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(segments))


def _evaluate(q: tuple, postings: Column, nothing: Column) -> Column:
    """The ids of a segment that satisfy the query; ``postings`` maps trigrams to lists."""
    if q[0] == "tri":
        return F.coalesce(F.element_at(postings, F.lit(q[1])), nothing)
    join = F.array_intersect if q[0] == "and" else F.array_union
    out = _evaluate(q[1][0], postings, nothing)
    for p in q[1][1:]:
        out = join(out, _evaluate(p, postings, nothing))
    return out


def candidates(index: DataFrame, queries: dict[str, tuple], id_type: str) -> DataFrame:
    """(id, kinds): the documents that a rule's query names, with the rules."""
    nothing = F.array().cast(f"array<{id_type}>")

    def of(kind: str, q: tuple) -> Column:
        docs = _evaluate(q, F.col("postings"), nothing)
        return F.transform(docs, lambda d: F.struct(d.alias("id"), F.lit(kind).alias("kind")))

    lists = index.groupBy("segment").agg(
        F.map_from_entries(F.collect_list(F.struct("trigram", "docs"))).alias("postings"))
    named = F.concat(*[of(k, q) for k, q in queries.items()])
    return (lists.select(F.explode(named).alias("c")).select("c.id", "c.kind")
            .groupBy("id").agg(F.collect_set("kind").alias("kinds")))


def spans_of(rule: Rule, rank: int, text: Column) -> Column:
    """The rule's spans in a text: structs (start, kind rank, kind, end), in
    code points. The pieces between matches and the matches themselves come
    from the same regex, so their lengths give each match its place."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    part = whole if rule.group == 0 else F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    steps = F.arrays_zip(gaps.alias("gap"), whole.alias("size"), part.alias("part"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>")
    state = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + F.coalesce(x["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(x["part"] >= rule.least, F.concat(acc["found"], F.array(span)))
                        .otherwise(acc["found"]).alias("found"))

    found = F.aggregate(steps, state, step, lambda acc: acc["found"])
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
         segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """One row per input row: the id, the text and ``spans``, an array of
    structs (start, rank, kind, stop) ordered by start and the rules' order."""
    picked = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != ALL}
    if indexed:
        segments = max(1, -(-picked.count() // segment_docs))
        terms = sorted(set().union(*(vocabulary(q) for q in indexed.values())))
        index = build_index(picked, terms, "id", "text", segments)
        named = stored(candidates(index, indexed, picked.schema["id"].dataType.simpleString()), "secret-candidates")
        named = named.withColumnRenamed("id", "c_id")
        picked = picked.join(named, F.col("id") == F.col("c_id"), "left").drop("c_id")
    else:
        picked = picked.withColumn("kinds", F.array().cast("array<string>"))
    found = []
    for rank, rule in enumerate(rules):
        spans = spans_of(rule, rank, F.col("text"))
        if rule.kind in indexed:
            empty = F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>")
            spans = F.when(F.array_contains("kinds", rule.kind) | F.col("id").isNull(), spans).otherwise(empty)
        found.append(spans)
    return picked.select(F.col("id").alias(id_col), "text", F.array_sort(F.concat(*found)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("assign", "access", "hex")
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return find(read(spark, sf_dir, "documents")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(_joined(F.filter(spans, lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        _joined(spans).alias("spans"))


def _sql_spans(rule: Rule, rank: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
  SELECT rid, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
      'start': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
      'rank': {rank}, 'kind': '{rule.kind}', 'size': length(m[i]), 'part': length(w[i])}}), lambda s: s.part >= {rule.least}) AS found
  FROM (SELECT rid, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {rule.group}) AS w,
               string_split_regex(t, '{p}') AS g FROM texts)"""


ORACLE_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
per_rule AS ({" UNION ALL ".join(_sql_spans(r, i) for i, r in enumerate(RULES))}),
flat AS (SELECT rid, unnest(found, max_depth := 2) FROM per_rule),
named AS (SELECT rid, kind, rank, CAST(start AS BIGINT) AS start,
                 kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT) AS span FROM flat),
joined AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base,
         string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM named GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (rid)
"""
