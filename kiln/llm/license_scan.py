"""License scans over a positional rare-token index (operator 12).

Templates are licence notices and grants as word sequences, each with mandatory
key phrases that must stand in a file word for word. The index holds, for the words of every key
phrase, postings of (phrase, position). A first pass counts in how many files each licence
word occurs; the rarest two words of a phrase, by that inverse document frequency, are its
anchors. A file that holds a phrase holds all its words, so the anchors
are the file's highest-IDF words of that phrase whatever else it holds, and no
file needs its common words looked up.

In the second pass each occurrence of an anchor is looked up, its postings turn
into candidate starts (place in the file less position in the phrase), and the
starts that both anchors name are verified word by word. A template is aligned
where its first key phrase stands and each other one stands, relative to it, within
``slack`` words of where the template has it. The alignment's score is
the IDF-weighted share of the template's words that stand where the last key
phrase before them puts them; at ``min_score`` it gives the template's label.

Both passes are one map over whole texts without a shuffle of texts; what the
driver sees and sends back is one count for each licence word.

Defined cases: a null or empty text has no words, places or labels and scores 0;
a null id is kept as null; rows that repeat an id are files of their own; equal
places of several templates are all reported; an empty table gives an empty result; other
columns are neither read nor used. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm import arrays as A
from kiln.llm.common import read, ship


class Template(NamedTuple):
    label: str
    text: str
    phrases: tuple[str, ...]
    base: bool = False


# Phrases and labels of the base rule; the whole phrase is the template.
BASE = [Template("cc-by", "cc by", ("cc by",), True), Template("gpl", "general public license", ("general public license",), True),
        Template("reserved", "all rights reserved", ("all rights reserved",), True)]

# Usual licence notices and grants, with the words that identify them.
NOTICES = [
    Template("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
             ("except in compliance with the license", "apache org licenses license 2 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
             ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
             "derived from this software without specific prior written permission", ("to endorse or promote products derived from this software",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc0", "dedicated to the public domain under cc0 1 0", ("cc0 1 0",)),
    Template("disclaimer", "the software is provided as is without warranty of any kind express or implied", ("provided as is", "without warranty of any kind")),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
             "either version 3 of the license or at your option any later version",
             ("under the terms of the gnu general public license", "as published by the free software foundation")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("with or without fee is hereby granted",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
             "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
             "distribute sublicense and or sell copies of the software",
             ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software", "released into the public domain")),
]

SLACK = 12
MIN_SCORE = 0.5
#: Alignments scored at once.
STEP = 4096

BLANK = np.ones(256, bool)
BLANK[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = False


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word, A-Z lower-cased."""
    data = A.LOWER[data]
    starts, ends, row = A.words(data, offsets, BLANK)
    return A.span_hasher(data)(starts, ends), row


def _find(words: Sequence[str], part: Sequence[str]) -> int:
    """Where ``part`` first stands in ``words``."""
    return next(i for i in range(len(words)) if words[i:i + len(part)] == part)


class Index:
    """Vocabulary, phrases and templates over word numbers; anchors once counts are given."""

    def __init__(self, templates: Sequence[Template]):
        self.templates = list(templates)
        split = [t.text.split() for t in templates]
        self.words = sorted({w for t in split for w in t})
        place = {w: i for i, w in enumerate(self.words)}
        data, offsets = A.utf8(pa.array(self.words, pa.string()))
        hashes = A.span_hasher(data)(offsets[:-1], offsets[1:])
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.texts = [np.array([place[w] for w in t]) for t in split]
        self.phrases = sorted({p for t in templates for p in t.phrases})
        self.codes = [np.array([place[w] for w in p.split()]) for p in self.phrases]
        number = {p: i for i, p in enumerate(self.phrases)}
        # of each template: (phrase, position in the template), in the order of the template
        self.keys = [sorted(((number[p], _find(w, p.split())) for p in t.phrases), key=lambda k: k[1]) for t, w in zip(templates, split)]

    def weigh(self, files: int, found: dict[int, int]) -> None:
        """IDF weights, and the anchors of each phrase as postings by word."""
        df = np.array([found.get(i, 0) for i in range(len(self.words))])
        self.idf = np.log((files + 1) / (df + 1)) + 1e-9
        self.needed = np.zeros(len(self.phrases), np.int64)
        posted = []
        for k, code in enumerate(self.codes):
            rare = sorted(range(len(code)), key=lambda i: (df[code[i]], code[i], i))[:2]
            self.needed[k] = len(rare)
            posted += [(code[i], k, i) for i in rare]
        posted.sort()
        word, self.phrase_of, self.offset_of = (np.array(c) for c in zip(*posted))
        self.first = np.searchsorted(word, np.arange(len(self.words)))
        self.postings = np.searchsorted(word, np.arange(len(self.words)), side="right") - self.first

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words outside the vocabulary."""
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)

    def stands(self, word: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
        """The starts of every phrase: candidates that all its anchors name, verified."""
        at = np.flatnonzero(word >= 0)
        at = at[self.postings[word[at]] > 0]
        times = self.postings[word[at]]
        post = np.repeat(self.first[word[at]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        phrase, start = self.phrase_of[post], np.repeat(at, times) - self.offset_of[post]
        key, named = np.unique(phrase * (len(word) + 1) + start, return_counts=True)  # starts below 0 are cut next
        phrase, start = np.divmod(key, len(word) + 1)
        good = named == self.needed[phrase]
        phrase, start = phrase[good], start[good]
        out = []
        for k, code in enumerate(self.codes):
            s = start[phrase == k]
            s = s[s + len(code) <= len(word)]
            same = row[s] == row[s + len(code) - 1] if len(s) else np.zeros(0, bool)
            for i, c in enumerate(code):
                same &= word[s + i] == c
            out.append(s[same])
        return out

    def align(self, t: int, word: np.ndarray, row: np.ndarray, stands: list[np.ndarray], slack: int) -> tuple[np.ndarray, np.ndarray]:
        """(word number of the first key phrase, score) of every alignment of a template."""
        (lead, q0), *others = self.keys[t]
        starts = stands[lead]
        shifts, alive = [starts - q0], np.ones(len(starts), bool)
        for k, q in others:
            near = stands[k] - q
            if not len(near):
                return starts[:0], np.zeros(0)
            right = np.searchsorted(near, shifts[0])
            a, b = near[np.maximum(right - 1, 0)], near[np.minimum(right, len(near) - 1)]
            best = np.where(np.abs(a - shifts[0]) <= np.abs(b - shifts[0]), a, b)
            # the nearest may stand in a neighbouring text; then the other one counts
            other = np.where(best == a, b, a)
            ok = lambda d: (np.abs(d - shifts[0]) <= slack) & (row[d + q] == row[starts])
            best = np.where(ok(best), best, other)
            alive &= ok(best)
            shifts.append(best)
        starts, shifts = starts[alive], [s[alive] for s in shifts]
        text = self.texts[t]
        owner = np.maximum(np.searchsorted([q for _, q in self.keys[t]], np.arange(len(text)), side="right") - 1, 0)
        weight = self.idf[text] / self.idf[text].sum()
        score = np.zeros(len(starts))
        for lo in range(0, len(starts), STEP):
            some = slice(lo, lo + STEP)
            place = np.stack([shifts[o][some] + q for q, o in enumerate(owner)], 1)
            inside = (place >= 0) & (place < len(word))
            place = np.where(inside, place, 0)
            same = inside & (row[place] == row[starts[some]][:, None]) & (word[place] == text)
            score[some] = np.round(same @ weight, 9)
        return starts, score

    def scan(self, texts: pa.Array, slack: int, min_score: float) -> tuple[np.ndarray, list[list[dict]], np.ndarray]:
        """(words, accepted alignments, best score) of every text of a chunk."""
        data, offsets = A.utf8(texts)
        n = len(offsets) - 1
        hashes, row = word_hashes(data, offsets)
        count = np.bincount(row, minlength=n).astype(np.int64)
        found, best = [[] for _ in range(n)], np.zeros(n)
        if not len(hashes):
            return count, found, best
        word, first = self.numbers(hashes), np.cumsum(count) - count
        stands = self.stands(word, row)
        for t, template in enumerate(self.templates):
            starts, score = self.align(t, word, row, stands, slack)
            np.maximum.at(best, row[starts], score)
            for s, r, v in zip(starts.tolist(), row[starts].tolist(), score.tolist()):
                if v >= min_score:
                    found[r].append({"label": template.label, "base": template.base, "start": s - int(first[r]), "score": v})
        return count, found, best


def document_counts(docs: DataFrame, text_col: str, index: Index) -> tuple[int, dict[int, int]]:
    """(files, {word number: files that hold it}), a row for each licence word and task before they are summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, files = np.zeros(len(index.words), np.int64), 0
        for batch in batches:
            for lo, hi in A.chunks(batch.column("text")):
                data, offsets = A.utf8(batch.column("text").slice(lo, hi - lo))
                hashes, row = word_hashes(data, offsets)
                word = index.numbers(hashes)
                mine = word >= 0
                held += np.bincount(np.unique(row[mine] * len(held) + word[mine]) % len(held), minlength=len(held))
                files += hi - lo
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(held))), pa.array(np.concatenate([[files], held]))], names=["word", "files"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word long, files long").groupBy("word").agg(F.sum("files").alias("files")).collect()
    found = {r.word: r.files for r in rows}
    return found.pop(-1, 0), found


FOUND = "array<struct<label: string, base: boolean, start: bigint, score: double>>"
_FOUND = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = tuple(BASE + NOTICES),
         slack: int = SLACK, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per input row: the id, n_words, ``found`` (label, base, start and
    score of every accepted alignment; ``start`` is the word at which its first key phrase
    stands) and the best score of any alignment."""
    ship(docs.sparkSession)
    index = Index(templates)
    index.weigh(*document_counts(docs, text_col, index))
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in A.chunks(texts):
                count, found, best = index.scan(texts.slice(lo, hi - lo), slack, min_score)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(count), pa.array(found, _FOUND), pa.array(best)],
                                                 names=["id", "n_words", "found", "score"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, n_words long, found {FOUND}, score double").withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and label lists of ``scan`` rows."""
    base = F.filter("found", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    joined = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["label"]))), ",")
    return found.select(id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("found")).alias("labels"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(read(spark, sf_dir, "documents")))
