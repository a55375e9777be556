"""Cross-tokenizer alignment by an associative fragment monoid (operator 11).

Two tokenizers cut a text's bytes differently; the byte offsets where tokens of
both end cut it into groups, and every pair of an A token and a B token of a group is linked.

What lies in a byte range is a fragment: an open prefix (tokens up to the first
common end), closed groups in digested form (their ids as text, counts, linked
id pairs), and an open suffix (tokens after the last common end). Fragments of adjoining ranges
compose: the left one's suffix and the right one's prefix close one more group,
or, where a range holds no common end, go on being open. Composition is associative with the
empty fragment as its identity, so the chunks of a very long text are encoded
by different Spark tasks and composed in a tree, a bounded number in a group. A text of
one chunk is the case of one fragment, closed where it is made.

Both tokenizers always cut before a single space between two characters that
are not white space, so a text's tokens are those of the units between such spaces, and each
distinct unit is encoded once in a worker. A chunk is given the units that
overlap its byte range and keeps the tokens that end in it.

Id pairs are counted over the corpus in blocks of whole documents: a block sends
each of its pairs once, packed by deal, a hash of the A id; sums by deal give the number of documents
and the best count of each A id, and the block gets back the counts of just its pairs, in
their order. Documents refer to their block's pairs by position, so pairs
are never joined document by document.

Defined cases: a null or empty text, or one that a tokenizer does not give back
byte by byte, has no tokens and zeros; a null id is kept; rows that repeat an id are
documents of their own; an empty table gives an empty result; other columns are
neither read nor used.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm import arrays as A
from kiln.llm.common import read, ship, stored

#: Bytes of a chunk of a long text; fragments composed at once; text bytes of a block.
CHUNK, FAN, BLOCK_BYTES = 32_768, 8, 6_000_000
#: Units a worker remembers before it drops those that came up once.
REMEMBERED = 300_000
#: Units encoded in one call: an encoding holds far more than its ids.
TOGETHER = 4_000
#: Text bytes whose tokens are worked on at once.
AT_ONCE = 600_000
#: Into how many deals the id pairs of the corpus are split.
DEALS = 128
#: An id pair is one number, the A id above these bits.
BITS = 20
SAFE = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves, the others as letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Ids of space + text by a byte-level BPE file, and each id's bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        letters, names = _byte_letters(), self.model.get_vocab()
        self.bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()

    def __call__(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]


class Pieces:
    """Ids of text by a sentence-piece model, which puts the space before it, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.bytes = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
                      for i in range(m.get_piece_size())]

    def __call__(self, units: list[str]) -> list[list[int]]:
        return self.model.encode(units, num_threads=1)


class Tokens(NamedTuple):
    """Tokens of both kinds of several texts, ends counted through all of them."""
    ids: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]
    rows: tuple[np.ndarray, np.ndarray]
    ok: np.ndarray
    bases: np.ndarray


class Lists:
    """Growing lists of ids, one after another in one array."""

    def __init__(self):
        self.flat, self.bounds, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        end = int(self.bounds[self.n])
        for name, need in (("flat", end + len(flat)), ("bounds", self.n + len(sizes) + 1)):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(need - len(held), len(held)), held.dtype)]))
        self.flat[end:end + len(flat)] = flat
        self.bounds[self.n + 1:self.n + 1 + len(sizes)] = end + np.cumsum(sizes)
        self.n += len(sizes)

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the named lists one after another, length of each)."""
        first = self.bounds[index]
        each = self.bounds[index + 1] - first
        ends = np.cumsum(each)
        place = np.repeat(first - (ends - each), each)
        place += np.arange(len(place))
        return self.flat[place].astype(np.int64), each


class Encoder:
    """Token ids of whole texts by both tokenizers, unit by unit."""

    def __init__(self, path_a: str, path_b: str):
        self.sides = ByteLevel(path_a), Pieces(path_b)
        self.sizes = tuple(np.array([len(b) for b in s.bytes]) for s in self.sides)
        self.flat = tuple(np.frombuffer(b"".join(s.bytes), np.uint8) for s in self.sides)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lists, self.ok, self.again = (Lists(), Lists()), np.zeros(0, bool), np.zeros(0, bool)

    def _drop_single(self) -> None:
        """Keep the units that came up again since they were learnt: most do not."""
        kept = [u for u, i in self.known.items() if self.again[i]]
        at = np.fromiter((self.known[u] for u in kept), np.int64, len(kept))
        lists, ok = self.lists, self.ok[at]
        self._forget()
        for new, old in zip(self.lists, lists):
            ids, sizes = old.take(at)
            new.add(ids.astype(np.int32), sizes)
        self.known, self.ok, self.again = dict(zip(kept, range(len(kept)))), ok, np.zeros(len(kept), bool)

    def _learn(self, units: list[str]) -> None:
        """Encode units, and see whether both sides give their bytes back."""
        text, bounds = A.utf8(pa.array([" " + u for u in units], pa.large_string()))
        ok = np.ones(len(units), bool)
        for side, told in enumerate(s(units) for s in self.sides):
            sizes = np.fromiter(map(len, told), np.int64, len(told))
            ids = np.fromiter(itertools.chain.from_iterable(told), np.int32, int(sizes.sum()))
            self.lists[side].add(ids, sizes)
            length = self.sizes[side][ids]
            total = np.bincount(np.repeat(np.arange(len(units)), sizes), length, minlength=len(units)).astype(np.int64)
            ok &= total == np.diff(bounds)
            # the bytes of units of the right length, beside the text's
            of, mine = np.repeat(ok, sizes), np.repeat(ok, np.diff(bounds))
            each, first = length[of], (np.cumsum(self.sizes[side]) - self.sizes[side])[ids[of]]
            got = self.flat[side][np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())]
            wrong = np.repeat(np.arange(len(units)), np.diff(bounds))[mine][got != text[mine]]
            ok[wrong] = False
        self.known.update(zip(units, range(len(self.ok), len(self.ok) + len(units))))
        self.ok, self.again = np.concatenate([self.ok, ok]), np.concatenate([self.again, np.zeros(len(units), bool)])

    @staticmethod
    def _units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct units, unit numbers of all texts, units of each text)."""
        split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
        words = split.flatten().dictionary_encode()
        index, distinct = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        odd = np.array([not u or u[0].isspace() or u[-1].isspace() for u in distinct], bool)
        bad = np.flatnonzero(np.add.reduceat(odd[index], bounds[:-1]) > 0) if len(index) else np.zeros(0, np.int64)
        if not len(bad):
            return distinct, index, np.diff(bounds)
        number, parts, last = {u: i for i, u in enumerate(distinct)}, [], 0
        sizes = np.diff(bounds)
        for i in bad.tolist():
            mine = [number.setdefault(u, len(number)) for u in SAFE.split(texts[i].as_py() or "")]
            parts += [index[bounds[last]:bounds[i]], np.array(mine, np.int64)]
            sizes[i], last = len(mine), i + 1
        parts.append(index[bounds[last]:])
        return list(number), np.concatenate(parts), sizes

    def __call__(self, texts: pa.Array) -> Tokens:
        units, index, sizes = self._units(texts)
        used = np.zeros(len(units), bool)
        used[index] = True
        needed = units if used.all() else [u for u, k in zip(units, used.tolist()) if k]
        fresh = [u for u in needed if u not in self.known]
        if len(fresh) < len(needed):
            self.again[[self.known[u] for u in needed if u in self.known]] = True
        for forget in (self._drop_single, self._forget):
            if len(self.known) + len(fresh) > REMEMBERED:
                forget()
                fresh = [u for u in needed if u not in self.known]
        for lo in range(0, len(fresh), TOGETHER):
            self._learn(fresh[lo:lo + TOGETHER])
        number = np.fromiter(map(self.known.get, units, itertools.repeat(-1)), np.int64, len(units))[index]
        row = np.repeat(np.arange(len(sizes)), sizes)
        some = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > 0
        ok = some & (np.bincount(row, ~self.ok[number], minlength=len(sizes)) == 0)
        number, row = number[ok[row]], row[ok[row]]
        ids, ends, rows = [], [], []
        for side in (0, 1):
            found, each = self.lists[side].take(number)
            ids.append(found)
            ends.append(np.cumsum(self.sizes[side][found]))
            rows.append(np.repeat(row, each))
        length = np.where(ok, 1 + pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 0)
        return Tokens(tuple(ids), tuple(ends), tuple(rows), ok, np.cumsum(length) - length)


@functools.lru_cache(maxsize=2)
def encoder(path_a: str, path_b: str) -> Encoder:
    """One encoder per worker process and pair of files."""
    return Encoder(path_a, path_b)


@functools.lru_cache(maxsize=1)
def _decimals(size: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first, length) of the decimal numbers below ``size``, each with room for a mark after it."""
    text = [b"%d." % i for i in range(size)]
    length = np.fromiter(map(len, text), np.int64, size)
    return np.frombuffer(b"".join(text), np.uint8), np.cumsum(length) - length, length


def written(ids: Sequence[np.ndarray], group: Sequence[np.ndarray]) -> tuple[bytes, np.ndarray]:
    """(``a1,a2|b1;`` of all groups in order, the byte at which each group ends)."""
    (a, b), (ga, gb) = ids, group
    n = int(ga[-1]) + 1 if len(ga) else 0
    in_a, in_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
    order = np.empty(len(a) + len(b), np.int64)
    place_a, place_b = np.arange(len(a)) + (upto_b - in_b)[ga], np.arange(len(b)) + upto_a[gb]
    order[place_a], order[place_b] = a, b
    marks = np.full(len(order), ord(","), np.uint8)
    marks[place_a[upto_a - 1]], marks[place_b[upto_b - 1]] = ord("|"), ord(";")
    data, first, length = _decimals(max(1 << 16, int(order.max()) + 1 if len(order) else 0))
    each = length[order]
    ends = np.cumsum(each)
    place = np.repeat((first[order] - (ends - each)).astype(np.int32), each)
    place += np.arange(len(place), dtype=np.int32)
    out = data[place]
    out[ends - 1] = marks
    return out.tobytes(), ends[place_b[upto_b - 1]]


def linked(ids: Sequence[np.ndarray], group: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, links) of all linked pairs; long groups count equal ids first."""
    (a, b), (ga, gb) = ids, group
    n = int(ga[-1]) + 1 if len(ga) else 0
    in_a, in_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    few = np.flatnonzero(in_a * in_b <= 64)
    times = (in_a * in_b)[few]
    of = np.repeat(few, times)
    t = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    pair = (a[first_a[of] + t // in_b[of]] << BITS) | b[first_b[of] + t % in_b[of]]
    parts = [(of, pair, np.ones(len(of), np.int64))]
    for g in np.flatnonzero(in_a * in_b > 64).tolist():
        x, nx = np.unique(a[first_a[g]:first_a[g] + in_a[g]], return_counts=True)
        y, ny = np.unique(b[first_b[g]:first_b[g] + in_b[g]], return_counts=True)
        parts.append((np.full(len(x) * len(y), g), ((x[:, None] << BITS) | y).ravel(), (nx[:, None] * ny).ravel()))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _summed(pair: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(pair):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(pair, kind="stable")
    pair, links = pair[order], links[order]
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    return pair[first], np.add.reduceat(links, first)


def _common(ends: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each side's tokens, which end where one of the other side does."""
    size = max((int(e[-1]) for e in ends if len(e)), default=0) + 1
    seen = [np.zeros(size, bool), np.zeros(size, bool)]
    for s, e in zip(seen, ends):
        s[e] = True
    return seen[1][ends[0]], seen[0][ends[1]]


_NONE = np.zeros(0, np.int64)


class Fragment(NamedTuple):
    """The tokens that end in a byte range."""
    ok: bool = True
    cut: bool = False  # a common end lies in the range; if not, all tokens are in the prefix
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    prefix_a: np.ndarray = _NONE
    prefix_b: np.ndarray = _NONE
    suffix_a: np.ndarray = _NONE
    suffix_b: np.ndarray = _NONE
    pairs: np.ndarray = _NONE
    links: np.ndarray = _NONE
    body: bytes = b""  # the closed groups, each with its semicolon


def fragment(ids: Sequence[np.ndarray], ends: Sequence[np.ndarray]) -> Fragment:
    """The fragment of tokens given with their ends, both sides counted from one place."""
    n_a, n_b = map(len, ids)
    common = _common(ends)
    if not common[0].any():
        return Fragment(n_a=n_a, n_b=n_b, prefix_a=ids[0], prefix_b=ids[1])
    first = [int(c.argmax()) + 1 for c in common]
    last = [len(c) - int(c[::-1].argmax()) for c in common]
    inner = [x[f:z] for x, f, z in zip(ids, first, last)]
    group = [np.cumsum(c[f:z]) - c[f:z] for c, f, z in zip(common, first, last)]
    _, pair, links = linked(inner, group)
    return Fragment(True, True, n_a, n_b, int(common[0].sum()) - 1, int(links.sum()), ids[0][:first[0]], ids[1][:first[1]], ids[0][last[0]:], ids[1][last[1]:],
                    *_summed(pair, links), written(inner, group)[0])


def _closed(a: np.ndarray, b: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(text, pairs, links) of one group."""
    zeros = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    return written((a, b), zeros)[0], *linked((a, b), zeros)[1:]


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two adjoining ranges."""
    n = dict(ok=x.ok and y.ok, n_a=x.n_a + y.n_a, n_b=x.n_b + y.n_b)
    joined = lambda p, q: np.concatenate([p, q])
    if not x.cut:
        return y._replace(**n, prefix_a=joined(x.prefix_a, y.prefix_a), prefix_b=joined(x.prefix_b, y.prefix_b))
    if not y.cut:
        return x._replace(**n, suffix_a=joined(x.suffix_a, y.prefix_a), suffix_b=joined(x.suffix_b, y.prefix_b))
    text, pair, links = _closed(joined(x.suffix_a, y.prefix_a), joined(x.suffix_b, y.prefix_b))
    return Fragment(cut=True, **n, n_groups=x.n_groups + 1 + y.n_groups, n_links=x.n_links + int(links.sum()) + y.n_links,
                    prefix_a=x.prefix_a, prefix_b=x.prefix_b, suffix_a=y.suffix_a, suffix_b=y.suffix_b,
                    **dict(zip(("pairs", "links"), _summed(np.concatenate([x.pairs, pair, y.pairs]), np.concatenate([x.links, links, y.links])))),
                    body=x.body + text + y.body)


#: Stands before a text: its start is a common end.
START = Fragment(cut=True)


class Document(NamedTuple):
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: bytes
    pairs: np.ndarray
    links: np.ndarray


EMPTY = Document(0, 0, 0, 0, b"", _NONE, _NONE)


def closed(f: Fragment) -> Document:
    """The document of a whole text's fragment; its end is a common end."""
    if not f.ok or not f.cut:
        return EMPTY
    f = compose(START, f)
    return Document(f.n_a, f.n_b, f.n_groups, f.n_links, f.body[:-1], f.pairs, f.links)


def documents(tokens: Tokens) -> Iterator[Document]:
    """The documents of whole texts, each one closed fragment."""
    n = len(tokens.ok)
    common = _common(tokens.ends)
    group = [np.cumsum(c) - c for c in common]
    of = tokens.rows[0][common[0]]  # the text of each group
    n_a, n_b = (np.bincount(r, minlength=n).tolist() for r in tokens.rows)
    n_groups = np.bincount(of, minlength=n)
    if not len(of):
        yield from [EMPTY] * n
        return
    text, ends = written(tokens.ids, group)
    g, pair, links = linked(tokens.ids, group)
    row_pair, links = _summed((of[g] << (2 * BITS)) | pair, links)
    row, pair = row_pair >> (2 * BITS), row_pair & ((1 << 2 * BITS) - 1)
    bounds = np.searchsorted(row, np.arange(n + 1)).tolist()
    n_links = np.bincount(row, links, minlength=n).astype(np.int64).tolist()
    upto = np.concatenate([[0], np.cumsum(n_groups)])
    stops = np.concatenate([[0], ends])[upto].tolist()
    n_groups = n_groups.tolist()
    for i in range(n):
        if n_groups[i]:
            some = slice(bounds[i], bounds[i + 1])
            yield Document(n_a[i], n_b[i], n_groups[i], n_links[i], text[stops[i]:stops[i + 1] - 1], pair[some], links[some])
        else:
            yield EMPTY


# blocks of documents -----------------------------------------------------------

_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _block_schema(kind: str) -> str:
    return (f"block long, deal int, n long, blob binary, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "groups string, refs array<int>, links array<long>")


class Blocks:
    """Gathers documents into blocks; a block tells its pairs deal by deal (with
    the number of its documents that hold each), then its documents, which
    refer to pairs by their place in that order."""

    def __init__(self, side: int, id_type: pa.DataType, keep_groups: bool):
        self.next, self.id_type, self.keep = (TaskContext.get().partitionId() << 32) | side, id_type, keep_groups
        self.ids, self.docs, self.size = [], [], 0

    def add(self, i, doc: Document, size: int) -> Iterator[pa.RecordBatch]:
        if self.size and self.size + size > BLOCK_BYTES:
            yield from self.told()
        whole = doc.groups.decode("ascii") if self.keep else None
        self.ids.append(i)
        self.docs.append((doc[:4], hashlib.sha256(doc.groups).hexdigest() if doc.n_groups else "", whole, doc.pairs, doc.links))
        self.size += size

    def told(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        pairs, at, docs = np.unique(np.concatenate([d[3] for d in self.docs]), return_inverse=True, return_counts=True)
        place = (A.mix((pairs >> BITS).astype(np.uint64)) % np.uint64(DEALS)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        pairs, docs, at = pairs[order], docs[order], rank[at]
        bounds = np.searchsorted(place[order], np.arange(DEALS + 1)).tolist()
        names = ["block", "deal", "n", "blob", "id", *_COUNTS, "groups_sha256", "groups", "refs", "links"]
        lists = pa.list_(pa.int32()), pa.list_(pa.int64())

        def batch(n: int, /, **given: pa.Array) -> pa.RecordBatch:
            kinds = dict(deal=pa.int32(), blob=pa.binary(), id=self.id_type, groups_sha256=pa.string(), groups=pa.string(), refs=lists[0], links=lists[1])
            given["block"] = pa.array(np.full(n, self.next))
            return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names=names)

        some = [(d, lo, hi) for d, (lo, hi) in enumerate(zip(bounds, bounds[1:])) if hi > lo]
        yield batch(len(some), deal=pa.array([d for d, _, _ in some], pa.int32()), n=pa.array([hi - lo for _, lo, hi in some], pa.int64()),
                    blob=pa.array([A.pack(pairs[lo:hi], docs[lo:hi]) for _, lo, hi in some], pa.binary()))
        ends = np.cumsum([0, *(len(d[3]) for d in self.docs)])
        for lo in range(0, len(self.docs), 2_000):
            some = self.docs[lo:lo + 2_000]
            begin, stop = ends[lo], ends[lo + len(some)]
            offsets = pa.array(ends[lo:lo + len(some) + 1] - begin, pa.int32())
            yield batch(len(some), id=pa.array(self.ids[lo:lo + len(some)], self.id_type),
                        **{c: pa.array([d[0][k] for d in some], pa.int64()) for k, c in enumerate(_COUNTS)},
                        groups_sha256=pa.array([d[1] for d in some], pa.string()), groups=pa.array([d[2] for d in some], pa.string()),
                        refs=pa.ListArray.from_arrays(offsets, pa.array(at[begin:stop])),
                        links=pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([d[4] for d in some]))))
        self.next, self.ids, self.docs, self.size = self.next + 2, [], [], 0


def _short(picked: DataFrame, paths: tuple[str, str], chunk: int, keep_groups: bool) -> DataFrame:
    """Block rows of the texts of one chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = None
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            blocks = blocks or Blocks(0, ids.type, keep_groups)
            for lo, hi in A.chunks(texts, AT_ONCE):
                part = texts.slice(lo, hi - lo)
                sizes = pc.fill_null(pc.binary_length(part), 0).to_pylist()
                for i, doc, size in zip(ids.slice(lo, hi - lo).to_pylist(), documents(encoder(*paths)(part)), sizes):
                    yield from blocks.add(i, doc, size)
        if blocks:
            yield from blocks.told()

    fits = F.coalesce(F.octet_length("text") <= chunk, F.lit(True))
    return picked.where(fits).mapInArrow(run, _block_schema(picked.schema["id"].dataType.simpleString()))


# very long texts ---------------------------------------------------------------


def ranges(text: str, chunk: int) -> Iterator[tuple[str, int, int]]:
    """(units, from, to) of every range of ``chunk`` bytes of space + text: the
    text of the units that overlap it, and the range's bounds counted from the space before them."""
    data = b" " + text.encode()
    # safe spaces by their place in bytes
    chars = np.fromiter((m.start() for m in SAFE.finditer(text)), np.int64)
    raw = np.frombuffer(data, np.uint8)[1:]
    first = np.flatnonzero((raw & 0xC0) != 0x80) + 1
    safe = np.concatenate([[0], first[chars], [len(data)]])
    for lo in range(0, len(data), chunk):
        hi = min(lo + chunk, len(data))
        begin = int(safe[np.searchsorted(safe, lo, side="right") - 1])
        stop = int(safe[np.searchsorted(safe, hi)])
        yield data[begin + 1:stop].decode(), lo - begin, hi - begin


_FRAGMENT = ("row long, id {}, place long, ok boolean, cut boolean, n_a long, n_b long, n_groups long, n_links long, "
             "prefix_a array<long>, prefix_b array<long>, suffix_a array<long>, suffix_b array<long>, pairs array<long>, links array<long>, body binary")
_LISTS = {"prefix_a", "prefix_b", "suffix_a", "suffix_b", "pairs", "links"}


def _told(row: pa.Array, ids: pa.Array, place: pa.Array, found: list[Fragment]) -> list[pa.Array]:
    kinds = {"ok": pa.bool_(), "cut": pa.bool_(), "body": pa.binary()} | {c: pa.list_(pa.int64()) for c in _LISTS}
    return [row, ids, place, *(pa.array([getattr(f, c) for f in found], kinds.get(c, pa.int64())) for c in Fragment._fields)]


_NAMES = ["row", "id", "place", *Fragment._fields]


def _given(table: pa.Table | pa.RecordBatch) -> list[Fragment]:
    columns = [[np.array(v, np.int64) for v in table[c].to_pylist()] if c in _LISTS else table[c].to_pylist() for c in Fragment._fields]
    return [Fragment(*values) for values in zip(*columns)]


def _long(picked: DataFrame, paths: tuple[str, str], chunk: int, fan: int, keep_groups: bool) -> DataFrame:
    """Block rows of longer texts, whose chunks are dealt over tasks and composed in a tree."""
    kind = picked.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                for place, (units, lo, hi) in enumerate(ranges(one.column("text")[0].as_py(), chunk)):
                    yield pa.RecordBatch.from_arrays([one.column("row"), one.column("id"), *(pa.array([v]) for v in (place, units, lo, hi))],
                                                     names=["row", "id", "place", "text", "lo", "hi"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in A.chunks(texts, AT_ONCE):
                tokens = encoder(*paths)(texts.slice(lo, hi - lo))
                of = [[slice(*np.searchsorted(r, [i, i + 1])) for r in tokens.rows] for i in range(hi - lo)]
                found = []
                for i, (begin, stop) in enumerate(zip(batch.column("lo").to_pylist()[lo:hi], batch.column("hi").to_pylist()[lo:hi])):
                    ends = [e[s] - tokens.bases[i] for e, s in zip(tokens.ends, of[i])]
                    mine = [(e > begin) & (e <= stop) for e in ends]
                    f = fragment([x[s][m] for x, s, m in zip(tokens.ids, of[i], mine)], [e[m] for e, m in zip(ends, mine)])
                    found.append(f._replace(ok=bool(tokens.ok[i])))
                some = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(_told(some.column("row"), some.column("id"), some.column("place"), found), names=_NAMES)

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        whole = functools.reduce(compose, _given(table))
        head = table.slice(0, 1)
        return pa.Table.from_arrays(_told(head["row"].combine_chunks(), head["id"].combine_chunks(), pa.array([head["place"][0].as_py() // fan]), [whole]),
                                    names=_NAMES)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = None
        for batch in batches:
            blocks = blocks or Blocks(1, batch.column("id").type, keep_groups)
            for i, f in zip(batch.column("id").to_pylist(), _given(batch)):
                yield from blocks.add(i, closed(f), len(f.body))
        if blocks:
            yield from blocks.told()

    longer = picked.where(F.octet_length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    parts = stored(longer.mapInArrow(cut, f"row long, id {kind}, place long, text string, lo long, hi long"), "align-chunks")
    last = parts.agg(F.max("place")).first()[0] or 0
    schema = _FRAGMENT.format(kind)
    found = parts.repartition("row", "place").mapInArrow(encode, schema)
    while last:
        found = found.groupBy("row", F.floor(F.col("place") / fan).alias("to")).applyInArrow(joined, schema)
        last //= fan
    return found.mapInArrow(finish, _block_schema(kind))


# corpus counts -----------------------------------------------------------------


def _sums(blocks: DataFrame) -> DataFrame:
    """(deal, n, blob): the pairs of each deal with their documents in the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, size, merged = None, [], 0, 0

        def told() -> Iterator[pa.RecordBatch]:
            if parts:
                pairs, docs = _merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([len(pairs)]), pa.array([A.pack(pairs, docs)], pa.binary())],
                                                 names=["deal", "n", "blob"])

        for batch in batches:
            for place, n, blob in zip(batch.column("deal").to_pylist(), batch.column("n").to_pylist(), batch.column("blob")):
                if place != at:
                    yield from told()
                    at, parts, size, merged = place, [], 0, 0
                parts.append(A.unpack(blob, n))
                size += n
                if size > 2 * merged + 500_000:
                    parts = [_merged(parts)]
                    size = merged = len(parts[0][0])
        yield from told()

    held = blocks.where(F.col("deal").isNotNull()).select("deal", "n", "blob")
    return held.repartition("deal").sortWithinPartitions("deal").mapInArrow(run, "deal int, n long, blob binary")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _summed(*(np.concatenate(c) for c in zip(*parts)))


def _best(pairs: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether no pair of the A id has more documents; a deal holds all pairs of its A ids."""
    a = pairs >> BITS
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return docs == np.repeat(np.maximum.reduceat(docs, first), np.diff(np.append(first, len(a))))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, docs, best): in how many documents an id pair is linked, and
    whether no pair of its A id is linked in more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, blob in zip(batch.column("n").to_pylist(), batch.column("blob")):
                pairs, docs = A.unpack(blob, n)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (pairs >> BITS, pairs & ((1 << BITS) - 1), docs, _best(pairs, docs))],
                                                 names=["a", "b", "docs", "best"])

    return _sums(blocks).mapInArrow(run, "a long, b long, docs long, best boolean")


def _told_back(blocks: DataFrame) -> DataFrame:
    """(block, deal, n, blob): for each pair of a block, in its order, the
    corpus's documents twice, and 1 if no pair of its A id has more."""
    held = blocks.where(F.col("deal").isNotNull()).select("block", "deal", "n", "blob", F.lit(1).alias("rank"))
    sums = stored(_sums(blocks), "align-sums").select(F.lit(None).cast("long").alias("block"), "deal", "n", "blob", F.lit(0).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = values = None
        for batch in batches:
            for block, place, n, rank, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "deal", "n", "rank")), batch.column("blob")):
                mine, docs = A.unpack(blob, n)
                if rank == 0:
                    pairs, values = mine, 2 * docs + _best(mine, docs)
                    continue
                back = pa.compress(A.planes(values[np.searchsorted(pairs, mine)]), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([place], pa.int32()), pa.array([n]), pa.array([back], pa.binary())],
                                                 names=["block", "deal", "n", "blob"])

    placed = held.unionByName(sums).repartition("deal").sortWithinPartitions("deal", "rank")
    return placed.mapInArrow(run, "block long, deal int, n long, blob binary")


def block_rows(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
               fan: int = FAN, keep_groups: bool = False) -> DataFrame:
    """The stored blocks of a corpus: packed pair rows and document rows."""
    ship(docs.sparkSession)
    paths = paths or vocabulary_paths()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(_short(picked, paths, chunk, keep_groups).unionByName(_long(picked, paths, chunk, fan, keep_groups)), "align-blocks")


def align(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, fan: int = FAN,
          keep_groups: bool = False) -> DataFrame:
    """One row per input row: the id, n_a, n_b, n_groups, n_links, n_best,
    count_sum and groups_sha256, and, with ``keep_groups``, the groups as text."""
    blocks = block_rows(docs, paths, id_col, text_col, chunk, fan, keep_groups)
    kept = ["id", *_COUNTS, "groups_sha256", *(["groups"] if keep_groups else []), "refs", "links"]
    rows = blocks.where(F.col("deal").isNull()).select("block", *kept)
    both = (_told_back(blocks).unionByName(rows, allowMissingColumns=True).withColumn("rank", F.col("deal").isNull())
            .repartition("block").sortWithinPartitions("block", "rank", "deal"))
    return both.mapInArrow(_scored(kept), _result_schema(blocks.schema["id"].dataType.simpleString(), keep_groups)).withColumnRenamed("id", id_col)


def _result_schema(kind: str, keep_groups: bool) -> str:
    return (f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
            + (", groups string" if keep_groups else ""))


def _scored(kept: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From a block's counts, in the order of its pairs, and its documents to results."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, table = None, [], None
        for batch in batches:
            block, rank = batch.column("block").to_numpy(), batch.column("rank").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((block[1:] != block[:-1]) | (rank[1:] != rank[:-1])) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(block)]):
                if block[lo] != at:
                    at, parts, table = block[lo], [], None
                part = batch.slice(lo, hi - lo)
                if not rank[lo]:
                    parts += [A.from_planes(np.frombuffer(pa.decompress(blob.as_buffer(), 8 * n, "zstd"), np.uint8), n).view(np.int64)
                              for n, blob in zip(part.column("n").to_pylist(), part.column("blob"))]
                    continue
                if table is None:
                    whole = np.concatenate([_NONE, *parts])
                    table, parts = (whole >> 1, whole & 1), []
                refs, links = part.column("refs"), part.column("links").flatten().to_numpy()
                size = pc.list_value_length(refs).to_numpy()
                of, pair = np.repeat(np.arange(hi - lo), size), refs.flatten().to_numpy()
                total = np.zeros((2, hi - lo), np.int64)
                np.add.at(total[0], of, links * table[1][pair])
                np.add.at(total[1], of, links * table[0][pair])
                columns = dict(zip(kept, (part.column(c) for c in kept))) | {"n_best": pa.array(total[0]), "count_sum": pa.array(total[1])}
                names = ["id", *_COUNTS, "n_best", "count_sum", *kept[5:-2]]
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents"))
