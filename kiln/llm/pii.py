"""Format-preserving pseudonyms for personal data (operator 8).

Numbers, addresses and dates that pass their kind's check (Luhn, mod 97, octets,
calendar) are mapped within the set of valid values of their format by a keyed
permutation: a balanced Feistel network over the next power of four, walked until
it falls inside the set. Equal values get equal pseudonyms in every document, a
card number stays a valid card number, and with the key ``restore`` gets the
texts back. The permutation is conjugated with a shift, so no value is its own
pseudonym.

What is taken for personal data, and what stays in clear: dates of 1900 to 2099
written year-month-day with hyphens (also before ``T`` and a time), day.month.year or
day/month/year and month/day/year, each part with or without a leading zero, keep which of
their parts show two digits; other years stay. An e-mail address keeps its domain and,
in its name, signs and letters outside ASCII; so does the country code of a phone number or IBAN. Nine
digits without hyphens are a number, not an SSN, and numbers of fewer than 13 digits
without separators are left alone.

A text is a row, so the operator is one pass without a shuffle.

Defined cases: a null text stays null with zero counts; an empty text, or one
without personal data, is returned as it is; a null id is kept; repeated rows
are treated one by one; an empty table gives an empty result; other columns are
neither read nor used.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm.common import read, ship

KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
#: Stands in for a secret that a deployment passes as ``key``.
DEMO_KEY = b"kiln demonstration key"
ROUNDS = 10

_FIND = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w%+-]+(?:\.[\w%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[A-Za-z0-9]))"
    r"|(?P<date>(?<![A-Za-z0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2}:[0-9]{2})"
    r"|(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![A-Za-z0-9/-])))"
    r"|(?P<ssn>(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-]))"
    r"|(?P<phone>(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}"
    r"|[0-9]{3}(?P<s1>[.-])[0-9]{3}(?P=s1)[0-9]{4})(?![A-Za-z0-9])|(?<![A-Za-z0-9])\+[0-9]{1,3}(?:[\x20.-]?[0-9]{2,4}){2,5}(?![A-Za-z0-9]))"
    r"|(?P<card>(?<![A-Za-z0-9-])(?:[0-9]{13,19}|[0-9]{4}(?P<s2>[\x20-])[0-9]{4}(?P=s2)[0-9]{4}(?P=s2)[0-9]{4}|[0-9]{4}(?P<s3>[\x20-])[0-9]{6}(?P=s3)[0-9]{5})(?![A-Za-z0-9-]))")
#: What a text without personal data does not hold, in the syntax of Arrow's matcher.
_HINT = r"@|[0-9][0-9 ().+/-]{5,}[0-9]|[A-Z]{2}[0-9]{2}"


class Permutation:
    """A keyed permutation of range(size) without fixed points (size >= 2)."""

    def __init__(self, key: bytes, domain: str, size: int):
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.key = hashlib.blake2b(domain.encode() + b"|" + str(size).encode(), key=key[:64], digest_size=32).digest()
        self.shift = 1 + int.from_bytes(hashlib.blake2b(b"shift", key=self.key, digest_size=16).digest(), "big") % (size - 1) if size > 1 else 0

    def _f(self, i: int, x: int) -> int:
        d = hashlib.blake2b(bytes([i]) + x.to_bytes((self.half + 7) // 8, "big"), key=self.key, digest_size=(self.half + 7) // 8)
        return int.from_bytes(d.digest(), "big") & self.mask

    def _walk(self, x: int, order: range, back: bool) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in order:
                a, b = (b ^ self._f(i, a), a) if back else (b, a ^ self._f(i, b))
            x = (a << self.half) | b
            if x < self.size:
                return x

    def _mixed(self, x: int, step: int) -> int:
        y = (self._walk(x, range(ROUNDS), False) + step) % self.size
        return self._walk(y, range(ROUNDS - 1, -1, -1), True)

    def forward(self, x: int) -> int:
        return self._mixed(x, self.shift)

    def backward(self, x: int) -> int:
        return self._mixed(x, -self.shift)


@functools.lru_cache(maxsize=4096)
def permutation(key: bytes, domain: str, size: int) -> Permutation:
    return Permutation(key, domain, size)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def _poured(template: str, chars: str) -> str:
    """The template with its ASCII letters and digits replaced one after another."""
    left = iter(chars)
    return "".join(next(left) if c.isascii() and c.isalnum() else c for c in template)


def _classes(text: str, key: bytes, domain: str, way: str) -> str:
    """Permute letters and digits within their classes, the whole at once."""
    alphabets = ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text]
    size, x = 1, 0
    for c, a in zip(text, alphabets):
        size *= len(a)
        x = x * len(a) + a.index(c)
    shape = "".join(a[0] for a in alphabets)
    y = getattr(permutation(key, f"{domain}:{shape}", size), way)(x)
    out = []
    for a in reversed(alphabets):
        y, r = divmod(y, len(a))
        out.append(a[r])
    return "".join(reversed(out))


def _email(v: str, key: bytes, way: str) -> str | None:
    name, domain = v.rsplit("@", 1)
    plain = "".join(c for c in name if c.isascii() and c.isalnum())
    return _poured(name, _classes(plain, key, "email", way)) + "@" + domain if plain else None


def _ip(v: str, key: bytes, way: str) -> str | None:
    parts = v.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = functools.reduce(lambda a, p: a << 8 | int(p), parts, 0)
    y = getattr(permutation(key, "ip", 1 << 32), way)(x)
    return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))


_FIRST, _LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def _date(v: str, key: bytes, way: str) -> str | None:
    sep = next(c for c in v if not c.isdigit())
    parts = v.split(sep)
    if sep == "-":
        order = (0, 1, 2)
    elif sep == "." or int(parts[0]) > 12:
        order = (2, 1, 0)
    else:
        order = (2, 0, 1)
    try:
        day = date(*(int(parts[i]) for i in order)).toordinal()
    except ValueError:
        return None
    if not _FIRST <= day <= _LAST:
        return None
    # 08.03.1999, 8.3.1999 and 8.03.1999 are different strings of one day: each
    # part keeps the number of digits it shows, over the days that can show it
    widths = tuple(len(p) for p in parts)
    put = lambda d: sep.join(f"{x:0{widths[i]}d}" for i, x in sorted(zip(order, (d.year, d.month, d.day))))
    perm = permutation(key, "date", _LAST - _FIRST + 1)
    while True:
        day = getattr(perm, way)(day - _FIRST) + _FIRST
        new = put(date.fromordinal(day))
        if _same_form(new, sep, order, widths):
            return new


def _same_form(v: str, sep: str, order: tuple[int, ...], widths: tuple[int, ...]) -> bool:
    """Whether a reader of ``v`` takes its parts in the same order and widths."""
    parts = v.split(sep)
    return tuple(map(len, parts)) == widths and (sep != "/" or (int(parts[0]) > 12) == (order == (2, 1, 0)))


def _ssn(v: str, key: bytes, way: str) -> str | None:
    ok = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    s = v.replace("-", "")
    if not ok(s):
        return None
    perm = permutation(key, "ssn", 10**9)
    while True:
        s = f"{getattr(perm, way)(int(s)):09d}"
        if ok(s):
            return f"{s[:3]}-{s[3:5]}-{s[5:]}"


def _phone(v: str, key: bytes, way: str) -> str | None:
    digits = [c for c in v if c.isdigit()]
    country = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]", v)
    lead = len(country[0]) - 1 if country else 0
    if not 7 <= len(digits) - lead <= 14:
        return None
    tail = "".join(digits[lead:])
    y = getattr(permutation(key, "phone", 10**len(tail)), way)(int(tail))
    return _poured(v, "".join(digits[:lead]) + f"{y:0{len(tail)}d}")


def _card(v: str, key: bytes, way: str) -> str | None:
    digits = "".join(c for c in v if c.isdigit())
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    n = len(digits) - 1
    payload = f"{getattr(permutation(key, 'card', 10**n), way)(int(digits[:-1])):0{n}d}"
    return _poured(v, payload + luhn_digit(payload))


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _iban(v: str, key: bytes, way: str) -> str | None:
    s = v.replace(" ", "")
    if not 15 <= len(s) <= 34 or _iban_check(s[:2], s[4:]) != s[2:4]:
        return None
    rest = _classes(s[4:], key, f"iban:{s[:2]}", way)
    return _poured(v, s[:2] + _iban_check(s[:2], rest) + rest)


_MAPS: dict[str, Callable[[str, bytes, str], str | None]] = {
    "email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def mapped(text: str, key: bytes, way: str = "forward") -> tuple[str, dict[str, int]]:
    """The text with every valid value mapped, and how many of each kind."""
    out, done, pos, counts = [], 0, 0, dict.fromkeys(KINDS, 0)
    while m := _FIND.search(text, pos):
        kind = m.lastgroup
        new = _MAPS[kind](m[kind], key, way)
        if new is None:
            pos = m.start() + 1
            continue
        counts[kind] += 1
        out += [text[done:m.start()], new]
        done = pos = m.end()
    return "".join([*out, text[done:]]), counts


def _map_texts(docs: DataFrame, key: bytes, way: str, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            hit = pc.fill_null(pc.match_substring_regex(texts, _HINT), False).to_numpy(zero_copy_only=False)
            new, counts = texts.to_pylist(), {k: [0] * batch.num_rows for k in KINDS}
            for i in hit.nonzero()[0].tolist():
                new[i], found = mapped(new[i], key, way)
                for k, n in found.items():
                    counts[k][i] = n
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(new, texts.type), *(pa.array(counts[k], pa.int64()) for k in KINDS)],
                                             names=["id", "text", *(f"n_{k}" for k in KINDS)])

    kind = picked.schema["id"].dataType.simpleString()
    out = picked.mapInArrow(run, f"id {kind}, text string, " + ", ".join(f"n_{k} long" for k in KINDS))
    return out.withColumnsRenamed({"id": id_col, "text": text_col})


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the text with pseudonyms, and counts by kind."""
    return _map_texts(docs, key, "forward", id_col, text_col)


def restore(docs: DataFrame, key: bytes = DEMO_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverse of ``pseudonymise`` under the same key."""
    return _map_texts(docs, key, "backward", id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read(spark, sf_dir, "documents"))
