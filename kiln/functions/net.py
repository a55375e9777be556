"""Network record scalars: MAC / host normalisation, IPv4 arithmetic, ports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kiln.functions._col import as_col

__all__ = [
    "MAC_PATTERN", "mac_is_valid", "mac_normalise", "short_hostname",
    "equals_ignore_case_flag", "ipv4_to_long", "is_public_ipv4", "port_range",
    "IPV4_PATTERN", "RESERVED_IPV4_BLOCKS",
]

# Fixed value: accepted MAC spelling (six hex pairs split by ':' or '-').
MAC_PATTERN = r"^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$"
IPV4_PATTERN = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"


def mac_is_valid(c) -> Column:
    return as_col(c).rlike(MAC_PATTERN)


def mac_normalise(c) -> Column:
    """Lower-case, '-' -> ':'; null when the spelling is invalid."""
    c = as_col(c)
    return F.when(mac_is_valid(c), F.lower(F.translate(c, "-", ":")))


def short_hostname(c) -> Column:
    """Host label before the first dot, trailing dot removed, lower-case."""
    return F.lower(F.substring_index(F.regexp_replace(as_col(c), r"\.$", ""), ".", 1))


def equals_ignore_case_flag(a, b) -> Column:
    return F.when(F.lower(as_col(a)) == F.lower(as_col(b)), F.lit("Y")).otherwise(F.lit("N"))


def _once(c: Column, use) -> Column:
    """``use`` applied to ``c`` bound as a lambda variable: ``c`` is evaluated
    once and stands once in the generated code, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def ipv4_to_long(c) -> Column:
    """Dotted quad -> integer; null unless four octets in 0..255."""
    def number(octets: Column) -> Column:
        return F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: F.when((o >= 0) & (o <= 255), acc * 256 + o))

    c = as_col(c)
    octets = F.transform(F.split(c, r"\."), lambda o: o.try_cast("long"))
    return F.when(c.rlike(IPV4_PATTERN), number(octets))


# IPv4 blocks that are not publicly routed (first, last).
RESERVED_IPV4_BLOCKS = [
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("100.64.0.0", "100.127.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "255.255.255.255"),
]


def _dotted_to_int(s: str) -> int:
    a, b, c, d = (int(x) for x in s.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def is_public_ipv4(ip_long) -> Column:
    def outside(x: Column) -> Column:
        cond = x.isNotNull()
        for lo, hi in RESERVED_IPV4_BLOCKS:
            cond = cond & ~x.between(_dotted_to_int(lo), _dotted_to_int(hi))
        return cond

    return _once(as_col(ip_long), outside)


def port_range(c) -> Column:
    """1-1023 -> 0 (well known), 1024-49151 -> 1 (registered),
    49152-65535 -> 2 (dynamic), anything else incl. 0 and null -> 3."""
    c = as_col(c)
    return (F.when(c.between(1, 1023), F.lit(0))
            .when(c.between(1024, 49151), F.lit(1))
            .when(c.between(49152, 65535), F.lit(2))
            .otherwise(F.lit(3)))
