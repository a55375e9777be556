"""String scalars: e-mail parts, tokens, composite splits, markup to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kiln.functions._col import as_col

__all__ = [
    "EMAIL_PATTERN", "email_domain", "last_two_labels", "is_valid_email",
    "first_token", "contains_flag", "split_part_or_null", "html_to_text",
    "round_numeric", "sentinel_to_null", "tag_score",
]

# Fixed value: the address check used by the e-mail report (dot escaped, so
# "a@bcde" is not valid).
EMAIL_PATTERN = r"^[^@]+@[^@]+\.[^@]{2,}$"


def email_domain(c) -> Column:
    """Text after the first '@', lower-cased and trimmed; null without '@'."""
    c = as_col(c)
    at = F.instr(c, "@")
    return F.when(at > 0, F.trim(F.lower(c.substr(at + 1, F.length(c)))))


def last_two_labels(c) -> Column:
    """Last two dot-separated labels: a.co.uk -> co.uk, com -> com."""
    return F.substring_index(as_col(c), ".", -2)


def is_valid_email(c) -> Column:
    return as_col(c).rlike(EMAIL_PATTERN)


def first_token(c) -> Column:
    """Leading run of non-space characters; null when there is none."""
    return F.nullif(F.regexp_extract(as_col(c), r"([^\s]+)", 1), F.lit(""))


def contains_flag(c, needle: str) -> Column:
    """Substring test; null input stays null."""
    return as_col(c).contains(needle)


def split_part_or_null(c, index: int, sep: str = "|", parts: int | None = None,
                       strict: bool = False) -> Column:
    """Part ``index`` (0-based) of a delimited string, '' -> null.

    With ``strict`` a non-null value with fewer than ``parts`` pieces raises.
    """
    c = as_col(c)
    arr = F.split(c, "\\" + sep if sep in "|.^$*+?()[]{}\\" else sep)
    part = F.nullif(F.get(arr, index), F.lit(""))
    if strict and parts:
        return F.when(c.isNotNull() & (F.size(arr) < parts),
                      F.raise_error(F.concat(F.lit("composite value has too few parts: "), c))
                      ).otherwise(part)
    return part


# Entity replacements applied by html_to_text, '&amp;' last.
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
             ("&nbsp;", " "), ("&amp;", "&")]


def html_to_text(c) -> Column:
    """Visible text of markup: drop script/style blocks, comments and tags,
    unescape the basic entities and squeeze whitespace."""
    c = as_col(c)
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", " ")
    c = F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for ent, ch in _ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    c = F.regexp_replace(c, r"[ \t\n\r]+", " ")
    return F.trim(c)


def round_numeric(c, places: int = 1) -> Column:
    """Decimal rounding (half up) so binary-double artefacts do not leak."""
    return F.round(as_col(c).cast("decimal(38,10)"), places).cast("double")


def sentinel_to_null(c, sentinel=-1) -> Column:
    return F.nullif(as_col(c), F.lit(sentinel))


# Tag tiers of the custom risk score, first match wins.
RISK_TAG_TIERS = [("%HV0%", 5), ("%HV1%", 4), ("%HV2%", 3), ("%HV3%", 2), ("%HV4%", 1)]


def tag_score(c, tiers=RISK_TAG_TIERS, default: int = 0) -> Column:
    """CASE chain over LIKE patterns; the first matching tier wins and a
    null or untagged value scores ``default``."""
    c = as_col(c)
    expr = None
    for pattern, score in tiers:
        cond = c.like(pattern)
        expr = F.when(cond, F.lit(score)) if expr is None else expr.when(cond, F.lit(score))
    return expr.otherwise(F.lit(default))
