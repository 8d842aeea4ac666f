"""Small string rules used everywhere: stripping, blank handling, validity, key variants."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS = " \t\n\r\f\v"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove blanks of any kind at both ends (``trim`` alone removes only spaces)."""
    return F.btrim(col(c), F.lit(BLANKS))


def blank_to_null(c: Column | str) -> Column:
    """The empty string counts as missing."""
    c = col(c)
    return F.when(c != "", c)


def empty_to_null(c: Column | str) -> Column:
    """The empty array counts as missing."""
    c = col(c)
    return F.when(F.size(c) > 0, c)


def is_valid(c: Column | str) -> Column:
    """False for null, blank text and the word ``null`` in any case."""
    c = col(c)
    return c.isNotNull() & (strip(c) != "") & (F.lower(c) != "null")


def is_valid_list(c: Column | str) -> Column:
    """False for null and for the empty array."""
    c = col(c)
    return c.isNotNull() & (F.size(c) > 0)


def valid_or_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(is_valid(c), c)


def first_present(entries: Column | str, *keys: str) -> Column:
    """Value of the first key that occurs in a map, even when its value is null."""
    entries = col(entries)
    out = F.lit(None)
    for key in reversed(keys):
        out = F.when(F.map_contains_key(entries, F.lit(key)), F.try_element_at(entries, F.lit(key))).otherwise(out)
    return out


def business_units(c: Column | str) -> Column:
    """Comma text to a trimmed list without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), strip), lambda x: x != "")


def business_unit_list(c: Column | str) -> Column:
    """The same for a value that already is a list."""
    return F.filter(F.transform(F.coalesce(col(c), F.array().cast("array<string>")), strip),
                    lambda x: x.isNotNull() & (x != ""))


def search_term(c: Column | str, form: str = "image") -> Column:
    """Wildcard term that finds a container image (``*x*``) or a repository's cloud assets (``*x(*``)."""
    endings = {"image": "*", "repository": "(*"}
    return F.concat(F.lit("*"), col(c), F.lit(endings[form]))
