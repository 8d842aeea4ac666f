"""Repository paths and container image references."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, strip, is_valid


def last_two_parts(c: Column | str) -> Column:
    """``host/group/name`` to ``group/name``; a value without a slash is returned as it is."""
    c = col(c)
    trimmed = strip(c)
    return F.when(F.contains(trimmed, F.lit("/")), F.substring_index(trimmed, "/", -2)).otherwise(c)


def clean_repositories(names: Column | str) -> Column:
    """Usable repository names: stripped, neither blank nor ``null``, shortened, three characters or more."""
    kept = F.filter(F.transform(col(names), strip), is_valid)
    return F.coalesce(
        F.filter(F.transform(kept, last_two_parts), lambda x: F.length(x) >= 3),
        F.array().cast("array<string>"))


def image_parts(image: Column | str) -> Column:
    """registry = up to the first slash; url = up to the first colon; name = last path part of the url.

    A registry with a port is cut at the port by these rules.
    """
    image = col(image)
    url = F.substring_index(image, ":", 1)
    return F.struct(
        F.substring_index(image, "/", 1).alias("registry"),
        F.substring_index(url, "/", -1).alias("image_name"),
        url.alias("container_url"))
