"""Reading ``key:value`` text as tags, tag lookups, and tag arrays for components."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, strip, blank_to_null, is_valid

TAG_TYPE = "struct<key:string,value:string>"
NO_TAGS = f"array<{TAG_TYPE}>"


def tag(key: Column, value: Column) -> Column:
    return F.struct(key.cast("string").alias("key"), value.cast("string").alias("value"))


def no_tags() -> Column:
    return F.array().cast(NO_TAGS)


def _has_colon(c: Column) -> Column:
    return F.contains(c, F.lit(":"))


def _split_first_colon(c: Column) -> Column:
    head = F.substring_index(c, ":", 1)
    return tag(strip(head), strip(F.substr(c, F.length(head) + F.lit(2))))


def label_tag(c: Column | str) -> Column:
    """A label: no colon gives a value only; a risk-factor label splits at its last colon, others at the first."""
    c = col(c)
    colons = F.length(c) - F.length(F.replace(c, F.lit(":")))
    tail = F.substring_index(c, ":", -1)
    head = F.substr(c, F.lit(1), F.length(c) - F.length(tail) - F.lit(1))
    return (F.when(F.startswith(c, F.lit("RiskFactor:")) & (colons >= 2), tag(strip(head), strip(tail)))
            .when(_has_colon(c), _split_first_colon(c))
            .when(c.isNotNull(), tag(F.lit(None), c)))


def label_tags(*lists: Column | str) -> Column:
    """Labels of one or more list columns, in order, nothing removed."""
    empty = F.array().cast("array<string>")
    return F.concat(*[F.transform(F.coalesce(col(c), empty), label_tag) for c in lists])


def rule_tags(values: Column | str, mode: str) -> Column:
    """Texts of a rule field to tags.

    ``values``          never split, every text is a value
    ``first_colon``     valid texts; split at the first colon, otherwise a value
    ``strict_pairs``    valid texts, stripped; a pair needs both sides; nothing left gives null
    ``single``          as ``first_colon`` without the validity test (a lone text, not a list)
    ``first_two_parts`` split at every colon, parts one and two kept; texts without a colon are skipped
    """
    values = col(values)
    if mode == "values":
        return F.transform(values, lambda x: tag(F.lit(None), x))
    split_or_value = lambda x: F.when(_has_colon(x), _split_first_colon(x)).otherwise(tag(F.lit(None), x))
    if mode == "single":
        return F.transform(values, split_or_value)
    if mode == "first_colon":
        return F.transform(F.filter(values, is_valid), split_or_value)
    if mode == "strict_pairs":
        parsed = F.transform(F.transform(F.filter(values, is_valid), strip), split_or_value)
        kept = F.filter(parsed, lambda t: t["key"].isNull() | ((t["key"] != "") & (t["value"] != "")))
        return F.when(F.size(kept) > 0, kept)
    if mode == "first_two_parts":
        parts = F.transform(F.filter(values, _has_colon), lambda x: F.split(x, ":"))
        return F.transform(parts, lambda p: tag(strip(F.get(p, F.lit(0))), strip(F.get(p, F.lit(1)))))
    raise ValueError(f"unknown mode {mode!r}")


def short_tag_filter(values: Column | str) -> Column:
    """Plain texts as value tags, only those of three characters or more."""
    kept = F.filter(col(values), lambda x: F.length(strip(x)) >= 3)
    return F.transform(kept, lambda x: tag(F.lit(None), x))


def tag_value(tags: Column | str, key: str) -> Column:
    """Value of the last tag with this key (a repeated key: the last one wins)."""
    found = F.filter(col(tags), lambda t: t["key"] == key)
    return F.try_element_at(found, F.lit(-1))["value"]


def has_tag(tags: Column | str, key: str) -> Column:
    return F.coalesce(F.exists(col(tags), lambda t: t["key"] == key), F.lit(False))


def component_tags(*, teams: Column, domain: Column, subdomain: Column, labels: Column,
                   status: Column | None = None, kind: Column | None = None) -> Column:
    """Tag array of a component.  Creating passes status and kind, updating leaves them out."""
    fixed = []
    if status is not None:
        fixed.append(tag(F.lit("Status"), blank_to_null(status)))
    if kind is not None:
        fixed.append(tag(F.lit("Type"), blank_to_null(kind)))
    team_tags = F.transform(F.filter(F.coalesce(teams, F.array().cast("array<string>")), lambda t: t != ""),
                            lambda t: tag(F.lit("pteam"), t))
    area = F.array(tag(F.lit("domain"), blank_to_null(domain)), tag(F.lit("subdomain"), blank_to_null(subdomain)))
    head = F.array(*fixed) if fixed else no_tags()
    present = lambda arr: F.filter(arr, lambda t: t["value"].isNotNull())
    return F.concat(present(head), team_tags, present(area), labels)


def tags_text(tags: Column | str) -> Column:
    """``key=value`` pairs joined by ``|``; a compact form for reports and comparisons."""
    pairs = F.transform(col(tags), lambda t: F.concat(F.coalesce(t["key"], F.lit("")), F.lit("="),
                                                      F.coalesce(t["value"], F.lit(""))))
    return F.array_join(pairs, "|")
