"""Names of applications, components and rules; canonical filter names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, blank_to_null

GROUP_SEPARATOR = "|||"

# Spelling of a filter (lower case) to the name rules use.
FILTER_NAMES = {
    "keylike": "keyLike", "searchname": "keyLike", "osnames": "osNames",
    "provideraccountid": "providerAccountId", "provideraccountname": "providerAccountName",
    "resourcegroup": "resourceGroup", "assettype": "assetType", "tags": "tags",
    "repository": "repository", "cidr": "cidr", "fqdn": "fqdn", "netbios": "netbios",
}

# Filter name to the code shown in rule names; other filters show in upper case.
METHOD_CODES = {
    "keyLike": "SEARCH", "tags": "TAG", "repository": "REPO", "cidr": "CIDR", "fqdn": "FQDN",
    "netbios": "NETBIOS", "osNames": "OS", "hostnames": "HOST", "providerAccountId": "ACCOUNT-ID",
    "providerAccountName": "ACCOUNT-NAME", "resourceGroup": "RESOURCE-GROUP", "assetType": "ASSET-TYPE",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def canonical_filter(name: Column | str) -> Column:
    name = col(name)
    return F.coalesce(_lookup(FILTER_NAMES, F.lower(name)), name)


def scalar_filter(values: Column | str) -> Column:
    """A search filter takes one text: the first of a list, empty when there is none."""
    return F.coalesce(F.get(col(values), F.lit(0)), F.lit(""))


def application_name(group_key: Column | str, primary: Column | str) -> Column:
    chosen = F.coalesce(col(primary), col(group_key))
    return F.substring(F.translate(chosen, " _", "--"), 1, 100)


def component_name(group_key: Column | str, primary: Column | str, secondary: Column | str,
                   template: str = "application_with_team", prefix: str = "", suffix: str = "") -> Column:
    app = application_name(group_key, primary)
    team = blank_to_null(secondary)
    by_key = F.substring(F.replace(col(group_key), F.lit(GROUP_SEPARATOR), F.lit("-")), 1, 100)
    if template == "application_with_team":
        joined = F.substring(F.replace(F.concat(app, F.lit("-"), team), F.lit(" "), F.lit("-")), 1, 100)
        name = F.when(team.isNotNull() & (team != "NoTeam"), joined).otherwise(by_key)
    elif template == "application_only":
        name = F.substring(F.concat(app, F.lit("-Component")), 1, 100)
    else:
        name = by_key
    return F.concat(F.lit(prefix), name, F.lit(suffix))


def shorten(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, the last three being dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def method_code(filter_name: str) -> str:
    """The code of a filter known when the plan is built."""
    return METHOD_CODES.get(filter_name, filter_name.upper())


def rule_name(component: Column | str, filter_name: Column | str, values: Column | str, code: Column | None = None) -> Column:
    """Method code (looked up unless given), component, the first two values and how many more there are."""
    values, filter_name = col(values), col(filter_name)
    shown = F.array_join(F.slice(values, 1, 2), ", ")
    more = F.when(F.size(values) > 2, F.concat(F.lit(" +"), (F.size(values) - 2).cast("string"))).otherwise("")
    if code is None:
        code = F.coalesce(_lookup(METHOD_CODES, filter_name), F.upper(filter_name))
    return F.concat(F.lit("R-"), code, F.lit(" for "), col(component), F.lit(" ("),
                    shorten(F.concat(shown, more), 50), F.lit(")"))


def service_rule_name(service: Column | str, details: Column | str) -> Column:
    """``details`` is an array of filter descriptions; nulls in it are skipped."""
    return shorten(F.concat(F.lit("MC-R-"), col(service), F.lit("-"), F.array_join(col(details), " AND ")), 255)


def list_literal(values: Column | str) -> Column:
    """A list as it is shown in service rule names: quoted and comma-separated, in brackets."""
    quoted = F.transform(col(values), lambda v: F.when(
        F.contains(v, F.lit("'")) & ~F.contains(v, F.lit('"')), F.concat(F.lit('"'), v, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), v, F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
