"""Matching rules from declared fields.  All rules of a row are built in that row; nothing shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.naming import canonical_filter, list_literal, method_code, rule_name, scalar_filter, service_rule_name
from ..functions.network import cidr_list
from ..functions.repositories import clean_repositories, last_two_parts
from ..functions.tags import rule_tags, short_tag_filter, tag, tags_text
from ..functions.text import col, empty_to_null, is_valid, strip, valid_or_null

# Component field -> filter, in the order rules are made one by one.
SINGLE_RULE_FIELDS = [
    ("SearchName", "keyLike"), ("Tags", "tags"), ("RepositoryName", "repository"), ("Cidr", "cidr"),
    ("Fqdn", "fqdn"), ("Netbios", "netbios"), ("OsNames", "osNames"), ("Hostnames", "hostnames"),
    ("ProviderAccountId", "providerAccountId"), ("ProviderAccountName", "providerAccountName"),
    ("ResourceGroup", "resourceGroup"), ("AssetType", "assetType"),
]
# The order of the same fields when they go out in one batch.
BATCH_RULE_FIELDS = [
    ("SearchName", "keyLike"), ("Tags", "tags"), ("RepositoryName", "repository"), ("Cidr", "cidr"),
    ("Fqdn", "fqdn"), ("Netbios", "netbios"), ("Hostnames", "hostnames"), ("OsNames", "osNames"),
    ("ProviderAccountId", "providerAccountId"), ("ProviderAccountName", "providerAccountName"),
    ("ResourceGroup", "resourceGroup"), ("AssetType", "assetType"),
]
# Service fields beside tags and networks.
SERVICE_FIELDS = [(f, n) for f, n in SINGLE_RULE_FIELDS if f not in ("Tags", "RepositoryName", "Cidr")]
SCALAR_FIELDS = ("SearchName", "Cidr", "AssetType")


def _values(field: str) -> Column:
    """A filter field as a list of texts, null when it is missing or unusable."""
    if field in SCALAR_FIELDS:
        return F.when(is_valid(field), F.array(field))
    if field == "RepositoryName":
        return empty_to_null(clean_repositories(field))
    if field == "Tags":
        return F.transform(short_tag_filter(empty_to_null(field)), lambda t: t["value"])
    return empty_to_null(field)


def _given_fields(fields: list[tuple[str, str]]) -> Column:
    """Array of (rule_no, filter, code, values) of the usable fields, in their order."""
    rules = [F.struct(F.lit(i).alias("rule_no"), F.lit(name).alias("filter"), F.lit(method_code(name)).alias("code"), _values(field).alias("values"))
             for i, (field, name) in enumerate(fields)]
    return F.filter(F.array(*rules), lambda r: r["values"].isNotNull())


def component_rules(components: DataFrame) -> DataFrame:
    """One single-filter rule per usable field, in fixed order, named after its values.

    Needs app_name, component and the filter fields.
    """
    given = components.select("app_name", "component", F.explode(_given_fields(SINGLE_RULE_FIELDS)).alias("r"))
    return given.select("app_name", "component", "r.rule_no", "r.filter", "r.values",
                        rule_name("component", "r.filter", "r.values", F.col("r.code")).alias("rule_name"))


def component_rule_batches(components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per component with its array of rules, given but unusable fields as errors)."""
    rules = F.transform(_given_fields(BATCH_RULE_FIELDS), lambda r: F.struct(
        r["rule_no"].alias("rule_no"), r["filter"].alias("filter"), r["values"].alias("values"),
        F.concat(F.lit("Rule for "), r["filter"], F.lit(" for "), F.col("component")).alias("rule_name")))
    batches = components.select("app_name", "component", rules.alias("rules")).filter(F.size("rules") > 0)
    given = [F.struct(F.lit(name).alias("filter"), F.coalesce(
        (~is_valid(field)) & (col(field) != "") if field in SCALAR_FIELDS else (F.size(col(field)) > 0) & _values(field).isNull(),
        F.lit(False)).alias("bad")) for field, name in BATCH_RULE_FIELDS]
    errors = components.select("app_name", "component", F.explode(F.filter(F.array(*given), lambda g: g["bad"])).alias("g")).select(
        "app_name", "component", F.concat(F.lit("Invalid rule: Rule for "), "g.filter", F.lit(" for "), "component").alias("error"))
    return batches, errors


def checked_rule(filter_name: Column | str, values: Column | str) -> Column:
    """Canonical (filter, values) of one rule, null when the value is unusable.

    A search filter keeps the first text only, tags only texts of three characters or more.
    """
    name, values = canonical_filter(filter_name), col(values)
    content = (F.when(name == "keyLike", F.array(scalar_filter(values)))
               .when(name == "tags", F.filter(values, lambda v: F.length(strip(v)) >= 3))
               .otherwise(values))
    usable = (F.size(values) > 0) & ((F.size(values) > 1) | is_valid(F.get(values, F.lit(0))))
    return F.when(usable, F.struct(name.alias("filter"), content.alias("values")))


def _overwriting_tags(base: Column, rule: Column, rule_is_list: Column, rules: Column) -> Column:
    """Each later tag source that is given replaces the earlier, even with nothing."""
    listed = F.when(rule_is_list, rule_tags(rule, "strict_pairs")).otherwise(rule_tags(rule, "single"))
    return (F.when(F.size(rules) > 0, rule_tags(rules, "strict_pairs"))
            .when(F.size(rule) > 0, listed).otherwise(base))


def _tag_rule_is_list() -> Column:
    """``Tag_rule`` may be a lone text; loaders store it as a list of one and mark it."""
    return ~F.coalesce(F.col("rule.Tag_rule_text"), F.lit(False))


def _repositories(shorten: bool, valid_only: bool) -> Column:
    kept = F.filter("rule.RepositoryName", (lambda r: is_valid(r)) if valid_only else (lambda r: r != ""))
    return empty_to_null(F.transform(kept, last_two_parts)) if shorten else empty_to_null(kept)


def _list_member(name: str) -> Column:
    return empty_to_null(f"rule.{name}")


def component_multi_rules(rows: DataFrame, shorten: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rules, rejected) for rows (app_name, component, rule STRUCT): all given fields in one filter.

    ``Tags`` are values as they are; ``Tag_rule`` then ``Tags_rule`` replace them; several
    networks come before a single one; a filter without members is rejected.
    """
    tags = _overwriting_tags(F.when(F.size("rule.Tags") > 0, rule_tags("rule.Tags", "values")),
                             F.col("rule.Tag_rule"), _tag_rule_is_list(), F.col("rule.Tags_rule"))
    some = lambda name: F.when(F.col(f"rule.{name}") != "", F.col(f"rule.{name}"))
    members = {
        "keyLike": some("SearchName"), "repository": _repositories(shorten, False), "tags": tags,
        "cidrs": _list_member("Cidrs"), "cidr": F.when(_list_member("Cidrs").isNull(), some("Cidr")),
        "fqdn": _list_member("Fqdn"), "netbios": _list_member("Netbios"), "osNames": _list_member("OsNames"),
        "hostnames": _list_member("Hostnames"), "providerAccountId": _list_member("ProviderAccountId"),
        "providerAccountName": _list_member("ProviderAccountName"), "resourceGroup": _list_member("ResourceGroup"),
        "assetType": some("AssetType")}
    filled = rows.withColumn("rule_name", F.concat(F.lit("MC-R "), "component")).withColumn(
        "filter", F.struct(*[c.alias(n) for n, c in members.items()]))
    present = _any_member(members)
    return filled.filter(present), filled.filter(~present).select("app_name", "component")


def _any_member(members: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(F.col(f"filter.{n}").isNotNull(), F.lit(True)) for n in members], F.lit(False))


def service_multi_rules(rows: DataFrame, shorten: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rules, rejected) for rows (env_name, service, rule STRUCT); adds the lone ``Tag``, checks values, names
    each rule after its filter."""
    valid = lambda name: valid_or_null(f"rule.{name}")
    lone = rule_tags(F.array("rule.Tag"), "single")
    listed = rule_tags("rule.Tags", "first_colon")
    rule_list = _tag_rule_is_list()
    base = F.when(F.size("rule.Tags") > 0, listed).when(valid("Tag").isNotNull(), lone)
    tags = _overwriting_tags(base, F.filter("rule.Tag_rule", is_valid), rule_list, F.col("rule.Tags_rule"))
    accounts = empty_to_null(F.filter("rule.ProviderAccountId", is_valid))
    members = {
        "keyLike": valid("SearchName"), "repository": _repositories(shorten, True), "tags": tags,
        "assetType": valid("AssetType"), "providerAccountId": accounts,
        "providerAccountName": _list_member("ProviderAccountName"), "resourceGroup": _list_member("ResourceGroup"),
        "cidrs": _list_member("Cidrs"), "cidr": F.when(_list_member("Cidrs").isNull(), valid("Cidr")),
        "fqdn": _list_member("Fqdn"), "hostnames": _list_member("Hostnames"), "osNames": _list_member("OsNames"),
        "netbios": _list_member("Netbios")}
    shown = lambda arr: F.array_join(F.transform(arr, lambda t: F.when(
        t["key"].isNotNull(), F.concat(t["key"], F.lit("="), t["value"])).otherwise(t["value"])), ",")
    some = lambda label, text: F.when(text.isNotNull(), F.concat(F.lit(label), text))
    # A text that is empty is no detail; every given tag source leaves its own detail.
    tag_detail = lambda label, arr: F.when(F.size(arr) > 0, F.concat(F.lit(label), shown(arr)))
    single_rule = F.when(rule_list, rule_tags("rule.Tag_rule", "strict_pairs")).otherwise(
        rule_tags(F.filter("rule.Tag_rule", is_valid), "single"))
    details = [
        some("KEY:", valid("SearchName")),
        F.when(F.size(members["repository"]) > 0, F.concat(F.lit("REPO:"), F.array_join(members["repository"], ","))),
        F.when(valid("Tag").isNotNull(), tag_detail("TAG:", lone)),
        tag_detail("TAGS:", listed),
        tag_detail("TAG_RULE:", single_rule),
        tag_detail("TAGS_RULE:", rule_tags("rule.Tags_rule", "strict_pairs")),
        some("ASSET:", valid("AssetType")),
        some("PROVIDER_ACCOUNT_IDS:", list_literal(accounts)),
        some("PROVIDER_ACCOUNT_NAMES:", list_literal(members["providerAccountName"])),
        some("RESOURCE_GROUPS:", list_literal(members["resourceGroup"])),
        some("CIDRS:", list_literal(members["cidrs"])),
        some("CIDR:", members["cidr"]),
        some("FQDN:", list_literal(members["fqdn"])),
        some("HOSTNAMES:", list_literal(members["hostnames"])),
        some("OS_NAMES:", list_literal(members["osNames"])),
        some("NETBIOS:", list_literal(members["netbios"])),
    ]
    filled = rows.withColumn("filter", F.struct(*[c.alias(n) for n, c in members.items()])).withColumn(
        "rule_name", service_rule_name("service", F.filter(F.array(*details), lambda d: d.isNotNull())))
    present = _any_member(members)
    return filled.filter(present), filled.filter(~present).select("env_name", "service")


def filter_text(names: tuple[str, ...] = ("keyLike", "repository", "tags", "cidrs", "cidr", "fqdn", "netbios", "osNames",
                                          "hostnames", "providerAccountId", "providerAccountName", "resourceGroup",
                                          "assetType"), filter_col: str = "filter") -> Column:
    """A filter struct as text ``name:values;...`` in alphabetical order of names."""
    scalar = ("keyLike", "cidr", "assetType")
    def show(n: str) -> Column:
        c = F.col(f"{filter_col}.{n}")
        text = c if n in scalar else tags_text(c) if n == "tags" else F.array_join(c, ",")
        return F.when(c.isNotNull(), F.concat(F.lit(n + ":"), text))
    return F.concat_ws(";", *[show(n) for n in sorted(names)])


def service_rules(services: DataFrame) -> DataFrame:
    """Rules of services (env_name, service, Type and filter fields): one per network of ``Infra`` services,
    one per ``key:value`` tag, one per other field; all but the first named after their values."""
    base = services.select("env_name", "service", *[c for c in services.columns if c not in ("env_name", "service")])
    networks = (base.filter((F.col("Type") == "Infra") & (F.col("Cidr") != ""))
                .select("env_name", "service", F.posexplode(cidr_list("Cidr")).alias("i", "value"))
                .select("env_name", "service", F.concat(F.lit("CIDR rule for "), "service", F.lit(" - "), (F.col("i") + 1).cast("string")).alias("rule_name"),
                        F.lit("cidr").alias("filter"), F.concat(F.lit("INFRA "), "value").alias("value")))
    tag_fields = F.array(*[F.col(f) for f in ("Tag", "Tag_rule", "Tags_rule")])
    texts = F.filter(F.flatten(F.filter(tag_fields, lambda a: a.isNotNull())), lambda x: F.contains(x, F.lit(":")))
    spread = base.select("env_name", "service", F.explode(texts).alias("text")).withColumn("parts", F.split("text", ":"))
    key, value = strip(F.get("parts", F.lit(0))), strip(F.get("parts", F.lit(1)))
    by_tag = spread.select("env_name", "service", rule_name("service", F.lit("tags"), F.array(F.concat(key, F.lit(":"), value))).alias("rule_name"),
                           F.lit("tags").alias("filter"), F.concat(key, F.lit("="), value).alias("value"))
    others = []
    for field, name in SERVICE_FIELDS:
        values = F.when(F.col(field) != "", F.array(field)) if field in SCALAR_FIELDS else empty_to_null(field)
        others.append(F.struct(rule_name("service", F.lit(name), values).alias("rule_name"), F.lit(name).alias("filter"),
                               F.array_join(values, ",").alias("value")))
    single = (base.select("env_name", "service", F.explode(F.filter(F.array(*others), lambda r: r["value"].isNotNull())).alias("r"))
              .select("env_name", "service", "r.*"))
    return networks.unionByName(by_tag).unionByName(single)


def tag_rule(rows: DataFrame, key: Column | str, value: Column | str, accounts: Column | None = None) -> DataFrame:
    """A rule on one tag (of a team, a service): adds rule_name, tag_key, tag_value and the cloud accounts."""
    key, value = col(key), col(value)
    out = rows.withColumn("rule_name", F.concat(key, F.lit(" "), value)).withColumn("tag_key", key).withColumn("tag_value", value)
    return out if accounts is None else out.withColumn("provider_accounts", accounts)


def canonical_json(entries: Column | str) -> Column:
    """A filter map as JSON with its keys in order: equal filters give equal texts."""
    sorted_entries = F.array_sort(F.map_entries(col(entries)))
    return F.to_json(F.map_from_entries(sorted_entries))


def compare_rule_sets(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds ``status`` created or failed by canonical ``filter_map``, and how often the filter is expected.

    An empty or null filter always fails; null filters count as one signature.
    """
    have = existing.filter(F.size("filter_map") > 0).select(canonical_json("filter_map").alias("_sig")).distinct().withColumn("_have", F.lit(True))
    wanted = expected.withColumn("signature", canonical_json("filter_map"))
    repeats = wanted.groupBy(F.col("signature").alias("_wanted")).agg(F.count(F.lit(1)).alias("times_expected"))
    empty = F.coalesce(F.size("filter_map"), F.lit(0)) <= 0
    return (wanted.join(have, wanted["signature"] == have["_sig"], "left").drop("_sig")
            .join(repeats, F.col("signature").eqNullSafe(F.col("_wanted"))).drop("_wanted")
            .withColumn("status", F.when(F.coalesce("_have", F.lit(False)) & ~empty, "created").otherwise("failed")).drop("_have"))
