"""Checks of declared items.

An item is a map column ``m`` (key -> variant, from ``item_map``), so a missing key, a
null and a text in place of a list stay apart.  Checks add error arrays and drop no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import col
from ..schemas import RULE
from ..session import cut_lineage
from .common import dealt

# Asset types a declaration may name.
ASSET_TYPES = ["REPOSITORY", "SOURCE_CODE", "BUILD", "WEBSITE_API", "CONTAINER", "INFRA", "CLOUD", "WEB", "FOSS", "SAST"]
# Fields that must be lists.
LIST_FIELDS = ["ProviderAccountId", "ProviderAccountName", "ResourceGroup", "AccountId", "Hostnames", "OsNames",
               "Netbios", "Fqdn", "Tags", "Tags_label", "Tags_rule", "TeamNames"]
# Keys that hold rules, in the order they are loaded.
RULE_KEYS = ["MULTI_MultiConditionRules", "MultiMultiConditionRules", "MultiConditionRules", "MultiConditionRule"]

# Accepted types per field.  "texts" is a list of texts, "list" any list, "rule(s)" and
# "ticketing"/"messaging" are checked by their own tables; a trailing * marks a required field.
_TEXT_LIST_FILTERS = {f: "texts" for f in ("Fqdn", "Netbios", "OsNames", "Hostnames", "AccountId", "ProviderAccountId",
                                           "ProviderAccountName", "ResourceGroup")}
_FILTERS = {"RepositoryName": "string|list", "SearchName": "string", "AssetType": "string", "Tags": "texts",
            "Tag_rule": "string|list", "Tags_rule": "texts", "Tag_label": "string|list", "Tags_label": "texts",
            "Cidr": "string", **_TEXT_LIST_FILTERS}
_SETTINGS = {"Ticketing": "ticketing", "Messaging": "messaging"}
TABLES: dict[str, dict[str, str]] = {
    "rule": {**_FILTERS, "Tag": "string|list"},
    "component": {**_FILTERS, **_SETTINGS, "ComponentName": "string*", "Status": "string", "AppID": "integer", "Type": "string",
                  "TeamNames": "texts", "MultiConditionRule": "rule", "MULTI_MultiConditionRules": "rules", "Tier": "integer",
                  "Domain": "string", "SubDomain": "string", "AutomaticSecurityReview": "boolean", "Deployment_set": "string"},
    "application": {**_SETTINGS, "AppName": "string*", "AppID": "integer", "Status": "string", "TeamNames": "texts",
                    "BU": "string|list", "Domain": "string", "SubDomain": "string", "ReleaseDefinitions": "list*",
                    "Responsable": "string*", "Tier": "integer", "Deployment_set": "string", "Components": "list",
                    "Tag_label": "texts", "Tags_label": "texts"},
    "environment": {**_SETTINGS, "Name": "string*", "Type": "string*", "Tier": "integer*", "Status": "string*",
                    "Responsable": "string", "Responsible": "string", "TeamName": "string", "Tag_label": "list", "Services": "list"},
    "service": {**_FILTERS, **_SETTINGS, "Service": "string*", "Type": "string*", "Tier": "integer", "TeamName": "string",
                "Deployment_set": "string", "Deployment_tag": "string", "Tag": "string|list", "MultiConditionRule": "rule",
                "MULTI_MultiConditionRules": "rules", "MultiMultiConditionRules": "rules", "MultiConditionRules": "rules"},
    "ticketing": {"TIntegrationName": "string*", "Backlog": "string*"},
    "messaging": {"MIntegrationName": "string*", "Channel": "string*"},
}
_CLASS = {"string": "string", "integer": "integer", "boolean": "boolean", "list": "list", "texts": "list",
          "rules": "list", "rule": "dict", "ticketing": "list", "messaging": "list"}
ERROR = "array<struct<field:string,error:string>>"


def item_map(raw: Column | str) -> Column:
    """JSON text of an item to key -> variant."""
    return F.from_json(col(raw), "map<string,variant>")


def class_of_type(t: Column) -> Column:
    """Class of a variant from its schema text: string, integer, boolean, list, dict, null or number."""
    return (F.when(t.isNull(), None).when(t == "STRING", "string").when(F.startswith(t, F.lit("ARRAY")), "list")
            .when(F.startswith(t, F.lit("OBJECT")), "dict").when(t == "BIGINT", "integer").when(t == "BOOLEAN", "boolean")
            .when(t == "VOID", "null").otherwise("number"))


def variant_class(v: Column) -> Column:
    # Evaluated once through a one-element array; the chain of tests would repeat the schema otherwise.
    return F.get(F.transform(F.array(F.schema_of_variant(v)), class_of_type), F.lit(0))


def typed_entries(m: Column) -> Column:
    """Entries of an item with the schema and class of each value."""
    typed = F.transform(F.map_entries(m), lambda e: F.struct(
        e["key"].alias("key"), e["value"].alias("value"), F.schema_of_variant(e["value"]).alias("t")))
    return F.transform(typed, lambda e: F.struct(
        e["key"].alias("key"), e["value"].alias("value"), e["t"].alias("t"), class_of_type(e["t"]).alias("found")))


def _typed_once(m: Column, use) -> Column:
    """``use`` of the typed entries of an item that stands inside an expression; they are made once, however often it names them."""
    return F.get(F.transform(F.array(typed_entries(m)), use), F.lit(0))


def _error(field: Column, text: Column | str) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.struct(field.cast("string").alias("field"), text.cast("string").alias("error"))


def no_errors() -> Column:
    return F.array().cast(ERROR)


def _map_literal(table: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in table.items()) + ")")


def _list_literal(values: list[str]) -> Column:
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")")


def table_errors(m: Column, kind: str, entries: Column | None = None) -> Column:
    """Unknown keys, nulls, wrong types, wrong list items, unlisted asset types, missing required keys.

    ``entries`` are the item's typed entries where they have been made already.  The table is one lookup from field to its
    classes, each between bars.
    """
    table = TABLES[kind]
    classes = _map_literal({f: "|" + "|".join(_CLASS[p] for p in spec.rstrip("*").split("|")) + "|" for f, spec in table.items()})
    texts = [f for f, spec in table.items() if spec == "texts"]
    required = [f for f, spec in table.items() if spec.endswith("*")]

    def judge(e: Column) -> Column:
        wanted, found = e["wanted"], e["found"]
        bad_items = (found == "list") & ~e["t"].isin("ARRAY<STRING>", "ARRAY<VOID>") & F.array_contains(_list_literal(texts), e["key"]) if texts else F.lit(False)
        unlisted = (e["key"] == "AssetType") & ~F.coalesce(
            F.try_variant_get(e["value"], "$", "string").isin(ASSET_TYPES), F.lit(False))
        return _error(e["key"], F.when(wanted.isNull(), "unknown field").when(found == "null", "null value not allowed")
                      .when(~F.contains(wanted, F.concat(F.lit("|"), found, F.lit("|"))), F.concat(F.lit("must be "), F.btrim(wanted, F.lit("|"))))
                      .when(bad_items, "list items must be text").when(unlisted, "unallowed value"))

    wanting = F.transform(typed_entries(m) if entries is None else entries, lambda e: F.struct(
        e["key"].alias("key"), e["value"].alias("value"), e["t"].alias("t"), e["found"].alias("found"),
        F.try_element_at(classes, e["key"]).alias("wanted")))
    judged = F.filter(F.transform(wanting, judge), lambda x: x["error"].isNotNull())
    if not required:
        return judged
    lost = F.filter(_list_literal(required), lambda f: ~F.map_contains_key(m, f))
    return F.concat(judged, F.transform(lost, lambda f: _error(f, "required field")))


def _dicts_of(v: Column) -> Column:
    """The dicts a value holds: itself or the entries of a list; nulls for other values."""
    return F.coalesce(F.try_variant_get(v, "$", "array<map<string,variant>>"),
                      F.array(F.try_variant_get(v, "$", "map<string,variant>")))


def nested_maps(m: Column, key: str) -> Column:
    """The dicts under one key."""
    return F.filter(_dicts_of(F.try_element_at(m, F.lit(key))), lambda x: x.isNotNull())


def _nested_errors(entries: Column, keys: list[str], check) -> Column:
    """``check`` applied to every dict under any of the keys, fields prefixed by their key."""
    held = F.filter(entries, lambda e: F.array_contains(_list_literal(keys), e["key"]) & e["found"].isin("list", "dict"))
    return F.flatten(F.transform(held, lambda e: F.transform(
        F.flatten(F.transform(F.filter(_dicts_of(e["value"]), lambda d: d.isNotNull()), check)),
        lambda x: _error(F.concat(e["key"], F.lit("."), x["field"]), x["error"]))))


def _nested_table_errors(entries: Column, kind: str) -> Column:
    out = []
    for table in ("rule", "ticketing", "messaging"):
        keys = [f for f, spec in TABLES[kind].items() if spec.rstrip("s") == table]
        if keys:
            out.append(_nested_errors(entries, keys, _table_check(table)))
    return F.concat(*out) if out else no_errors()


def _table_check(kind: str):
    return lambda d: table_errors(d, kind)


def _own_list_errors(entries: Column) -> Column:
    listed = F.filter(entries, lambda e: e["found"].isin("string", "null") & F.array_contains(_list_literal(LIST_FIELDS), e["key"]))
    return F.transform(listed, lambda e: _error(e["key"], F.when(e["found"] == "string", "must be a list, not text")
                                                .otherwise("is null, must be a list or left out")))


def list_field_errors(m: Column, entries: Column | None = None) -> Column:
    """Fields that must be lists but hold a text or null, also inside the item's rules."""
    both = lambda e: F.concat(_own_list_errors(e), _nested_errors(e, RULE_KEYS, lambda d: _own_list_errors(typed_entries(d))))
    return _typed_once(m, both) if entries is None else both(entries)


def _given(m: Column, key: str) -> Column:
    return F.map_contains_key(m, key) & (variant_class(F.try_element_at(m, F.lit(key))) != "null")


def repository_structure_errors(m: Column) -> Column:
    """Repository and asset type belong together in a rule, and several repositories each in their own."""
    repo, kind = _given(m, "RepositoryName"), _given(m, "AssetType")
    has_rules = F.lit(False)
    for key in RULE_KEYS:
        has_rules = has_rules | F.map_contains_key(m, key)
    several = F.coalesce(F.size(F.try_variant_get(F.try_element_at(m, F.lit("RepositoryName")), "$", "array<string>")) > 1, F.lit(False))
    text = (F.when(repo & kind & has_rules, "repository and asset type beside rules")
            .when(repo & kind & several, "several repositories with asset type need one rule each")
            .when(repo & kind, "repository and asset type need a rule")
            .when(repo & ~kind & several, "several repositories without asset type"))
    return F.when(text.isNotNull(), F.array(_error(F.lit("RepositoryName"), text))).otherwise(no_errors())


def owner_errors(m: Column) -> Column:
    """One of the two owner keys must hold a text."""
    text = lambda k: F.coalesce(F.try_variant_get(F.try_element_at(m, F.lit(k)), "$", "string"), F.lit("")) != ""
    return F.when(text("Responsable") | text("Responsible"), no_errors()).otherwise(
        F.array(_error(F.lit("Responsable"), "one of Responsable, Responsible is required")))


def validate(items: DataFrame, kind: str, raw: str = "raw") -> DataFrame:
    """Adds ``stage`` (``valid`` or where it failed), ``errors`` and ``valid`` to rows with a JSON text column.

    Entries are typed once, as a column that all stages read; a stage is tried only where the ones before found nothing.
    """
    m, entries = F.col("_m"), F.col("_e")
    rows = items.withColumn("_m", item_map(raw)).withColumn("_e", typed_entries(m))
    stages: list[tuple[str, Column]] = []
    if kind != "application":
        stages.append(("list_fields", list_field_errors(m, entries)))
    stages.append(("schema", F.concat(table_errors(m, kind, entries), _nested_table_errors(entries, kind))))
    if kind in ("component", "service"):
        stages.append(("structure", repository_structure_errors(m)))
    if kind == "environment":
        stages.append(("owner", owner_errors(m)))
    rows = rows.withColumn("_r", F.struct(F.lit("valid").alias("stage"), no_errors().alias("errors")))
    for name, errors in stages:
        tried = rows.withColumn("_f", F.when(F.col("_r.stage") == "valid", errors).otherwise(no_errors()))
        failed = F.struct(F.lit(name).alias("stage"), F.col("_f").alias("errors"))
        rows = tried.withColumn("_r", F.when(F.size("_f") > 0, failed).otherwise(F.col("_r")))
    return (rows.withColumn("stage", F.col("_r.stage")).withColumn("errors", F.col("_r.errors"))
            .withColumn("valid", F.col("_r.stage") == "valid").drop("_m", "_e", "_f", "_r"))


def error_rows(validated: DataFrame, *keys: str) -> DataFrame:
    """One row per error."""
    return validated.select(*keys, "stage", F.explode("errors").alias("e")).select(*keys, "stage", "e.field", "e.error")


def _texts(m: Column, *keys: str) -> Column:
    """A list of texts from the first of ``keys`` that is given; a lone text becomes a list of one."""
    options = []
    for key in keys:
        v = F.try_element_at(m, F.lit(key))
        kind = variant_class(v)
        options.append(F.when(kind == "list", F.try_variant_get(v, "$", "array<string>")).when(
            kind == "string", F.array(F.try_variant_get(v, "$", "string"))))
    return F.coalesce(*options)


def text_of(m: Column, key: str) -> Column:
    return F.try_variant_get(F.try_element_at(m, F.lit(key)), "$", "string")


def typed_rule(m: Column) -> Column:
    """A rule dict as the RULE struct; ``AccountId`` serves where ``ProviderAccountId`` is not given."""
    from ..schemas import _top_level_fields
    fields = []
    for part in _top_level_fields(RULE[len("struct<"):-1].replace(":", " ").strip()):
        name, dtype = part[0].strip(), part[1].strip()
        if name == "ProviderAccountId":
            value = _texts(m, "ProviderAccountId", "AccountId")
        elif name == "AccountId":
            value = F.lit(None).cast("array<string>")
        elif name == "Tag_rule_text":
            value = variant_class(F.try_element_at(m, F.lit("Tag_rule"))) == "string"
        else:
            value = _texts(m, name) if dtype.startswith("array") else text_of(m, name)
        fields.append(value.alias(name))
    return F.struct(*fields)


def load_rules(m: Column | str, keys: list[str] = RULE_KEYS) -> Column:
    """Rules of an item from its rule keys in order: invalid ones and those without any value are left out."""
    m = col(m)
    found = F.concat(*[nested_maps(m, key) for key in keys])
    # A rule's keys beyond AccountId/ProviderAccountId are its own table; nulls fail the table, so a rule is empty
    # only without keys.
    good = F.filter(found, lambda d: (F.size(d) > 0) & _typed_once(d, lambda e: (F.size(list_field_errors(d, e)) == 0) & (F.size(table_errors(d, "rule", e)) == 0)))
    return F.transform(good, typed_rule)


# --- names ---------------------------------------------------------------------------------------

def repeated_names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows after the first with the same key, in ``pos`` order (joined to the first, no window over a hot key)."""
    first = rows.groupBy(*keys).agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return rows.join(first, keys).filter(F.col("pos") > F.col("first_pos"))


def duplicated_children(rows: DataFrame, parent: str, name: str) -> DataFrame:
    """Non-empty names that occur more than once under one parent, once each."""
    return (rows.filter(F.col(name) != "").groupBy(parent, name).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))


def section_findings(files: DataFrame) -> DataFrame:
    """Missing sections, wrong section types, missing or empty children; (file, severity, finding, subject).

    ``files`` has file and raw JSON text.  Errors make a file invalid, warnings and empty sections do not.
    """
    root = files.select("file", item_map("raw").alias("m"))
    def section(*names: str) -> Column:
        out = F.lit(None)
        for n in reversed(names):
            out = F.when(_truthy(F.col("m"), n), F.try_element_at("m", F.lit(n))).otherwise(out)
        return out
    root = root.select("file", section("DeploymentGroups", "Deployment Groups").alias("apps"),
                       section("Environment Groups", "EnvironmentGroups").alias("envs"))
    one = lambda cond, severity, text: F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("finding"),
                                                             F.lit(None).cast("string").alias("subject")))
    top = root.select("file", F.explode(F.filter(F.array(
        one(F.col("apps").isNull(), "error", "missing DeploymentGroups"),
        one(F.col("apps").isNotNull() & (variant_class(F.col("apps")) != "list"), "error", "DeploymentGroups is not a list"),
        one(F.col("envs").isNull(), "warning", "missing Environment Groups"),
        one(F.col("envs").isNotNull() & (variant_class(F.col("envs")) != "list"), "error", "Environment Groups is not a list"),
    ), lambda x: x.isNotNull())).alias("f")).select("file", "f.*")
    out = top
    for column, name_key, child, label in (("apps", "AppName", "Components", "Application"), ("envs", "Name", "Services", "Environment")):
        each = root.select("file", F.posexplode(F.try_variant_get(F.when(variant_class(F.col(column)) == "list", F.col(column)), "$", "array<variant>")).alias("i", "v"))
        each = each.withColumn("d", F.try_variant_get("v", "$", "map<string,variant>")).withColumn("kind", variant_class(F.col("v")))
        subject = F.coalesce(text_of(F.col("d"), name_key), F.concat(F.lit(label + "#"), (F.col("i") + 1).cast("string")))
        no_key = ~F.map_contains_key("d", child)
        finding = (F.when(F.col("kind") != "dict", F.struct(F.lit("error").alias("severity"), F.lit(f"{label} is not a mapping").alias("finding")))
                   .when(no_key & F.lit(child == "Components"), F.struct(F.lit("warning").alias("severity"), F.lit("no Components key").alias("finding")))
                   .when(~no_key & ~_truthy(F.col("d"), child), F.struct(F.lit("warning").alias("severity"), F.lit(f"empty {child}").alias("finding"))))
        out = out.unionByName(each.withColumn("_f", finding).filter(F.col("_f").isNotNull()).select(
            "file", "_f.severity", "_f.finding", subject.alias("subject")))
    return out


def _truthy(m: Column, key: str) -> Column:
    v = F.try_element_at(m, F.lit(key))
    text = F.to_json(v)
    return F.map_contains_key(m, key) & ~F.coalesce(text.isin("null", '""', "[]", "{}", "0", "false"), F.lit(True))


# --- repeated keys in raw text -------------------------------------------------------------------

# What ``strip`` of a text takes away, ASCII and Unicode white space.
_BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def _line_parts(line: Column) -> Column:
    """indent, item (whether the line opens a list item) and key of one line; null for comments, blank lines and lines without key."""
    def parts(body: Column) -> Column:
        item = F.startswith(body, F.lit("- "))
        key = F.substring_index(body, ":", 1)
        named = (key != "") & (F.length(key) < F.length(body)) & ~F.startswith(body, F.lit("#"))
        return F.when(item | named, F.struct((F.length(line) - F.length(body)).cast("long").alias("indent"), item.alias("item"),
                                             F.rtrim(key, F.lit(_BLANK)).alias("key")))

    return F.get(F.transform(F.array(F.ltrim(line, F.lit(_BLANK))), parts), F.lit(0))


def repeated_keys(texts: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line, first_line, key, indent) for every repeat of a key in raw configuration text.

    Two keys clash when they have the same indent and the same nearest open list item of smaller indent.  Keys on the item
    line itself, comments and blank lines do not count.  The nearest open item of a key is the last item line before it
    that is indented less: an item that closes it would itself be nearer.  So lines become rows, an item stands once
    for every indent of its text that lies deeper, and one running value per (text, indent) gives all parents; a long text is rows to
    sort, not one task's loop.
    """
    # The text leaves before its lines become rows, so that no row carries it.
    split = texts.filter(F.contains(text, F.lit(":"))).select(F.col(doc), F.xxhash64(text).alias("_text"), F.split(F.col(text), "\n").alias("_lines"))
    lines = split.select(doc, "_text", F.posexplode("_lines").alias("_at", "_line")).filter(F.contains("_line", F.lit(":")) | F.contains("_line", F.lit("- ")))
    # Texts are read once; keys, items and levels come from the stored lines.
    rows = cut_lineage(lines.select(doc, "_text", (F.col("_at") + 1).cast("long").alias("line"), _line_parts(F.col("_line")).alias("l")).select(
        doc, "_text", "line", "l.*").filter("item is not null"))
    keys = rows.filter("not item").select(doc, "_text", "indent", "line", "key", F.lit(None).cast("long").alias("item"))
    levels = keys.select(doc, "_text", F.col("indent").alias("_deep")).distinct()
    items = rows.filter("item").select(doc, "_text", F.col("indent").alias("_own"), "line")
    opened = items.join(dealt(levels), [doc, "_text"]).filter("_deep > _own").select(
        doc, "_text", F.col("_deep").alias("indent"), "line", F.lit(None).cast("string").alias("key"), F.col("line").alias("item"))
    before = Window.partitionBy(doc, "_text", "indent").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = keys.unionByName(opened).withColumn("_parent", F.last("item", ignorenulls=True).over(before)).filter(F.col("key").isNotNull())
    same = Window.partitionBy(doc, "_text", "indent", "_parent", "key")
    return placed.withColumn("first_line", F.min("line").over(same)).filter("line > first_line").select(doc, "line", "first_line", "key", "indent")


def repeat_advice(key: str = "key", indent: str = "indent") -> Column:
    """What to do about a repeated key: merge a section, keep one of a top-level key, or rename."""
    apps = F.col(key).isin("DeploymentGroups", "Deployment Groups")
    envs = F.col(key).isin("Environment Groups", "EnvironmentGroups")
    top = F.col(indent) == 0
    return (F.when(top & apps, "merge applications into the first section")
            .when(top & envs, "merge environments into the first section")
            .when(top, "keep the first or merge the contents").otherwise("remove or rename"))
