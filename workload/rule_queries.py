"""Queries over matching rules and action rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.functions import tags
from tallyline.functions.repositories import last_two_parts
from tallyline.operators import actions, placement, rules

from .function_queries import _COMPONENT_TAGS
from .registry import query

# The usable filter values of a component, one row per field.
_FIELDS = r"""
repos as (select component_id, string_agg(s, ',' order by i) as vals from (
    select component_id, i, case when trim(x) like '%/%' then regexp_extract(trim(x), '([^/]*/[^/]*)$', 1) else trim(x) end as s from (
      select component_id, unnest(RepositoryName) as x, generate_subscripts(RepositoryName, 1) as i from @declared_component) where trim(x) <> '' and lower(trim(x)) <> 'null')
  where length(s) >= 3 group by component_id),
f as (
  select component_id, component, 0 as rule_no, 'keyLike' as filter, SearchName as vals from @declared_component where trim(SearchName) <> '' and lower(SearchName) <> 'null'
  union all select component_id, component, 1, 'tags', array_to_string(list_filter(Tags, lambda x: length(trim(x)) >= 3), ',') from @declared_component where len(Tags) > 0
  union all select component_id, component, 2, 'repository', vals from repos join @declared_component using (component_id)
  union all select component_id, component, 3, 'cidr', Cidr from @declared_component where Cidr <> ''
  union all select component_id, component, 4, 'fqdn', array_to_string(Fqdn, ',') from @declared_component where len(Fqdn) > 0
  union all select component_id, component, 6, 'osNames', array_to_string(OsNames, ',') from @declared_component where len(OsNames) > 0
  union all select component_id, component, 7, 'hostnames', array_to_string(Hostnames, ',') from @declared_component where len(Hostnames) > 0
  union all select component_id, component, 8, 'providerAccountId', array_to_string(ProviderAccountId, ',') from @declared_component where len(ProviderAccountId) > 0
  union all select component_id, component, 11, 'assetType', AssetType from @declared_component where AssetType <> '')
"""


def _with_id(v):
    """Components whose name carries their key, so rules can be told apart."""
    return v.declared_component.withColumn("app_name", F.col("component_id").cast("string"))


@query("component_rules", "with " + _FIELDS + """,
n as (select *, string_split(vals, ',') as a, case filter when 'keyLike' then 'SEARCH' when 'tags' then 'TAG' when 'repository' then 'REPO' when 'cidr' then 'CIDR' when 'fqdn' then 'FQDN' when 'osNames' then 'OS'
  when 'hostnames' then 'HOST' when 'providerAccountId' then 'ACCOUNT-ID' else 'ASSET-TYPE' end as code from f)
select cast(component_id as varchar) as component_id, rule_no, filter, vals, 'R-' || code || ' for ' || component || ' (' || array_to_string(a[1:2], ', ') || case when len(a) > 2 then ' +' || (len(a) - 2) else '' end || ')' as rule_name from n""")
def _(v):
    r = rules.component_rules(_with_id(v))
    return r.select(F.col("app_name").alias("component_id"), "rule_no", "filter", F.array_join("values", ",").alias("vals"), "rule_name")


@query("component_rule_batches", "with " + _FIELDS + """
select cast(component_id as varchar) as component_id, string_agg(filter || ':' || vals, ';' order by case filter when 'hostnames' then 6 when 'osNames' then 7 else rule_no end) as rules from f group by component_id""")
def _(v):
    batches, _ = rules.component_rule_batches(_with_id(v))
    text = F.array_join(F.transform("rules", lambda r: F.concat(r["filter"], F.lit(":"), F.array_join(r["values"], ","))), ";")
    return batches.select(F.col("app_name").alias("component_id"), text.alias("rules"))


@query("component_rule_errors", """
select cast(component_id as varchar) as component_id, 'Invalid rule: Rule for ' || f || ' for ' || component as error from (
  select component_id, component, 'keyLike' as f from @declared_component where SearchName <> '' and (trim(SearchName) = '' or lower(SearchName) = 'null')
  union all select component_id, component, 'repository' from @declared_component where len(RepositoryName) > 0 and len(list_filter(RepositoryName, lambda x: length(trim(x)) >= 3 and lower(trim(x)) <> 'null')) = 0)""")
def _(v):
    _, errors = rules.component_rule_batches(_with_id(v))
    return errors.select(F.col("app_name").alias("component_id"), "error")


# A rule per component with several fields at once; later tag sources replace earlier ones.
_MULTI = """select component_id, component, cast(component_id as {text}) as app_name, SearchName, Tags,
  case when component_id % 3 = 0 then {rule} end as Tag_rule, component_id % 6 = 3 as Tag_rule_text,
  case when component_id % 5 = 0 then {rules} end as Tags_rule, Cidr, case when component_id % 12 = 0 then {cidrs} end as Cidrs,
  RepositoryName, Hostnames, AssetType from @declared_component"""


def _multi(v):
    sql = _MULTI.format(text="string", rule="case when component_id % 6 = 3 then array('x:') else array(':y', 'k: v', 'NULL', ' z ') end",
                        rules="array('a:b:c', 'q:')", cidrs="array('1.0.0.0/8', '2.0.0.0/8')")
    rows = v.sql(sql)
    nul = {"Tag": "string", "Tag_label": "array<string>", "Tags_label": "array<string>", "Fqdn": "array<string>", "Netbios": "array<string>", "OsNames": "array<string>",
           "ProviderAccountId": "array<string>", "ProviderAccountName": "array<string>", "ResourceGroup": "array<string>"}
    fields = [F.col(c).alias(c) for c in ("SearchName", "Tags", "Tag_rule", "Tag_rule_text", "Tags_rule", "Cidr", "Cidrs", "RepositoryName", "Hostnames", "AssetType")]
    return rows.select("app_name", "component", F.struct(*fields, *[F.lit(None).cast(t).alias(n) for n, t in nul.items()]).alias("rule"))


_MULTI_SQL = _MULTI.format(text="varchar", rule="case when component_id % 6 = 3 then ['x:'] else [':y', 'k: v', 'NULL', ' z '] end", rules="['a:b:c', 'q:']", cidrs="['1.0.0.0/8', '2.0.0.0/8']")
_MULTI_TAGS = """case when component_id % 5 = 0 then 'a=b:c' when component_id % 6 = 3 then 'x=' when component_id % 3 = 0 then 'k=v|=z' else {base} end"""


@query("component_multi_rules", "with m as (" + _MULTI_SQL + """),
x as (select *, """ + _MULTI_TAGS.format(base="array_to_string(list_transform(Tags, lambda t: '=' || t), '|')") + """ as tagtext,
  case when len(list_filter(RepositoryName, lambda r: r <> '')) > 0 then array_to_string(list_filter(RepositoryName, lambda r: r <> ''), ',') end as repos from m)
select app_name as component_id, 'MC-R ' || component as rule_name, array_to_string(list_filter(['assetType:' || AssetType, case when Cidrs is null then 'cidr:' || Cidr end, 'cidrs:' || array_to_string(Cidrs, ','),
  'hostnames:' || array_to_string(Hostnames, ','), 'keyLike:' || nullif(SearchName, ''), 'repository:' || repos, 'tags:' || tagtext], lambda s: s is not null), ';') as filter
from x where coalesce(AssetType, Cidr, array_to_string(Cidrs, ','), array_to_string(Hostnames, ','), nullif(SearchName, ''), repos, tagtext) is not null""")
def _(v):
    good, _ = rules.component_multi_rules(_multi(v))
    return good.select(F.col("app_name").alias("component_id"), "rule_name", rules.filter_text().alias("filter"))


@query("component_multi_rules_rejected", "with m as (" + _MULTI_SQL + """)
select app_name as component_id from m where AssetType is null and Cidr is null and Cidrs is null and Hostnames is null and coalesce(SearchName, '') = '' and RepositoryName is null
  and Tags is null and Tag_rule is null and Tags_rule is null""")
def _(v):
    _, bad = rules.component_multi_rules(_multi(v))
    return bad.select(F.col("app_name").alias("component_id"))


@query("service_multi_rules", "with m as (" + _MULTI_SQL + """),
y as (select *, case when trim(SearchName) <> '' and lower(SearchName) <> 'null' then SearchName end as search,
  list_filter(Tags, lambda t: trim(t) <> '' and lower(t) <> 'null') as vt, list_filter(RepositoryName, lambda r: trim(r) <> '' and lower(r) <> 'null') as vr from m),
x as (select *, """ + _MULTI_TAGS.format(base="array_to_string(list_transform(vt, lambda t: '=' || t), '|')") + """ as tagtext, case when len(vr) > 0 then array_to_string(vr, ',') end as repos,
  list_filter(['KEY:' || search, 'REPO:' || array_to_string(case when len(vr) > 0 then vr end, ','), 'TAGS:' || array_to_string(vt, ','),
    'TAG_RULE:' || case when component_id % 6 = 3 then 'x=' when component_id % 3 = 0 then 'k=v,z' end, 'TAGS_RULE:' || case when component_id % 5 = 0 then 'a=b:c' end,
    'ASSET:' || AssetType, 'CIDRS:[''' || array_to_string(Cidrs, ''', ''') || ''']', case when Cidrs is null then 'CIDR:' || Cidr end, 'HOSTNAMES:[''' || array_to_string(Hostnames, ''', ''') || ''']'], lambda s: s is not null) as d from y),
n as (select *, 'MC-R-' || component || '-' || array_to_string(d, ' AND ') as nm from x)
select app_name as component_id, case when length(nm) > 255 then substr(nm, 1, 252) || '...' else nm end as rule_name,
  array_to_string(list_filter(['assetType:' || AssetType, case when Cidrs is null then 'cidr:' || Cidr end, 'cidrs:' || array_to_string(Cidrs, ','),
  'hostnames:' || array_to_string(Hostnames, ','), 'keyLike:' || search, 'repository:' || repos, 'tags:' || tagtext], lambda s: s is not null), ';') as filter
from n where len(d) > 0""")
def _(v):
    rows = _multi(v).withColumnsRenamed({"component": "service", "app_name": "env_name"})
    good, _ = rules.service_multi_rules(rows)
    return good.select(F.col("env_name").alias("component_id"), "rule_name", rules.filter_text().alias("filter"))


@query("service_rules", """
with c as (select service_id, service, trim(unnest(string_split(Cidr, ','))) as x, generate_subscripts(string_split(Cidr, ','), 1) as i from @declared_service where Type = 'Infra'),
k as (select *, row_number() over (partition by service_id order by i) as n from c where x <> ''),
t as (select service, unnest(Tag) as x from @declared_service union all select service, unnest(Tag_rule) from @declared_service union all select service, unnest(Tags_rule) from @declared_service),
o as (select service, 'SEARCH' as code, 'keyLike' as filter, [SearchName] as a from @declared_service where SearchName <> ''
  union all select service, 'FQDN', 'fqdn', Fqdn from @declared_service where len(Fqdn) > 0
  union all select service, 'OS', 'osNames', OsNames from @declared_service where len(OsNames) > 0
  union all select service, 'HOST', 'hostnames', Hostnames from @declared_service where len(Hostnames) > 0
  union all select service, 'ACCOUNT-ID', 'providerAccountId', ProviderAccountId from @declared_service where len(ProviderAccountId) > 0
  union all select service, 'ACCOUNT-NAME', 'providerAccountName', ProviderAccountName from @declared_service where len(ProviderAccountName) > 0
  union all select service, 'ASSET-TYPE', 'assetType', [AssetType] from @declared_service where AssetType <> '')
select service, 'CIDR rule for ' || service || ' - ' || n as rule_name, 'cidr' as filter, 'INFRA ' || case when x like '%/%' then x else x || '/32' end as value from k
union all select service, 'R-TAG for ' || service || ' (' || trim(split_part(x, ':', 1)) || ':' || trim(split_part(x, ':', 2)) || ')', 'tags', trim(split_part(x, ':', 1)) || '=' || trim(split_part(x, ':', 2)) from t where x like '%:%'
union all select service, 'R-' || code || ' for ' || service || ' (' || array_to_string(a[1:2], ', ') || ')', filter, array_to_string(a, ',') from o""")
def _(v):
    return rules.service_rules(v.declared_service).select("service", "rule_name", "filter", "value")


@query("team_association_rules", """
select 'team-' || n_nationkey as id, n_name as name, 'pteam ' || n_name as rule_name, 'pteam' as tag_key, n_name as tag_value from @nation where n_nationkey % 6 <> 5""")
def _(v):
    return rules.tag_rule(v.actual_team, F.lit("pteam"), "name")


@query("rule_set_comparison", """
with e as (select p_partkey, case when p_size % 10 = 1 then null when p_size % 10 = 0 then '' else p_type || '/' || p_size % 5 || '/' || p_partkey % 2 end as sig from @part),
h as (select distinct p_type || '/' || p_size % 5 || '/1' as sig from @part where p_size % 3 = 0)
select p_partkey, case when sig <> '' and exists (select 1 from h where h.sig = e.sig) then 'created' else 'failed' end as status,
  count(*) over (partition by sig) as times_expected from e""")
def _(v):
    def filters(df, flag):
        entries = F.create_map(F.lit("type"), F.col("p_type"), F.lit("account"), F.concat((F.col("p_size") % 5).cast("string"), F.lit("/"), flag))
        return df.withColumn("filter_map", entries)
    expected = filters(v.part, (F.col("p_partkey") % 2).cast("string")).withColumn(
        "filter_map", F.when(F.col("p_size") % 10 == 1, F.lit(None)).when(F.col("p_size") % 10 == 0, F.create_map().cast("map<string,string>")).otherwise(F.col("filter_map")))
    stored = v.part.filter("p_size % 3 = 0").select(F.create_map(F.lit("account"), F.concat((F.col("p_size") % 5).cast("string"), F.lit("/1")), F.lit("type"), F.col("p_type")).alias("filter_map"))
    return rules.compare_rule_sets(expected.select("p_partkey", "filter_map"), stored).select("p_partkey", "status", "times_expected")


# --- action rows ---------------------------------------------------------------------------------

_CRIT = "cast(case when {t} between 1 and 10 then 11 - {t} else 5 end as integer)"
_UNITS = "coalesce(array_to_string(list_filter(list_transform(string_split(BU, ','), lambda x: trim(x)), lambda x: x <> ''), '|'), '')"


def _parts(c: str):
    return [F.col(f"{c}.integration").alias(f"{c}_name"), F.col(f"{c}.target").alias(f"{c}_target")]


@query("environment_create_rows", """
select Name as name, 'CLOUD' as sub_type, """ + _CRIT.format(t="Tier") + """ as criticality, lower(Responsable) as owner, """ + _UNITS + """ as units,
  array_to_string(list_filter(['status=' || Status, 'pteam=' || TeamName, case when Tags_label is not null then '=free' end, replace(Tag_label[1], ':', '=')], lambda x: x is not null), '|') as tags,
  case when Ticketing[1].Backlog is not null then Ticketing[1].TIntegrationName end as ticketing_name, Ticketing[1].Backlog as ticketing_target,
  case when Messaging[1].Channel is not null then 'slack' end as messaging_name, Messaging[1].Channel as messaging_target from @declared_env""")
def _(v):
    e = actions.create_environments(v.declared_env)
    return e.select("name", "sub_type", "criticality", "owner", F.array_join("business_units", "|").alias("units"), tags.tags_text("tags").alias("tags"),
                    *_parts("ticketing"), *_parts("messaging"))


@query("environment_patch_rows", """
select d.Name as name, 'env-' || d.Name as scope_id, """ + _UNITS + """ as units, case when Ticketing[1].TIntegrationName is not null then Ticketing[1].Backlog end as ticketing_target, Messaging[1].Channel as messaging_target
from @declared_env d where BU is not null or (Ticketing[1].TIntegrationName is not null and Ticketing[1].Backlog is not null) or Messaging[1].Channel is not null""")
def _(v):
    e = actions.patch_environments(v.declared_env.withColumn("scope_id", F.concat(F.lit("env-"), "Name")))
    return e.select("name", "scope_id", F.array_join("business_units", "|").alias("units"), _parts("ticketing")[1], _parts("messaging")[1])


def _declared_apps(v):
    return v.declared_app.withColumnRenamed("app_name", "AppName")


@query("application_create_rows", """
with l as (select app_no, 1 as s, unnest(Tag_label) as t, generate_subscripts(Tag_label, 1) as i from @declared_app union all select app_no, 2, unnest(Tags_label), 1 from @declared_app),
x as (select app_no, s, i, case when t like 'RiskFactor:%' then trim(regexp_extract(t, '^(.*):[^:]*$', 1)) || '=' || trim(regexp_extract(t, '([^:]*)$', 1))
    when t like '%:%' then trim(split_part(t, ':', 1)) || '=' || trim(substr(t, instr(t, ':') + 1)) else '=' || t end as tag from l
  union all select app_no, 0, i, 'pteam=' || t from (select app_no, unnest(TeamNames) as t, generate_subscripts(TeamNames, 1) as i from @declared_app)),
g as (select app_no, string_agg(tag, '|' order by s, i) as tags from x group by 1)
select app_name as name, """ + _CRIT.format(t="Tier") + """ as criticality, lower(Responsable) as owner, """ + _UNITS + """ as units, coalesce(tags, '') as tags,
  case when Ticketing[1].TIntegrationName is not null then Ticketing[1].Backlog end as ticketing_target, Messaging[1].Channel as messaging_target from @declared_app left join g using (app_no)""")
def _(v):
    a = actions.create_applications(_declared_apps(v))
    return a.select("name", "criticality", "owner", F.array_join("business_units", "|").alias("units"), tags.tags_text("tags").alias("tags"), _parts("ticketing")[1], _parts("messaging")[1])


@query("application_patch_rows", """
select app_name as name, s.id as scope_id, """ + _CRIT.format(t="Tier") + """ as criticality, lower(Responsable) as owner, """ + _UNITS + """ as units,
  case when Ticketing[1].TIntegrationName is not null then Ticketing[1].Backlog end as ticketing_target from @declared_app join @actual_scope s on s.name = app_name and s.type = 'APPLICATION'""")
def _(v):
    split = placement.upsert(_declared_apps(v), "AppName", v.actual_scope, "APPLICATION")
    a = actions.patch_applications(split)
    return a.select("name", "scope_id", "criticality", "owner", F.array_join("business_units", "|").alias("units"), _parts("ticketing")[1])


@query("component_action_rows", _COMPONENT_TAGS + """
select c.component_id, """ + _CRIT.format(t="any_value(Tier)") + """ as criticality, coalesce(string_agg(x, '|' order by s, i), '') as create_tags,
  coalesce(string_agg(x, '|' order by s, i) filter (where creating is null), '') as patch_tags
from @declared_component c left join t on c.component_id = t.component_id group by c.component_id""")
def _(v):
    rows = v.declared_component.withColumn("component", F.col("component_id").cast("string"))
    c = actions.create_components(rows).select("component", "criticality", tags.tags_text("tags").alias("create_tags"))
    u = actions.patch_components(rows).select("component", tags.tags_text("tags").alias("patch_tags"))
    return c.join(u, "component").select(F.col("component").cast("bigint").alias("component_id"), "criticality", "create_tags", "patch_tags")


@query("service_create_rows", """
select service, """ + _CRIT.format(t="Tier") + """ as criticality, 'pteam=' || coalesce(TeamName, '') || case when Tag_label is not null then '|owner=' || split_part(Tag_label[1], ':', 2) else '' end ||
  case when Tags_label is not null then '|=free' else '' end as tags, coalesce(Ticketing[1].TIntegrationName, Ticketing[1].IntegrationName) as ticketing_name, Ticketing[1].Backlog as ticketing_target,
  Messaging[1].IntegrationName as messaging_name, Messaging[1].Channel as messaging_target from @declared_service""")
def _(v):
    s = actions.create_services(v.declared_service)
    return s.select("service", "criticality", tags.tags_text("tags").alias("tags"), *_parts("ticketing"), *_parts("messaging"))


@query("service_patch_rows", """
select service, a.id as entity_id, case when Tag_label is not null then 'owner=' || split_part(Tag_label[1], ':', 2) else '' end || case when Tag_label is not null and Tags_label is not null then '|' else '' end ||
  case when Tags_label is not null then '=free' else '' end as tags, Ticketing[1].Backlog as ticketing_target, case when Messaging[1].IntegrationName is not null then Messaging[1].Channel end as messaging_target
from @declared_service d join @actual_component a on a.applicationId = d.target and lower(a.name) = lower(d.service)""")
def _(v):
    placed = placement.place(v.declared_service.withColumn("name", F.col("service")), v.actual_component).filter("entity_exists")
    s = actions.patch_services(placed)
    return s.select("service", "entity_id", tags.tags_text("tags").alias("tags"), _parts("ticketing")[1], _parts("messaging")[1])


@query("repository_components", """
select Subdomain as app_name, 'grp/svc-' || pos % 400 as component, """ + _CRIT.format(t="Tier") + """ as criticality, 'pteam=' || Team || '|domain=' || Domain || '|subdomain=' || Subdomain as tags, 'grp/svc-' || pos % 400 as repository
from @declared_repo""")
def _(v):
    r = actions.repository_components(v.declared_repo)
    return r.select("app_name", "component", "criticality", tags.tags_text("tags").alias("tags"), F.array_join("repository_filter", ",").alias("repository"))


@query("service_tag_rules", """
select env_name, service, 'tier ' || Tier as rule_name, 'tier' as tag_key, cast(Tier as varchar) as tag_value, 'acct-' || service_id % 4 as accounts from @declared_service""")
def _(v):
    r = rules.tag_rule(v.declared_service.withColumn("Tier", F.col("Tier").cast("string")), F.lit("tier"), "Tier", F.array(F.concat(F.lit("acct-"), F.col("service_id") % 4)))
    return r.select("env_name", "service", "rule_name", "tag_key", "tag_value", F.array_join("provider_accounts", ",").alias("accounts"))


@query("application_tag_rows", """
with l as (select app_no, unnest(Tag_label) as t from @declared_app)
select app_no as app_id, case when t like 'RiskFactor:%' then trim(regexp_extract(t, '^(.*):[^:]*$', 1)) when t like '%:%' then trim(split_part(t, ':', 1)) end as key,
  case when t like 'RiskFactor:%' then trim(regexp_extract(t, '([^:]*)$', 1)) when t like '%:%' then trim(substr(t, instr(t, ':') + 1)) else t end as value from l""")
def _(v):
    return actions.application_tag_rows(v.declared_app.select(F.col("app_no").alias("app_id"), F.explode("Tag_label").alias("label")))


@query("finding_rules", """
select Subdomain || ' ' || 'grp/svc-' || pos % 400 as rule_name, 'subdomain' as tag_key, Subdomain as tag_value, 'grp/svc-' || pos % 400 as repository from @declared_repo""")
def _(v):
    r = actions.finding_rules(v.declared_repo.select(F.col("Subdomain").alias("application"), last_two_parts("RepositoryName").alias("component")))
    return r.select("rule_name", "tag_key", "tag_value", F.array_join("repository", ",").alias("repository"))
