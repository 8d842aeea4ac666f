"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.functions import integrations, naming, network, people, repositories, scales, similarity, tags, text
from tallyline.operators import rules

from .registry import query


@query("criticality", """
select p_partkey, case p_size when 1 then 10 when 2 then 9 when 3 then 8 when 4 then 7 when 5 then 6 when 6 then 5
  when 7 then 4 when 8 then 3 when 9 then 2 when 10 then 1 else 5 end as standard,
  case p_size - 1 when 0 then 10 when 1 then 9 when 2 then 8 when 3 then 7 when 4 then 6 else 5 end as short
from @part""")
def _(v):
    return v.part.select("p_partkey", scales.criticality("p_size").alias("standard"),
                         scales.criticality(F.col("p_size") - 1, "short").alias("short"))


@query("last_path_parts", r"""
with u as (select page_id, url, string_split(trim(url), '/') as parts from @pages)
select page_id, case when len(parts) >= 2 then parts[-2] || '/' || parts[-1] else url end as shortened from u""")
def _(v):
    return v.pages.select("page_id", repositories.last_two_parts("url").alias("shortened"))


@query("clean_repositories", r"""
with r as (select component_id, unnest(RepositoryName) as name, generate_subscripts(RepositoryName, 1) as i from @declared_component),
k as (select component_id, i, case when trim(name) like '%/%' then regexp_extract(trim(name), '([^/]*/[^/]*)$', 1) else trim(name) end as s
  from r where trim(name) <> '' and lower(trim(name)) <> 'null'),
g as (select component_id, string_agg(s, ',' order by i) as s from k where length(s) >= 3 group by component_id)
select c.component_id, coalesce(g.s, '') as repositories from @declared_component c left join g using (component_id)""")
def _(v):
    return v.declared_component.select("component_id", F.array_join(repositories.clean_repositories("RepositoryName"), ",").alias("repositories"))


@query("label_tags", """
with l as (select app_no, unnest(Tag_label) as t from @declared_app union all select app_no, unnest(Tags_label) from @declared_app)
select app_no, t as label,
  case when t like 'RiskFactor:%' and length(t) - length(replace(t, ':', '')) >= 2 then trim(regexp_extract(t, '^(.*):[^:]*$', 1))
       when t like '%:%' then trim(split_part(t, ':', 1)) end as tag_key,
  case when t like 'RiskFactor:%' and length(t) - length(replace(t, ':', '')) >= 2 then trim(regexp_extract(t, '([^:]*)$', 1))
       when t like '%:%' then trim(substr(t, instr(t, ':') + 1)) else t end as tag_value
from l""")
def _(v):
    labels = v.declared_app.select("app_no", F.explode("Tag_label").alias("label")).unionAll(
        v.declared_app.select("app_no", F.explode("Tags_label")))
    t = tags.label_tag("label")
    return labels.select("app_no", "label", t["key"].alias("tag_key"), t["value"].alias("tag_value"))


_RULE_TEXTS = """
with t as (select service_id, unnest(coalesce(Tag_rule, Tags_rule)) as x, generate_subscripts(coalesce(Tag_rule, Tags_rule), 1) as i from @declared_service),
"""


@query("rule_tags_as_values", _RULE_TEXTS + """
p as (select service_id, i, '=' || x as s from t)
select service_id, string_agg(s, '|' order by i) as tags from p group by service_id""")
def _(v):
    rows = v.declared_service.withColumn("texts", F.coalesce("Tag_rule", "Tags_rule")).filter("texts is not null")
    return rows.select("service_id", tags.tags_text(tags.rule_tags("texts", "values")).alias("tags"))


@query("rule_tags_first_colon", _RULE_TEXTS + """
p as (select service_id, i, case when x like '%:%' then trim(split_part(x, ':', 1)) || '=' || trim(substr(x, instr(x, ':') + 1)) else '=' || x end as s
  from t where trim(x) <> '' and lower(x) <> 'null')
select service_id, string_agg(s, '|' order by i) as tags from p group by service_id""")
def _(v):
    rows = v.declared_service.withColumn("texts", F.coalesce("Tag_rule", "Tags_rule")).filter("texts is not null")
    return rows.select("service_id", tags.tags_text(tags.rule_tags("texts", "first_colon")).alias("tags"))


@query("rule_tags_strict_pairs", _RULE_TEXTS + """
p as (select service_id, i, trim(x) as x from t where trim(x) <> '' and lower(x) <> 'null'),
q as (select service_id, i, case when x like '%:%' then trim(split_part(x, ':', 1)) end as k,
  case when x like '%:%' then trim(substr(x, instr(x, ':') + 1)) else x end as val from p)
select service_id, string_agg(coalesce(k, '') || '=' || val, '|' order by i) as tags from q
where k is null or (k <> '' and val <> '') group by service_id""")
def _(v):
    rows = v.declared_service.withColumn("texts", F.coalesce("Tag_rule", "Tags_rule")).filter("texts is not null")
    return rows.select("service_id", tags.tags_text(tags.rule_tags("texts", "strict_pairs")).alias("tags")).filter("tags is not null")


@query("rule_tags_first_two_parts", _RULE_TEXTS + """
p as (select service_id, i, trim(split_part(x, ':', 1)) || '=' || trim(split_part(x, ':', 2)) as s from t where x like '%:%')
select service_id, string_agg(s, '|' order by i) as tags from p group by service_id""")
def _(v):
    rows = v.declared_service.withColumn("texts", F.coalesce("Tag_rule", "Tags_rule")).filter("texts is not null")
    return rows.select("service_id", tags.tags_text(tags.rule_tags("texts", "first_two_parts")).alias("tags"))


@query("short_tag_filter", """
with t as (select component_id, unnest(Tags) as x, generate_subscripts(Tags, 1) as i from @declared_component)
select component_id, string_agg('=' || x, '|' order by i) as tags from t where length(trim(x)) >= 3 group by component_id""")
def _(v):
    return (v.declared_component.filter(F.size("Tags") > 0)
            .select("component_id", tags.tags_text(tags.short_tag_filter("Tags")).alias("tags")))


@query("business_units", """
with t as (select app_no, unnest(string_split(BU, ',')) as x, generate_subscripts(string_split(BU, ','), 1) as i from @declared_app),
g as (select app_no, string_agg(trim(x), '|' order by i) as units from t where trim(x) <> '' group by app_no)
select a.app_no, coalesce(units, '') as units from @declared_app a left join g using (app_no)""")
def _(v):
    return v.declared_app.select("app_no", F.array_join(text.business_units("BU"), "|").alias("units"))


@query("name_to_address", """
select component_id, replace(lower(trim(' ' || Status || ' ' || app_name || ' ')), ' ', '.') || '@x.org' as email from @declared_component""")
def _(v):
    name = F.concat(F.lit(" "), "Status", F.lit(" "), "app_name", F.lit(" "))
    return v.declared_component.select("component_id", people.name_to_address(name, "x.org").alias("email"))


@query("address_to_names", """
with e as (select p_partkey as app_no, case p_partkey % 3 when 0 then replace(p_name, ' ', '.') || '@x.org' when 1 then p_type || '@x.org' else p_name end as email from @part)
select app_no, case when email like '%@%' then split_part(split_part(email, '@', 1), '.', 1) end as first_name,
  case when email like '%@%' then case when split_part(email, '@', 1) like '%.%' then split_part(split_part(email, '@', 1), '.', 2) else split_part(email, '@', 1) end end as last_name
from e""")
def _(v):
    email = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("@x.org"))).when(
        F.col("p_partkey") % 3 == 1, F.concat("p_type", F.lit("@x.org"))).otherwise(F.col("p_name"))
    n = people.address_to_names(email)
    return v.part.select(F.col("p_partkey").alias("app_no"), n["first_name"].alias("first_name"), n["last_name"].alias("last_name"))


@query("member_names_and_roles", """
select pos, case when name like '% %' then split_part(name, ' ', 1) else split_part(email, '@', 1) end as first_name,
  case when name like '% %' then split_part(name, ' ', 2) else split_part(email, '@', 1) end as last_name,
  case coalesce(nullif(employee_role, ''), employee_type) when 'Security Champion' then 'SECURITY_CHAMPION' when 'Manager' then 'SECURITY_CHAMPION'
    when 'Engineering User' then 'ENGINEERING_USER' when 'Employee' then 'ENGINEERING_USER' when 'Application Admin' then 'APPLICATION_ADMIN' else 'ORG_USER' end as role
from @declared_member""")
def _(v):
    n = people.member_names("name", "email")
    return v.declared_member.select("pos", n["first_name"].alias("first_name"), n["last_name"].alias("last_name"),
                                    people.platform_role("employee_role", "employee_type").alias("role"))


@query("image_parts", """
with i as (select p_partkey, 'reg' || p_size || '.x.org' || case when p_size % 5 = 0 then ':5000' else '' end || '/team/' || replace(p_name, ' ', '-') || ':' || p_size as image from @part)
select p_partkey, split_part(image, '/', 1) as registry, regexp_extract(split_part(image, ':', 1), '([^/]*)$', 1) as image_name, split_part(image, ':', 1) as container_url from i""")
def _(v):
    image = F.concat(F.lit("reg"), "p_size", F.lit(".x.org"), F.when(F.col("p_size") % 5 == 0, ":5000").otherwise(""),
                     F.lit("/team/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(":"), "p_size")
    p = repositories.image_parts(image)
    return v.part.select("p_partkey", p["registry"].alias("registry"), p["image_name"].alias("image_name"), p["container_url"].alias("container_url"))


@query("first_present_key", """
select event_id, coalesce(json_extract_string(props, '$.Key'), json_extract_string(props, '$.k')) as found from @events""")
def _(v):
    entries = F.from_json("props", "map<string,string>")
    return v.events.select("event_id", text.first_present(entries, "Key", "k", "K").alias("found"))


@query("valid_values", """
select component_id, SearchName is not null and trim(SearchName) <> '' and lower(SearchName) <> 'null' as search_ok,
  Tags is not null and len(Tags) > 0 as tags_ok from @declared_component""")
def _(v):
    return v.declared_component.select("component_id", F.coalesce(text.is_valid("SearchName"), F.lit(False)).alias("search_ok"),
                                       F.coalesce(text.is_valid_list("Tags"), F.lit(False)).alias("tags_ok"))


@query("group_names", """
with g as (select p_partkey, p_brand || '|||' || p_name as k, case when p_size > 5 then 'My_' || p_brand || ' ' || p_type end as pri,
  case when p_size % 3 = 0 then 'NoTeam' when p_size % 3 = 1 then p_name else '' end as sec from @part)
select p_partkey, substr(replace(replace(coalesce(pri, k), ' ', '-'), '_', '-'), 1, 100) as application_name,
  'x-' || case when sec not in ('', 'NoTeam') then substr(replace(replace(replace(coalesce(pri, k), ' ', '-'), '_', '-') || '-' || sec, ' ', '-'), 1, 100)
    else substr(replace(k, '|||', '-'), 1, 100) end as component_name from g""")
def _(v):
    g = v.part.select("p_partkey", F.concat("p_brand", F.lit("|||"), "p_name").alias("k"),
                      F.when(F.col("p_size") > 5, F.concat(F.lit("My_"), "p_brand", F.lit(" "), "p_type")).alias("pri"),
                      F.when(F.col("p_size") % 3 == 0, "NoTeam").when(F.col("p_size") % 3 == 1, F.col("p_name")).otherwise("").alias("sec"))
    return g.select("p_partkey", naming.application_name("k", "pri").alias("application_name"),
                    naming.component_name("k", "pri", "sec", prefix="x-").alias("component_name"))


@query("rule_names", """
with r as (select component_id, component, Tags as vals, 'tags' as f from @declared_component where Tags is not null
  union all select component_id, component, Hostnames, 'hostnames' from @declared_component where Hostnames is not null
  union all select component_id, component, [repeat(app_name, 9)], 'custom' from @declared_component),
n as (select *, array_to_string(vals[1:2], ', ') || case when len(vals) > 2 then ' +' || (len(vals) - 2) else '' end as s from r)
select component_id, f as filter, 'R-' || case f when 'tags' then 'TAG' when 'hostnames' then 'HOST' else upper(f) end || ' for ' || component ||
  ' (' || case when length(s) > 50 then substr(s, 1, 47) || '...' else s end || ')' as rule_name from n""")
def _(v):
    c = v.declared_component
    part = lambda values, f: c.select("component_id", "component", values.alias("values"), F.lit(f).alias("filter"))
    rows = part(F.col("Tags"), "tags").unionAll(part(F.col("Hostnames"), "hostnames")).filter("values is not null").unionAll(
        part(F.array(F.repeat("app_name", F.lit(9))), "custom"))
    return rows.select("component_id", "filter", naming.rule_name("component", "filter", "values").alias("rule_name"))


@query("service_rule_names", """
with d as (select service_id, service, array_to_string(list_filter(['KEY:' || nullif(SearchName, ''), 'CIDR:' || Cidr, 'ASSET:' || AssetType, 'LONG:' || repeat(service, service_id::int % 20)], lambda x: x is not null), ' AND ') as s from @declared_service)
select service_id, case when length('MC-R-' || service || '-' || s) > 255 then substr('MC-R-' || service || '-' || s, 1, 252) || '...' else 'MC-R-' || service || '-' || s end as rule_name from d""")
def _(v):
    details = F.array(F.concat(F.lit("KEY:"), text.blank_to_null("SearchName")), F.concat(F.lit("CIDR:"), "Cidr"),
                      F.concat(F.lit("ASSET:"), "AssetType"), F.concat(F.lit("LONG:"), F.repeat("service", (F.col("service_id") % 20).cast("int"))))
    return v.declared_service.select("service_id", naming.service_rule_name("service", F.filter(details, lambda d: d.isNotNull())).alias("rule_name"))


@query("network_of_address", r"""
select asset_id, case when regexp_full_match(ip, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])')
  then split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.' || split_part(ip, '.', 3) || '.0/24' end as network
from @asset where ip is not null""")
def _(v):
    return v.asset.filter("ip is not null").select("asset_id", network.network24("ip").alias("network"))


@query("cidr_rules", """
with c as (select service_id, service, trim(unnest(string_split(Cidr, ','))) as x, generate_subscripts(string_split(Cidr, ','), 1) as i from @declared_service where Type = 'Infra'),
k as (select *, row_number() over (partition by service_id order by i) as n from c where x <> '')
select service_id, 'CIDR rule for ' || service || ' - ' || n as rule_name, case when x like '%/%' then x else x || '/32' end as cidr from k""")
def _(v):
    rows = v.declared_service.filter((F.col("Type") == "Infra") & F.col("Cidr").isNotNull())
    return (rows.select("service_id", "service", F.posexplode(network.cidr_list("Cidr")).alias("i", "cidr"))
            .select("service_id", F.concat(F.lit("CIDR rule for "), "service", F.lit(" - "), F.col("i") + 1).alias("rule_name"), "cidr"))


# The longest common subsequence of a part's name and type, row by row of the usual table.
@query("name_similarity", """
with recursive p as (select distinct p_name as a, p_brand || ' ' || lower(p_type) as b from @part),
dp(a, b, i, cells) as (
  select a, b, 0, list_transform(range(0, length(b) + 1), lambda j: 0) from p
  union all
  select a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc,
      case when substr(a, i + 1, 1) = substr(b, j::int, 1) then cells[j] + 1 else greatest(cells[j + 1], acc[len(acc)]) end), [0]::int[])
  from dp where i < length(a))
select a, b, round(case when length(a) + length(b) = 0 then 1.0 else 2.0 * cells[len(cells)] / (length(a) + length(b)) end, 6) as ratio
from dp where i = length(a)""")
def _(v):
    pairs = v.part.select(F.col("p_name").alias("a"), F.concat("p_brand", F.lit(" "), F.lower("p_type")).alias("b")).distinct()
    return pairs.select("a", "b", F.round(similarity.similarity("a", "b"), 6).alias("ratio"))


_COMPONENT_TAGS = """
with t as (
  select component_id, 1 as s, 0 as i, 'Status=' || Status as x, true as creating from @declared_component where Status <> ''
  union all select component_id, 2, 0, 'Type=' || Type, true from @declared_component where Type <> ''
  union all select component_id, 3, i, 'pteam=' || x, null from (select component_id, unnest(TeamNames) as x, generate_subscripts(TeamNames, 1) as i from @declared_component) where x <> ''
  union all select component_id, 4, 0, 'domain=' || Domain, null from @declared_component where Domain <> ''
  union all select component_id, 5, 0, 'subdomain=' || SubDomain, null from @declared_component where SubDomain <> ''
  union all select component_id, 6, 0, regexp_extract(x, '^(.*):([^:]*)$', 1) || '=' || regexp_extract(x, '^(.*):([^:]*)$', 2), null from (select component_id, unnest(Tag_label) as x from @declared_component))
"""


@query("component_tags", _COMPONENT_TAGS + """
select c.component_id, coalesce(string_agg(x, '|' order by s, i), '') as create_tags,
  coalesce(string_agg(x, '|' order by s, i) filter (where creating is null), '') as update_tags
from @declared_component c left join t on c.component_id = t.component_id group by c.component_id""")
def _(v):
    common = dict(teams=F.col("TeamNames"), domain=F.col("Domain"), subdomain=F.col("SubDomain"), labels=tags.label_tags("Tag_label", "Tags_label"))
    return v.declared_component.select(
        "component_id", tags.tags_text(tags.component_tags(status=F.col("Status"), kind=F.col("Type"), **common)).alias("create_tags"),
        tags.tags_text(tags.component_tags(**common)).alias("update_tags"))


@query("integration_settings", """
select app_no, coalesce(Ticketing[1].TIntegrationName, Ticketing[1].IntegrationName) is not null and Ticketing[1].Backlog is not null as ticketing_loads,
  case when Ticketing[1].Backlog is not null then Ticketing[1].TIntegrationName end as ticketing_name,
  case when Messaging[1].MIntegrationName is not null then Messaging[1].Channel end as channel from @declared_app""")
def _(v):
    ticket = integrations.target_of("Ticketing", "ticketing")
    return v.declared_app.select("app_no", integrations.loaded("Ticketing", "ticketing").isNotNull().alias("ticketing_loads"),
                                 ticket["integration"].alias("ticketing_name"),
                                 integrations.target_of("Messaging", "messaging")["target"].alias("channel"))


@query("location_class", """
with s as (select o_orderkey, case when o_orderkey % 2 = 0 then '12345678-1234-1234-1234-' || lpad(cast(o_orderkey as varchar), 12, '0') else 'app-' || o_custkey end as id from @orders)
select o_orderkey, case when length(id) > 30 and length(id) - length(replace(id, '-', '')) >= 4 then 'Environment' else 'Application' end as location_type from s""")
def _(v):
    scope = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("12345678-1234-1234-1234-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
                   ).otherwise(F.concat(F.lit("app-"), "o_custkey"))
    return v.orders.select("o_orderkey", scales.location_class(scope).alias("location_type"))


@query("user_suffix", """
with n as (select c_custkey, case when c_custkey % 2 = 0 then c_name || ' User' when c_custkey % 3 = 0 then 'User ' || c_name else c_name || '  User' end as name from @customer)
select c_custkey, case when name like '% User' then trim(substr(name, 1, length(name) - 5)) else name end as clean_name from n""")
def _(v):
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" User"))).when(
        F.col("c_custkey") % 3 == 0, F.concat(F.lit("User "), "c_name")).otherwise(F.concat("c_name", F.lit("  User")))
    return v.customer.select("c_custkey", people.strip_user_suffix(name).alias("clean_name"))


@query("known_roles", """
with r as (select c_custkey, case c_custkey % 4 when 0 then 'ORG_ADMIN' when 1 then 'ORG_USER' when 2 then c_mktsegment end as role from @customer)
select c_custkey, coalesce(role in ('ORG_ADMIN', 'ORG_APP_ADMIN', 'ORG_USER', 'ORG_ADMIN_LITE', 'ORG_SEC_ADMIN', 'ORG_SEC_DEV'), false) as known from r""")
def _(v):
    k = F.col("c_custkey") % 4
    role = F.when(k == 0, "ORG_ADMIN").when(k == 1, "ORG_USER").when(k == 2, F.col("c_mktsegment"))
    return v.customer.select("c_custkey", people.known_role(role).alias("known"))


@query("operation_kinds", """
select pos, case when regexp_matches(lower(operation), 'skip|existing|already') then 'skip' when regexp_matches(lower(operation), 'update|modify|change') then 'update'
  when regexp_matches(lower(operation), 'create|add|new') then 'create' when not success then 'error' else 'create' end as operation_type from @op_log""")
def _(v):
    return v.op_log.select("pos", scales.operation_kind("operation", "success").alias("operation_type"))


@query("checked_rules", """
with r as (select component_id, 'SEARCHNAME' as f, [SearchName] as vals from @declared_component where SearchName is not null
  union all select component_id, 'Tags', Tags from @declared_component where Tags is not null
  union all select component_id, 'OSNames', OsNames from @declared_component where OsNames is not null
  union all select component_id, 'hostnames', Hostnames from @declared_component where Hostnames is not null)
select component_id, f as given, case lower(f) when 'searchname' then 'keyLike' when 'osnames' then 'osNames' when 'tags' then 'tags' else f end as filter,
  case lower(f) when 'searchname' then vals[1] when 'tags' then array_to_string(list_filter(vals, lambda x: length(trim(x)) >= 3), ',') else array_to_string(vals, ',') end as vals
from r where len(vals) > 1 or (trim(vals[1]) <> '' and lower(vals[1]) <> 'null')""")
def _(v):
    c = v.declared_component
    part = lambda values, f: c.select("component_id", F.lit(f).alias("given"), values.alias("values"))
    rows = (part(F.array("SearchName"), "SEARCHNAME").filter(F.get("values", F.lit(0)).isNotNull()).unionAll(part(F.col("Tags"), "Tags"))
            .unionAll(part(F.col("OsNames"), "OSNames")).unionAll(part(F.col("Hostnames"), "hostnames")).filter("values is not null"))
    r = rows.withColumn("r", rules.checked_rule("given", "values")).filter("r is not null")
    return r.select("component_id", "given", "r.filter", F.array_join("r.values", ",").alias("vals"))


@query("search_terms", """
select pos, '*' || BuildDefinitionName || '*' as image_term, '*grp/svc-' || pos % 400 || '(*' as repository_term from @declared_repo""")
def _(v):
    return v.declared_repo.select("pos", text.search_term("BuildDefinitionName").alias("image_term"),
                                  text.search_term(repositories.last_two_parts("RepositoryName"), "repository").alias("repository_term"))
