"""Queries over placement, lookups, deployments and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import cloud_services, deployments, placement, team_tags
from tallyline.plans import sync

from .registry import query


def _components(v):
    return v.declared_component.select("component_id", F.col("component").alias("name"), "app_name", "target")


def _services(v):
    return v.declared_service.select("service_id", F.col("service").alias("name"), "env_name", "target")


_PLACE = """
h as (select lower(name) as k, applicationId as s, arg_max(id, pos) as id, count(*) as n from @actual_component group by 1, 2),
a as (select lower(name) as k, count(*) as n from @actual_component group by 1)
select {key}, h.id is not null as entity_exists, h.id as entity_id, case when h.id is not null then 'update_rules' else 'create' end as action_required,
  case when h.id is not null then 'same_scope' when coalesce(a.n, 0) - coalesce(h.n, 0) > 0 then 'cross_scope' else 'none' end as conflict_type
from {rows} d left join h on lower(d.{name}) = h.k and d.target = h.s left join a on lower(d.{name}) = a.k"""


@query("component_placement", "with " + _PLACE.format(key="component_id", rows="@declared_component", name="component"))
def _(v):
    return placement.place(_components(v), v.actual_component).drop("name", "app_name", "target")


@query("service_placement", "with " + _PLACE.format(key="service_id", rows="@declared_service", name="service"))
def _(v):
    return placement.place(_services(v), v.actual_component).drop("name", "env_name", "target")


@query("other_scopes", """
with a as (select lower(name) as k, applicationId as s, count(*) as n from @actual_component group by 1, 2)
select component_id, cast(coalesce(sum(a.n) filter (where a.s <> d.target), 0) as bigint) as other_entities
from @declared_component d left join a on lower(d.component) = a.k group by component_id""")
def _(v):
    return placement.other_scopes(_components(v), v.actual_component).select("component_id", "other_entities")


@query("name_holders", """
select lower(c.name) as name_key, c.id as entity_id, c.applicationId as scope_id, coalesce(s.name, 'env-' || substr(c.applicationId, 1, 8)) as scope_name
from @actual_component c left join @actual_scope s on s.id = c.applicationId where lower(c.name) in (select lower(component) from @declared_component)""")
def _(v):
    return placement.name_holders(_components(v), v.actual_component, v.actual_scope)


@query("scope_by_name", """
select service_id, s.id as scope_id from @declared_service d left join @actual_scope s on s.name = d.env_name and s.type = 'ENVIRONMENT'""")
def _(v):
    return placement.find_scope(_services(v), "env_name", v.actual_scope).select("service_id", "scope_id")


@query("service_exists", """
select service_id, exists (select 1 from @actual_component a where a.applicationId = d.target and lower(a.name) = lower(d.service)) as folded,
  exists (select 1 from @actual_component a where a.applicationId = d.target and a.name = d.service) as exact from @declared_service d""")
def _(v):
    s = _services(v)
    mark = lambda df, name: df.select("service_id").withColumn(name, F.lit(True))
    return (s.select("service_id").join(mark(placement.existing(s, v.actual_component), "_f"), "service_id", "left")
            .join(mark(placement.existing(s, v.actual_component, ignore_case=False), "_e"), "service_id", "left")
            .select("service_id", F.coalesce("_f", F.lit(False)).alias("folded"), F.coalesce("_e", F.lit(False)).alias("exact")))


# Ratios of the pairs in ``pr`` (a, b) by the usual table of longest common subsequences, row by row.
_RATIOS = """
dp(a, b, i, cells) as (
  select a, b, 0, list_transform(range(0, length(b) + 1), lambda j: 0) from pr
  union all
  select a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc,
      case when substr(a, i + 1, 1) = substr(b, j::int, 1) then cells[j] + 1 else greatest(cells[j + 1], acc[len(acc)]) end), [0]::int[])
  from dp where i < length(a)),
sc as (select a, b, 2.0::double * cells[len(cells)] / (length(a) + length(b)) as ratio from dp where i = length(a))
"""


# Every third actual service carries the long form of the name, so all steps of the cascade occur.
@query("service_lookup", """
with recursive w as (select service_id, repeat(service, 4) || case when service_id % 4 = 1 then 'x' else '' end as name, env_name, target from @declared_service),
st as (select 'id-' || service_id as id, case when service_id % 3 = 0 then lower(repeat(service, 4) || '-' || env_name) else repeat(upper(service), 4) end as name,
  target as scope, service_id as pos from @declared_service where service_id % 7 <> 0),
bn as (select lower(name) as n, scope, arg_min(id, pos) as id, min(pos) as pos from st group by 1, 2),
x as (select w.*, lower(w.name) as dn, e.id as exact, u.id as suffixed from w left join bn e on e.n = lower(w.name) and e.scope = target
  left join bn u on u.n = lower(w.name || '-' || env_name) and u.scope = target),
pr as (select distinct dn as a, n as b from x join bn on scope = target where exact is null and 2.0 * least(length(dn), length(n)) > 0.99 * (length(dn) + length(n))),
""" + _RATIOS + """,
best as (select service_id, bn.id, ratio, row_number() over (partition by service_id order by ratio desc, bn.pos) as rn
  from x join sc on sc.a = dn and ratio > 0.99 join bn on bn.n = sc.b and bn.scope = target where exact is null)
select x.service_id, coalesce(exact, best.id, suffixed) as entity_id,
  case when exact is not null then 'exact' when best.id is not null then 'similar' when suffixed is not null then 'suffixed' else 'none' end as found_by,
  round(case when exact is not null then 1.0::double when best.id is not null then best.ratio end, 6) as ratio
from x left join best on best.service_id = x.service_id and rn = 1""")
def _(v):
    wanted = v.declared_service.select("service_id", F.concat(F.repeat("service", F.lit(4)), F.when(F.col("service_id") % 4 == 1, "x").otherwise("")).alias("name"), "env_name", "target")
    stored = v.declared_service.filter("service_id % 7 <> 0").select(
        F.concat(F.lit("id-"), "service_id").alias("id"), F.when(F.col("service_id") % 3 == 0, F.lower(F.concat(F.repeat("service", F.lit(4)), F.lit("-"), "env_name")))
        .otherwise(F.repeat(F.upper("service"), F.lit(4))).alias("name"), F.col("target").alias("applicationId"), F.col("service_id").alias("pos"))
    return placement.find_service(wanted, stored).select("service_id", "entity_id", "found_by", F.round("ratio", 6).alias("ratio"))


@query("verification_report", """
with f as (select service_id, exists (select 1 from @actual_component a where a.applicationId = d.target and lower(a.name) = lower(d.service)) as found from @declared_service d)
select count(*) as total, count(*) filter (where found) as found, count(*) filter (where not found) as failed, round(count(*) filter (where found) * 100.0 / count(*), 4) as success_rate from f""")
def _(v):
    r = placement.verification_report(placement.find_service(_services(v), v.actual_component))
    return r.withColumn("success_rate", F.round("success_rate", 4))


@query("application_lookup", """
with s as (select name, id, pos from @actual_scope where type = 'APPLICATION'),
f as (select lower(name) as k, arg_min(id, pos) as id from s group by 1)
select app_no, coalesce(s.id, f.id) as scope_id, case when s.id is not null then 'exact' when f.id is not null then 'folded' else 'none' end as found_by
from @declared_app d left join s on s.name = d.app_name left join f on f.k = lower(d.app_name)""")
def _(v):
    return placement.find_application(v.declared_app.select("app_no", "app_name"), "app_name", v.actual_scope).select("app_no", "scope_id", "found_by")


@query("application_upsert", """
select app_no, case when exists (select 1 from @actual_scope s where s.name = d.app_name and s.type = 'APPLICATION') then 'update' else 'create' end as action from @declared_app d""")
def _(v):
    return placement.upsert(v.declared_app.select("app_no", "app_name"), "app_name", v.actual_scope, "APPLICATION").select("app_no", "action")


@query("environment_upsert", """
select d.Name as name, s.id as scope_id, case when s.id is null then 'create' else 'update' end as action from @declared_env d left join @actual_scope s on s.name = d.Name and s.type = 'ENVIRONMENT'""")
def _(v):
    return placement.upsert(v.declared_env.select(F.col("Name").alias("name")), "name", v.actual_scope, "ENVIRONMENT")


@query("scope_lookup_by_type", """
select p_partkey, (select min(id) from @actual_scope s where s.name = 'App ' || p_partkey and s.type = 'APPLICATION') is not null as is_application from @part""")
def _(v):
    names = v.part.select("p_partkey", F.concat(F.lit("App "), "p_partkey").alias("name"))
    return placement.find_scope(names, "name", v.actual_scope, "APPLICATION").select("p_partkey", F.col("scope_id").isNotNull().alias("is_application"))


@query("service_sync", """
select service_id, a.id as entity_id, case when a.id is null then 'create' else 'update_rules' end as action
from @declared_service d join @actual_scope s on s.name = d.env_name and s.type = 'ENVIRONMENT'
left join (select lower(name) as k, applicationId as s, arg_max(id, pos) as id from @actual_component group by 1, 2) a on a.k = lower(d.service) and a.s = s.id""")
def _(v):
    rows = _services(v).drop("target")
    return placement.service_sync(rows, v.actual_scope, v.actual_component).select("service_id", "entity_id", "action")


@query("service_sync_plain", """
select service_id, case when exists (select 1 from @actual_component a where lower(a.name) = lower(d.service) and a.applicationId = s.id) then 'update_rules' else 'create' end as action
from @declared_service d join @actual_scope s on s.name = d.env_name and s.type = 'ENVIRONMENT'""")
def _(v):
    return placement.service_sync(_services(v).drop("target"), v.actual_scope, v.actual_component, checked=False).select("service_id", "action")


@query("applications_verified", """
select app_no, case when app_name in (select name from @actual_scope) then 'present' else 'absent' end as status from @declared_app""")
def _(v):
    return placement.verify_names(v.declared_app.select("app_no", F.col("app_name").alias("name")), ["name"], v.actual_scope).select("app_no", "status")


@query("components_verified", """
select component_id, case when exists (select 1 from @actual_component a where a.applicationId = d.target and a.name = d.component) then 'present' else 'absent' end as status from @declared_component d""")
def _(v):
    actual = v.actual_component.select(F.col("applicationId").alias("target"), "name")
    return placement.verify_names(_components(v), ["target", "name"], actual).select("component_id", "status")


@query("services_missing_from_snapshot", """
select service_id, service from @declared_service d where not exists (select 1 from @actual_component a where a.applicationId = d.target and lower(a.name) = lower(d.service))""")
def _(v):
    return placement.absent(_services(v), v.actual_component).select("service_id", F.col("name").alias("service"))


@query("third_party_missing", """
select x.name, 'Thirdparty' as env_name, 5 as tier, 'env-t' as target from (select 'Salesforce' as name union all select min(s_name) from @supplier where s_suppkey % 3 <> 0) x
where not exists (select 1 from @actual_component a where a.applicationId = 'env-t' and lower(a.name) = lower(x.name))""")
def _(v):
    known = v.supplier.filter("s_suppkey % 3 <> 0").agg(F.min("s_name").alias("name"))
    wanted = known.unionByName(known.select(F.lit("Salesforce").alias("name")))
    return placement.third_party_missing(v.actual_scope, v.actual_component, wanted)


@query("filter_audit", """
select count(*) as total, count(*) filter (where applicationId = 'env-3') as in_scope, count(*) filter (where applicationId = 'env-3' or pos % 100 = 0) as fetched,
  count(*) filter (where pos % 100 = 0 and applicationId <> 'env-3') as wrong_scope,
  count(*) filter (where applicationId = 'env-3') = count(*) filter (where applicationId = 'env-3' or pos % 100 = 0) as consistent from @actual_component""")
def _(v):
    fetched = v.actual_component.filter("applicationId = 'env-3' or pos % 100 = 0")
    return placement.filter_audit(v.actual_component, fetched, "env-3")


@query("scope_breakdown", """
select applicationId as scope_id, count(*) as entities from @actual_component group by 1 order by 2 desc, 1 limit 10""")
def _(v):
    return placement.scope_breakdown(v.actual_component)


@query("name_locations", """
select lower(name) as name_key, case when length(applicationId) > 30 and length(applicationId) - length(replace(applicationId, '-', '')) >= 4 then 'Environment' else 'Application' end as location_type, count(*) as instances
from @actual_component group by 1, 2""")
def _(v):
    return placement.locations(v.actual_component)


@query("duplicates_inside_scope", """
with i as (select applicationId, lower(name) as name_key, count(*) as copies from @actual_component group by 1, 2), s as (select name_key, count(*) as scopes from i group by 1)
select i.*, scopes from i join s using (name_key) where copies > 1""")
def _(v):
    return placement.duplicates_inside(v.actual_component)


@query("held_by_both", """
select lower(name) as name_key, bool_or(applicationId = 'app-1') as in_first, bool_or(applicationId = 'app-2') as in_second, true as cross_allowed
from @actual_component group by 1 having bool_or(applicationId in ('app-1', 'app-2'))""")
def _(v):
    return placement.held_by_both(v.actual_component, "app-1", "app-2")


@query("name_collisions", """
with e as (select p_partkey, 'f' || p_partkey % 20 as file, case when p_partkey % 3 = 0 then 'App ' || p_partkey else 'Env ' || p_partkey end as name from @part)
select p_partkey, e.file, e.name from e where exists (select 1 from @declared_app a where a.file = e.file and a.app_name = e.name)""")
def _(v):
    envs = v.part.select("p_partkey", F.concat(F.lit("f"), F.col("p_partkey") % 20).alias("file"), F.concat(F.when(F.col("p_partkey") % 3 == 0, "App ").otherwise("Env "), "p_partkey").alias("name"))
    return placement.name_collisions(v.declared_app.select("file", F.col("app_name").alias("name")), envs)


# --- deployments ---------------------------------------------------------------------------------

_USABLE = """
u as (select d.*, s.id is null or exists (select 1 from @actual_component a where a.applicationId = s.id and a.name = d.service) as usable
  from @declared_service d left join @actual_scope s on s.name = d.env_name and s.type = 'ENVIRONMENT'),
ap as (select * from @declared_app where app_name in (select name from @actual_scope where type = 'APPLICATION'))
"""


def _known(v):
    return deployments.known_services(v.declared_service, v.actual_scope, v.actual_component)


def _apps(v):
    return deployments.existing_applications(v.declared_app.select("app_no", "app_name", "deployment_set"), v.actual_scope)


@query("usable_services", "with " + _USABLE + "select service_id, usable from u")
def _(v):
    return _known(v).select("service_id", "usable")


@query("deployment_links", "with " + _USABLE + """
select app_no, service, env_name, case when lower(u.deployment_set) = lower(ap.deployment_set) then 'name' else 'tag' end as link_by,
  case when lower(u.deployment_set) = lower(ap.deployment_set) then service else deployment_tag end as selector
from ap join u on usable and (lower(u.deployment_set) = lower(ap.deployment_set) or lower(u.deployment_tag) = lower(ap.deployment_set))""")
def _(v):
    return deployments.deployment_links(_apps(v), _known(v).filter("usable")).select("app_no", "service", "env_name", "link_by", "selector")


@query("deployment_link_sets", "with " + _USABLE + """,
m as (select lower(deployment_set) as set_key, count(*) as members from ap where deployment_set <> '' group by 1),
l as (select lower(ap.deployment_set) as set_key, count(*) as links from ap join u on usable
  and (lower(u.deployment_set) = lower(ap.deployment_set) or lower(u.deployment_tag) = lower(ap.deployment_set)) where ap.deployment_set <> '' group by 1)
select set_key, members, cast(coalesce(links, 0) / members as bigint) as selectors, coalesce(links, 0) as links from m left join l using (set_key)""")
def _(v):
    return deployments.link_groups(_apps(v), _known(v).filter("usable"))[0]


@query("deployment_set_members", "with " + _USABLE + "select app_no, lower(deployment_set) as set_key from ap where deployment_set <> ''")
def _(v):
    return deployments.link_groups(_apps(v), _known(v).filter("usable"))[1].select("app_no", "set_key")


@query("deployment_set_selectors", "with " + _USABLE + """
select lower(deployment_set) as set_key, service, env_name, 'name' as link_by, service as selector from u where usable and deployment_set <> ''
union all select lower(deployment_tag), service, env_name, 'tag', deployment_tag from u where usable and deployment_tag <> ''
  and lower(nullif(deployment_set, '')) is distinct from lower(deployment_tag)""")
def _(v):
    return deployments.link_groups(_apps(v), _known(v).filter("usable"))[2]


@query("links_of_one_set", "with " + _USABLE + """
select app_no, service, env_name from ap join u on usable and (lower(u.deployment_set) = lower(ap.deployment_set) or lower(u.deployment_tag) = lower(ap.deployment_set))
where lower(ap.deployment_set) = 'set-5'""")
def _(v):
    _, members, selectors = deployments.link_groups(_apps(v), _known(v).filter("usable"))
    return deployments.links_of(members.filter("set_key = 'set-5'"), selectors).select("app_no", "service", "env_name")


@query("deployment_errors", "with " + _USABLE + """
select service, env_name, (select count(*) from ap where deployment_set <> '') as asked_by from u where not usable""")
def _(v):
    return deployments.missing_service_errors(_apps(v), _known(v))


@query("deployment_mismatches", "with " + _USABLE + """
select ap.deployment_set, count(distinct app_no) as applications,
  count(*) filter (where coalesce(lower(u.deployment_set) = lower(ap.deployment_set), false) or coalesce(lower(u.deployment_tag) = lower(ap.deployment_set), false)) as links,
  count(*) filter (where not (coalesce(lower(u.deployment_set) = lower(ap.deployment_set), false) or coalesce(lower(u.deployment_tag) = lower(ap.deployment_set), false))) as mismatches
from ap cross join u where usable and ap.deployment_set <> '' group by 1""")
def _(v):
    return deployments.mismatch_counts(_apps(v), _known(v).filter("usable"))


@query("mismatches_of_one_set", "with " + _USABLE + """
select service_id from u where usable and not (coalesce(lower(deployment_set) = 'set-5', false) or coalesce(lower(deployment_tag) = 'set-5', false))""")
def _(v):
    return deployments.mismatched_services(_known(v).filter("usable"), "Set-5").select("service_id")


@query("component_deployments", "with " + _USABLE + """,
c as (select * from @declared_component d where deployment_set <> '' and exists (select 1 from @actual_scope s join @actual_component a on a.applicationId = s.id
  where s.type = 'APPLICATION' and s.name = d.app_name and a.name = d.component)),
l as (select component_id, app_name, component, case when lower(u.deployment_set) = lower(c.deployment_set) then 'name' else 'tag' end as link_by,
  case when lower(u.deployment_set) = lower(c.deployment_set) then service else lower(deployment_tag) end as selector, env_name
  from c join u on usable and (lower(u.deployment_set) = lower(c.deployment_set) or lower(u.deployment_tag) = lower(c.deployment_set)))
select component_id, link_by, selector, env_name from (select component_id, link_by, selector, l.env_name as env_name from l
  union all select component_id, 'inherit', null, null from c where component_id not in (select component_id from l))""")
def _(v):
    comps = v.declared_component.select("component_id", "app_name", "component", "deployment_set")
    return deployments.component_links(comps, _known(v).filter("usable"), v.actual_scope, v.actual_component).select("component_id", "link_by", "selector", "env_name")


@query("component_link_sets", "with " + _USABLE + """,
c as (select * from @declared_component d where deployment_set <> '' and exists (select 1 from @actual_scope s join @actual_component a on a.applicationId = s.id
  where s.type = 'APPLICATION' and s.name = d.app_name and a.name = d.component)),
x as (select distinct lower(deployment_set) as set_key from c),
n as (select set_key, count(*) as selectors from x join u on usable and (lower(u.deployment_set) = set_key or lower(u.deployment_tag) = set_key) group by 1)
select component_id, lower(deployment_set) as set_key, n.selectors is null as inherits, coalesce(n.selectors, 0) as selectors from c left join n on n.set_key = lower(deployment_set)""")
def _(v):
    comps = v.declared_component.select("component_id", "app_name", "component", "deployment_set")
    groups, members, _ = deployments.component_link_groups(comps, _known(v).filter("usable"), v.actual_scope, v.actual_component)
    return members.join(groups.select("set_key", "selectors"), "set_key").select("component_id", "set_key", "inherits", "selectors")


@query("absent_components", """
select component_id, app_name, component, 'component not found in its application' as error from @declared_component d
where component <> '' and app_name in (select name from @actual_scope where type = 'APPLICATION') and not exists (
  select 1 from @actual_scope s join @actual_component a on a.applicationId = s.id where s.type = 'APPLICATION' and s.name = d.app_name and a.name = d.component)""")
def _(v):
    comps = v.declared_component.select("component_id", "app_name", "component")
    return deployments.absent_components(comps, v.actual_scope, v.actual_component)


@query("auto_links", """
select a.name as app_name, s_name as service from (select case when c_custkey % 2 = 0 then 'SUPPLIER#' || lpad(cast(c_custkey as varchar), 9, '0') else c_name end as name from @customer) a
join @supplier on lower(s_name) = lower(a.name)""")
def _(v):
    apps = v.customer.select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))).otherwise(F.col("c_name")).alias("app_name"))
    return deployments.auto_links(apps, v.supplier.select(F.col("s_name").alias("service"), F.lit("e").alias("env_name"))).select("app_name", "service")


# Names of parts and of brand-free types: few share a spelling, many are close.
@query("auto_links_similar", """
with recursive ap as (select distinct p_name as app_name from @part), sv as (select distinct p_name || 's' as service from @part),
pr as (select app_name as a, service as b from ap join sv on 2.0 * least(length(app_name), length(service)) > 0.9 * (length(app_name) + length(service))
  and levenshtein(app_name, service) <= 0.1 * (length(app_name) + length(service)) + 0.001 and lower(app_name) <> lower(service)),
""" + _RATIOS + """
select app_name, service from ap join sv on lower(app_name) = lower(service)
union all select a, b from sc where ratio > 0.9""")
def _(v):
    apps = v.part.select(F.col("p_name").alias("app_name")).distinct()
    services = v.part.select(F.concat("p_name", F.lit("s")).alias("service")).distinct().withColumn("env_name", F.lit("e"))
    return deployments.auto_links(apps, services, 0.9).select("app_name", "service")


# --- tags ----------------------------------------------------------------------------------------

@query("stale_team_tags", """
with o as (select "Key" as k, arg_max("Value", pos) as val from @repo_override group by 1),
r as (select distinct 'grp/' || split_part(RepositoryName, '/', 3) as n, Team, coalesce(val, Subdomain) as subdomain from @declared_repo left join o on k = RepositoryName),
t as (select id, name, unnest(tags) as t from @actual_component)
select t.id as component_id, name as component_name, t.t.id as tag_id, t.t.value as old_team, Team as expected_team, subdomain
from t join r on r.n = t.name where t.t.key = 'pteam' and t.t.value <> Team""")
def _(v):
    return team_tags.stale_team_tags(v.actual_component, v.declared_repo, v.repo_override)


_EXPECTED = """
with o as (select "Key" as k, arg_max("Value", pos) as val from @repo_override group by 1),
r as (select distinct 'grp/' || split_part(RepositoryName, '/', 3) as n, Team, coalesce(val, Subdomain) as subdomain from @declared_repo left join o on k = RepositoryName)"""


@query("expected_teams", _EXPECTED + " select n as name, count(Team) over (partition by n) as teams, Team as expected_team, subdomain from r")
def _(v):
    return team_tags.expected_teams(v.declared_repo, v.repo_override)


@query("stale_tags", _EXPECTED + """,
t as (select id, name, unnest(tags) as t from @actual_component)
select t.id as component_id, name as component_name, t.t.id as tag_id, t.t.value as old_team, count(*) as differing
from t join r on r.n = t.name where t.t.key = 'pteam' and t.t.value <> Team group by all""")
def _(v):
    return team_tags.stale_tags(v.actual_component, team_tags.expected_teams(v.declared_repo, v.repo_override))


@query("application_team_changes", """
with j as (select d.app_name, s.id, coalesce(d.TeamNames, []) as teams, list_transform(list_filter(s.tags, lambda t: t.key = 'pteam'), lambda t: t.value) as stored
  from (select app_name, case when app_no % 14 = 6 then list_slice(TeamNames, 1, 1) else TeamNames end as TeamNames from @declared_app) d join @actual_scope s on s.name = d.app_name)
select app_name, id as entity_id, 'remove' as action, x as team from (select app_name, id, teams, unnest(stored) as x from j) where not list_contains(teams, x)
union all select app_name, id, 'add', x from (select app_name, id, stored, unnest(teams) as x from j) where not list_contains(stored, x)""")
def _(v):
    # Some lists hold a null beside one team; it counts as no team.
    declared = v.declared_app.withColumn("TeamNames", F.when(F.col("app_no") % 14 == 6, F.array(F.get("TeamNames", F.lit(0)), F.lit(None).cast("string"))).otherwise(F.col("TeamNames")))
    return team_tags.team_tag_changes(declared, v.actual_scope.withColumnRenamed("name", "app_name"), ["app_name"])


@query("component_team_changes", """
with j as (select d.component_id, s.id, coalesce(d.TeamNames, []) as teams, list_transform(list_filter(s.tags, lambda t: t.key = 'pteam'), lambda t: t.value) as stored
  from @declared_component d join @actual_component s on s.id = 'cmp-' || d.component_id)
select component_id, id as entity_id, 'remove' as action, x as team from (select component_id, id, teams, unnest(stored) as x from j) where not list_contains(teams, x)""")
def _(v):
    actual = v.actual_component.filter("id like 'cmp-%'").withColumn("component_id", F.substring("id", 5, 20).cast("bigint"))
    return team_tags.team_tag_changes(v.declared_component, actual, ["component_id"], add=False)


# --- services per cloud environment --------------------------------------------------------------

@query("missing_cloud_services", """
with e as (select d.Name as Name, s.id from @declared_env d left join @actual_scope s on s.name = d.Name and s.type = 'ENVIRONMENT' where CloudAccounts <> ''),
w as (select Subdomain as n, cast(arg_min(Tier, pos) as integer) as tier from @declared_repo group by 1 union all select 'Databricks', 5)
select e.Name as env_name, w.n as service, w.tier from e cross join w where not exists (select 1 from @actual_component a where a.applicationId = e.id and lower(a.name) = lower(w.n))""")
def _(v):
    return cloud_services.missing_cloud_services(v.declared_env, cloud_services.subdomains(v.declared_repo), v.actual_scope, v.actual_component)


@query("cloud_service_gaps", """
with e as (select d.Name as Name, s.id from @declared_env d left join @actual_scope s on s.name = d.Name and s.type = 'ENVIRONMENT' where CloudAccounts <> ''),
w as (select distinct Subdomain as n from @declared_repo union all select 'Databricks')
select e.Name as env_name, e.id as target, count(*) as wanted, count(*) filter (where here) as present, count(*) filter (where not here) as missing
from (select e.*, exists (select 1 from @actual_component a where a.applicationId = e.id and lower(a.name) = lower(w.n)) as here from e cross join w) e group by 1, 2""")
def _(v):
    return cloud_services.cloud_service_gaps(v.declared_env, cloud_services.subdomains(v.declared_repo), v.actual_scope, v.actual_component)


@query("pipeline_rule_list", """
select case when lower(Subdomain) = 'fx' then 'Foreign Exchange(FX)' else Subdomain end as service, 'pipeline ' || BuildDefinitionName as rule_name,
  'pipeline' as tag_key, BuildDefinitionName as tag_value from @declared_repo""")
def _(v):
    return cloud_services.pipeline_rule_tables(v.declared_env, v.declared_repo)[0]


@query("pipeline_accounts", "select Name as env_name, CloudAccounts as provider_accounts from @declared_env where CloudAccounts <> ''")
def _(v):
    return cloud_services.pipeline_rule_tables(v.declared_env, v.declared_repo)[1]


@query("pipeline_rules", """
select Name as env_name, case when lower(Subdomain) = 'fx' then 'Foreign Exchange(FX)' else Subdomain end as service, 'pipeline ' || BuildDefinitionName as rule_name,
  'pipeline' as tag_key, BuildDefinitionName as tag_value, CloudAccounts as provider_accounts
from (select case when pos % 10 = 0 then 'fx' else Subdomain end as Subdomain, BuildDefinitionName from @declared_repo) cross join @declared_env where CloudAccounts <> ''""")
def _(v):
    repos = v.declared_repo.withColumn("Subdomain", F.when(F.col("pos") % 10 == 0, "fx").otherwise(F.col("Subdomain")))
    return cloud_services.pipeline_rules(v.declared_env, repos)


@query("repository_domains", "select Domain, min(pos) as first_pos from @declared_repo group by 1")
def _(v):
    return cloud_services.domains(v.declared_repo)


@query("repository_subdomains", "select Subdomain as \"Name\", arg_min(Domain, pos) as \"Domain\", arg_min(Tier, pos) as \"Tier\", min(pos) as pos from @declared_repo group by 1")
def _(v):
    return cloud_services.subdomains(v.declared_repo)


@query("subdomain_owners", "select Subdomain, Team, min(pos) as first_pos from @declared_repo group by 1, 2")
def _(v):
    return cloud_services.subdomain_owners(v.declared_repo)


@query("repositories_by_subdomain", "select Subdomain, RepositoryName, pos from @declared_repo")
def _(v):
    return cloud_services.by_subdomain(v.declared_repo).select("Subdomain", "RepositoryName", "pos")


@query("service_node_rules", """
select env_name, service, 'node_type ' || Type as rule_name, 'node_type' as tag_key, Type as tag_value, 'acct-' || target as provider_accounts from @declared_service""")
def _(v):
    from tallyline.operators.rules import tag_rule
    return tag_rule(v.declared_service.select("env_name", "service", "Type", "target"), F.lit("node_type"), "Type", F.concat(F.lit("acct-"), "target")).drop("Type", "target")


@query("synced_deployments", "with " + _USABLE + """
select 'application' as side, count(*) as links from ap join u on usable and (lower(u.deployment_set) = lower(ap.deployment_set) or lower(u.deployment_tag) = lower(ap.deployment_set))
union all select 'component', count(*) from (select * from @declared_component d where exists (select 1 from @actual_scope s join @actual_component a on a.applicationId = s.id
  where s.type = 'APPLICATION' and s.name = d.app_name and a.name = d.component)) c join u on usable and (lower(u.deployment_set) = lower(c.deployment_set) or lower(u.deployment_tag) = lower(c.deployment_set))""")
def _(v):
    out = sync.deployment_actions(v.declared_app.select("app_no", "app_name", "deployment_set"), v.declared_component.select("component_id", "app_name", "component", "deployment_set"),
                                  v.declared_service, v.actual_scope, v.actual_component)
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("links")).select(F.lit(side).alias("side"), "links")
    return count(out["application_links"], "application").unionByName(count(out["component_links"].filter("link_by <> 'inherit'"), "component"))
