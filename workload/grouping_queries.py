"""Queries over profiling, grouping, plans and structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import clustering, grouping, profile, structure, suggestions
from tallyline.session import scratch_path

from .registry import query

_TAG_ROWS = """
t as (select pos, type, unnest(tags) as tag, generate_subscripts(tags, 1) as idx from @asset),
r as (select pos, type, idx, trim(tag.key) as key, trim(tag.value) as value from t where trim(tag.key) <> '' and trim(tag.value) <> '')
"""


@query("tag_profile", "with " + _TAG_ROWS + """
select key, count(*) as asset_count, round(count(*) * 100.0 / (select count(*) from @asset), 4) as coverage_percent,
  round(count(distinct pos) * 100.0 / (select count(*) from @asset), 4) as distinct_coverage_percent, count(distinct value) as unique_values from r group by key""")
def tag_profile(v):
    p = profile.tag_profile(v.asset)
    return p.select("key", "asset_count", F.round("coverage_percent", 4).alias("coverage_percent"),
                    F.round("distinct_coverage_percent", 4).alias("distinct_coverage_percent"), "unique_values")


@query("shipment_tag_profile", """
with r as (select 'returnflag' as key, l_returnflag as value from @lineitem union all select 'linestatus', l_linestatus from @lineitem union all select 'supplier', 's' || l_suppkey from @lineitem)
select key, count(*) as asset_count, round(count(*) * 100.0 / (select count(*) from @lineitem), 4) as coverage_percent, count(distinct value) as unique_values from r group by key""")
def _(v):
    p = profile.tag_profile(v.shipment_asset)
    return p.select("key", "asset_count", F.round("coverage_percent", 4).alias("coverage_percent"), "unique_values")


@query("tag_keys_ranked", "with " + _TAG_ROWS + """,
p as (select key, count(*) as n, min(pos * 100 + idx) as f from r group by key)
select key, cast(rank as integer) as rank from (select key, row_number() over (order by n desc, f) as rank from p) where rank <= 20""")
def _(v):
    return profile.top_keys(profile.tag_profile(v.asset), 20).select("key", "rank")


@query("tag_top_values", "with " + _TAG_ROWS + """,
p as (select key, value, count(*) as n, min(pos * 100 + idx) as f from r group by key, value)
select key, value, n, cast(rank as integer) as rank from (select *, row_number() over (partition by key order by n desc, f) as rank from p) where rank <= 5""")
def _(v):
    return profile.top_values(v.asset, 5).select("key", "value", "n", "rank")


@query("asset_totals", "with " + _TAG_ROWS + """
select count(*) as total_assets, count(*) filter (where len(tags) > 0) as assets_with_tags, count(*) filter (where coalesce(len(tags), 0) = 0) as assets_without_tags,
  round(count(*) filter (where len(tags) > 0) * 100.0 / count(*), 4) as tag_coverage_percent, (select count(distinct key) from r) as total_unique_tag_keys from @asset""")
def _(v):
    t = profile.asset_totals(v.asset)
    return t.withColumn("tag_coverage_percent", F.round("tag_coverage_percent", 4))


@query("recommended_tags", "with " + _TAG_ROWS + """,
p as (select key, count(*) as n, min(pos * 100 + idx) as f from r group by key having count(*) >= 10),
c as (select key, 0 as part, case key when 'Team' then 1 when 'type' then 2 end as place from p where key in ('Team', 'type', 'absent')),
s as (select key, 1 as part, row_number() over (order by n desc, f) as place from p where key not in ('Team', 'type', 'absent', 'scanner_name', 'import_date', 'import_type', 'lastScanDateTime')),
u as (select * from c union all select * from s where place <= greatest(1, 10 - (select count(*) from c)))
select key, cast(row_number() over (order by part, place) as integer) as rank from u""")
def _(v):
    return profile.recommend_tags(profile.tag_profile(v.asset), ["absent", "Team"], ["type"])


@query("chosen_tags", "with " + _TAG_ROWS + """,
p as (select key, count(*) as n, min(pos * 100 + idx) as f from r where key <> 'scanner_name' group by key having count(*) >= 10),
o as (select key, row_number() over (order by n desc, f) as k from p)
select (select key from o where k = 1) as primary_tag, (select key from o where k = 2) as secondary_tag, count(*) filter (where len(tags) > 0) as tagged from @asset""")
def _(v):
    first, second = profile.choose_tags(profile.recommend_tags(profile.tag_profile(v.asset)))
    return v.asset.agg(F.count_if(F.coalesce(F.size("tags") > 0, F.lit(False))).alias("tagged")).select(
        F.lit(first).alias("primary_tag"), F.lit(second).alias("secondary_tag"), "tagged")


# Tag lookups of the grouping: last of a repeated key.
_TAGGED = """
a as (select *, list_filter(tags, lambda t: t.key = 'Application')[-1].value as app, list_filter(tags, lambda t: t.key = 'Team')[-1].value as team,
  len(list_filter(tags, lambda t: t.key = 'Team')) > 0 as has_team from @asset),
g as (select *, case when app <> '' then app || '|||' || case when has_team then coalesce(team, 'None') else 'NoTeam' end end as tag_key from a)
"""


@query("group_by_tags", "with " + _TAGGED + """
select tag_key as group_key, count(*) as asset_count, arg_max(app, pos) as primary_value, arg_max_null(team, pos) as secondary_value, arg_max(type, pos) as asset_type
from g where tag_key is not null group by tag_key""")
def _(v):
    return grouping.group_by_tags(v.asset, "Application", "Team").select("group_key", "asset_count", "primary_value", "secondary_value", "asset_type")


@query("untagged_by_type", "with " + _TAGGED + """
select coalesce(type, 'UNKNOWN') as asset_type, count(*) as asset_count from g where tag_key is null group by 1""")
def _(v):
    return grouping.untagged_by_type(grouping.untagged(v.asset, "Application", "Team"))


_NETWORK = r"""case when regexp_full_match(ip, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])')
  then split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.' || split_part(ip, '.', 3) || '.0/24' end"""


@query("infra_by_network", "with n as (select " + _NETWORK + """ as network from @asset where type = 'INFRA')
select 'CIDR-' || network as group_key, network, count(*) as asset_count from n where network is not null group by network""")
def _(v):
    return grouping.infra_networks(v.asset.filter("type = 'INFRA'"))


def _ratio_sql(a: str, b: str, threshold: float) -> str:
    """Whether two names of at most 120 characters reach a ratio: the edit distance decides most, else the longest common
    subsequence, as one step of a bit row for each character."""
    full = f"((1::hugeint << length({a})) - 1)"
    mask = f"list_sum(list_transform(range(length({a})), lambda i: case when {a}[i + 1] = c then 1::hugeint << i::integer else 0::hugeint end))::hugeint"
    row = f"list_reduce(list_prepend({full}, list_transform(string_split({b}, ''), lambda c: {mask})), lambda r, m: (((r + (r & m)) | (r - (r & m))) & {full})::hugeint)"
    total = f"(length({a}) + length({b}))"
    return (f"(case when {total} = 0 then true when length({a}) = 0 or length({b}) = 0 then false"
            f" when levenshtein({a}, {b}) > floor({total} * {1 - threshold} + 1e-9) then false"
            f" else 2.0::double * (length({a}) - bit_count({row})) / {total} >= {threshold} end)")


def _name_groups_sql(p: str, members: str, threshold: float, prefix: str, width: int, least: int = 2) -> str:
    """CTEs ending in ``{p}g``: leader groups of ``members`` (name, pos), leader after leader in order."""
    return f"""
{p}n as (select name, min(pos) as pos from {members} group by name),
{p}w as (select 1 as step, name, pos, min(pos) over () as head_pos, arg_min(name, pos) over () as head from {p}n
  union all select step + 1, name, pos, min(pos) over (), arg_min(name, pos) over () from {p}w where pos <> head_pos and not {_ratio_sql('name', 'head', threshold)}),
{p}l as (select name, arg_max(head, step) as leader, arg_max(head_pos, step) as leader_pos from {p}w group by name),
{p}m as (select m.pos, m.name, leader, leader_pos, row_number() over (partition by leader_pos order by m.pos) as rn from {members} m join {p}l using (name)),
{p}s as (select leader, leader_pos, '{prefix}' || substr(leader, 1, {width}) as group_key, count(*) as asset_count, min(pos) as first_pos,
  string_agg(name, ',' order by pos) filter (where rn <= 10) as sample_names from {p}m group by leader, leader_pos having count(*) >= {least}),
{p}g as (select * from (select *, row_number() over (partition by group_key order by leader_pos desc) as k from {p}s) where k = 1)
"""


_HOST_MEMBERS = "h as (select coalesce(nullif(hostname, ''), nullif(assetName, '')) as name, pos from (select *, " + _NETWORK + """ as network from @asset where type = 'INFRA')
  where network is null and coalesce(nullif(hostname, ''), nullif(assetName, '')) is not null),"""


@query("host_clusters", "with recursive " + _HOST_MEMBERS + _name_groups_sql("h", "h", 0.8, "INFRA-", 30) + "select group_key, leader_pos, asset_count, sample_names from hg")
def _(v):
    _, groups = grouping.host_groups(v.asset.filter("type = 'INFRA'"))
    return groups.select("group_key", "leader_pos", "asset_count", F.array_join("sample_names", ",").alias("sample_names"))


# Machines of many families, mixed in order: region, purpose and number.
@query("host_family_clusters", "with recursive h as (select hostname as name, pos from @fleet)," + _name_groups_sql("h", "h", 0.8, "INFRA-", 30)
       + "select group_key, leader_pos, asset_count, sample_names from hg")
def _(v):
    _, groups = grouping.host_groups(v.fleet, use_networks=False)
    return groups.select("group_key", "leader_pos", "asset_count", F.array_join("sample_names", ",").alias("sample_names"))


@query("container_clusters", "with recursive " + _TAGGED.strip() + """,
c as (select coalesce(nullif(imageName, ''), assetName, '') as name, pos from g where type = 'CONTAINER' and tag_key is null),"""
       + _name_groups_sql("c", "c", 0.85, "CONTAINER-", 40) + "select group_key, leader_pos, asset_count, sample_names from cg")
def _(v):
    _, groups = grouping.container_groups(grouping.untagged(v.asset.filter("type = 'CONTAINER'"), "Application", "Team"))
    return groups.select("group_key", "leader_pos", "asset_count", F.array_join("sample_names", ",").alias("sample_names"))


@query("software_by_repository", """
select coalesce(nullif(repository, ''), 'CODE-' || coalesce(assetName, 'unknown')) as group_key, count(*) as asset_count, arg_min(type, pos) as asset_type
from @asset where type = 'REPOSITORY' group by 1""")
def _(v):
    return grouping.software_by_repository(v.asset.filter("type = 'REPOSITORY'"))


@query("cloud_by_account", """
select coalesce(cloudProvider, 'UNKNOWN') || '-' || coalesce(account, 'no-account') || '-' || coalesce(region, 'no-region') as group_key, count(*) as asset_count,
  arg_min(coalesce(cloudProvider, 'UNKNOWN'), pos) as cloud_provider, arg_min(coalesce(account, 'no-account'), pos) as account, arg_min(region, pos) as region
from @asset where type = 'CLOUD' group by 1""")
def _(v):
    return grouping.cloud_by_account(v.asset.filter("type = 'CLOUD'"))


# Every path but the two decided by name similarity.
_KEYED = _TAGGED + """,
n as (select *, """ + _NETWORK + """ as network from g),
k as (select *, case when tag_key is not null then tag_key when type = 'INFRA' and network is not null then 'CIDR-' || network
    when type = 'INFRA' and coalesce(nullif(hostname, ''), nullif(assetName, '')) is null then 'INFRA-Ungrouped'
    when type in ('REPOSITORY', 'SOURCE_CODE', 'BUILD', 'FOSS', 'SAST') then coalesce(nullif(repository, ''), 'CODE-' || assetName)
    when type = 'CLOUD' then coalesce(cloudProvider, 'UNKNOWN') || '-' || coalesce(account, 'no-account') || '-' || coalesce(region, 'no-region')
    when type not in ('INFRA', 'CONTAINER') then type || '-Unassigned' end as group_key,
  case when tag_key is not null then 'tag' when type = 'INFRA' and network is not null then 'cidr' when type = 'INFRA' then 'hostname'
    when type = 'REPOSITORY' then 'repository' when type = 'CONTAINER' then 'image_name' when type = 'CLOUD' then 'cloud_provider' else 'type' end as method from n)
"""


@query("group_membership", "with " + _KEYED + "select asset_id, pos, group_key, method from k where group_key is not null")
def _(v):
    return grouping.member_rows(v.asset, grouping.GroupingOptions("Application", "Team"))


@query("other_types", "select coalesce(type, 'UNKNOWN') || '-Unassigned' as group_key, count(*) as asset_count from @asset where type = 'WEB' group by 1")
def _(v):
    rows = grouping.assign(v.asset.filter("type = 'WEB'"), grouping.GroupingOptions())
    return rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("asset_count"))


_PLAN = _KEYED + """,
i as (select group_key, method, count(*) as asset_count, arg_max(app, pos) filter (where tag_key is not null) as pv,
    arg_max_null(team, pos) filter (where tag_key is not null) as sv, arg_min(type, pos) as first_type, min(pos) as first_pos,
    arg_min(network, pos) as cidr, arg_min(coalesce(account, 'no-account'), pos) as account
  from k where group_key is not null group by group_key, method having count(*) >= 2),
p as (select *, substr(replace(replace(coalesce(pv, group_key), ' ', '-'), '_', '-'), 1, 100) as application_name,
  case when sv not in ('', 'NoTeam') then substr(replace(replace(replace(coalesce(pv, group_key), ' ', '-'), '_', '-') || '-' || sv, ' ', '-'), 1, 100)
    else substr(replace(group_key, '|||', '-'), 1, 100) end as component_name from i)
"""


def _plan(v):
    options = grouping.GroupingOptions("Application", "Team")
    return grouping.grouping_plan(grouping.all_groups(v.asset, options), options)


@query("grouping_plan", "with " + _PLAN + "select group_key, method, asset_count, application_name, component_name, first_type from p")
def _(v):
    return _keyed_plan(v).select(
        "group_key", "method", "asset_count", "application_name", "component_name", "first_type")


# All paths; of groups with one key the fallback replaces the tag group, then the type that appears later, then the later leader.
_FULL_PLAN = "with recursive " + _KEYED.strip() + """,
h as (select coalesce(nullif(hostname, ''), nullif(assetName, '')) as name, pos from k where method = 'hostname' and group_key is null),
c as (select coalesce(nullif(imageName, ''), assetName, '') as name, pos from k where method = 'image_name'),""" + _name_groups_sql(
    "h", "h", 0.8, "INFRA-", 30) + "," + _name_groups_sql("c", "c", 0.85, "CONTAINER-", 40) + """,
t as (select type, min(pos) as type_pos from k where tag_key is null group by type),
i as (select group_key, method, case when tag_key is null then type end as fallback, count(*) as asset_count, min(pos) as first_pos, arg_min(type, pos) as first_type,
    arg_max(app, pos) filter (where tag_key is not null) as pv, arg_max_null(team, pos) filter (where tag_key is not null) as sv,
    cast(null as bigint) as leader_pos, cast(null as varchar) as sample_names from k where group_key is not null group by 1, 2, 3
  union all select group_key, 'hostname', 'INFRA', asset_count, first_pos, 'INFRA', null, null, leader_pos, sample_names from hg
  union all select group_key, 'image_name', 'CONTAINER', asset_count, first_pos, 'CONTAINER', null, null, leader_pos, sample_names from cg),
r as (select i.*, row_number() over (partition by group_key order by fallback is not null desc, coalesce(type_pos, -1) desc,
    case when method = 'hostname' then 1 when method = 'type' and fallback = 'INFRA' then 2 else 0 end desc, coalesce(leader_pos, -1) desc) as rn
  from i left join t on t.type = i.fallback)
select group_key, method, asset_count, substr(replace(replace(coalesce(pv, group_key), ' ', '-'), '_', '-'), 1, 100) as application_name,
  case when sv not in ('', 'NoTeam') then substr(replace(replace(replace(coalesce(pv, group_key), ' ', '-'), '_', '-') || '-' || sv, ' ', '-'), 1, 100)
    else substr(replace(group_key, '|||', '-'), 1, 100) end as component_name, first_type, sample_names
from r where rn = 1 and asset_count >= 2"""


@query("full_grouping_plan", _FULL_PLAN)
def _(v):
    return _plan(v).select("group_key", "method", "asset_count", "application_name", "component_name", "first_type",
                           F.array_join("sample_names", ",").alias("sample_names"))


# A later group map replaces an earlier one of equal key: part types as tag groups, brands and types as fallbacks.
@query("group_override", """
with m as (select p_type as k, 'tag' as method, 0 as phase, count(*) as n, min(p_partkey) as f from @part group by 1
  union all select case when p_size % 2 = 0 then p_type else p_brand end, 'repository', 1, count(*), min(p_partkey) from @part group by 1)
select k as group_key, arg_max(method, phase) as method, arg_max(n, phase) as asset_count from m group by k""")
def _(v):
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("leader_pos", "bigint"), ("fallback_type", "string"))]
    tagged = v.part.groupBy(F.col("p_type").alias("group_key")).agg(F.count(F.lit(1)).alias("asset_count")).select(
        "group_key", "asset_count", F.lit("tag").alias("method"), F.lit(0).alias("phase"), F.lit(0).alias("step"), *blank)
    rest = v.part.groupBy(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("group_key")).agg(
        F.count(F.lit(1)).alias("asset_count")).select("group_key", "asset_count", F.lit("repository").alias("method"), F.lit(1).alias("phase"),
                                                       F.lit(0).alias("step"), blank[0], F.lit("BUILD").alias("fallback_type"))
    assigned = v.part.select(F.col("p_partkey").alias("pos"), F.lit("BUILD").alias("type"), F.lit(1).alias("phase"))
    starts = assigned.groupBy(F.col("type").alias("fallback_type")).agg(F.min("pos").alias("type_pos"))
    return grouping.keep_later(tagged.unionByName(rest), starts).select("group_key", "method", "asset_count")


@query("similar_asset_names", """
select applicationId as scope_id, type, coalesce(imageName, assetName) as name, count(*) as asset_count, min(pos) as first_pos
from @asset where applicationId is not null group by 1, 2, 3""")
def _(v):
    a = v.asset.filter("applicationId is not null").withColumn("name", F.coalesce("imageName", "assetName"))
    return suggestions.name_group_sizes(a).select(F.col("applicationId").alias("scope_id"), "type", "name", "asset_count", "first_pos")


@query("complete_link_names", "select p_name as name, min(p_partkey) as pos, min(p_partkey) as group_no from @part group by 1")
def _(v):
    return clustering.complete_link_groups(v.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("pos")))


def _complete_link_sql(members: str, threshold: float, scope: str | None = None) -> str:
    """CTEs ending in ``u`` (i, name, pos, group_no): greedy complete link of ``members`` (scope, name, pos, all distinct).

    Names are placed one after the other; a step counts, for every group so far, its names and those that the next one is similar to.
    """
    same = f"a.{scope} is not distinct from b.{scope} and " if scope else ""
    return f"""
n as (select *, row_number() over (order by pos) as i from {members}),
e as (select a.i, b.i as j from n a join n b on {same}b.i < a.i and {_ratio_sql('a.name', 'b.name', threshold)}),
z as (select 1::bigint as step, i, i as g from n where i = 1
  union all select step + 1, x.i, x.g from (select step, unnest(case when i = 1 then [{{'i': i, 'g': g}}, {{'i': step + 1, 'g': coalesce(chosen, step + 1)}}] else [{{'i': i, 'g': g}}] end) as x
    from (select *, min(case when hits = size then g end) over () as chosen
      from (select z.step, z.i, z.g, count(e.j) over (partition by z.g) as hits, count(*) over (partition by z.g) as size
        from z left join e on e.i = z.step + 1 and e.j = z.i where z.step < (select count(*) from n))))),
u as (select n.*, h.pos as group_no from z join n on n.i = z.i join n h on h.i = z.g where z.step = (select count(*) from n))
"""


@query("complete_link_similar_names", "with recursive m as (select p_name as name, min(p_partkey) as pos from @part group by 1)," + _complete_link_sql("m", 0.85)
       + "select name, pos, group_no from u")
def _(v):
    return clustering.complete_link_groups(v.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("pos")), 0.85)


@query("complete_link_fleet_names", "with recursive m as (select hostname as name, min(pos) as pos from @fleet group by 1)," + _complete_link_sql("m", 0.85)
       + "select name, pos, group_no from u")
def _(v):
    return clustering.complete_link_groups(v.fleet.select(F.col("hostname").alias("name"), "pos"), 0.85)


_SIMILAR_SUGGESTIONS = """
a as (select applicationId as id, type, applicationId || ' ' || type as scope, split_part(coalesce(imageName, assetName), ' ', 1) || '-' || pos % 40 as name, pos
  from @asset where applicationId is not null),
m as (select scope, id, type, name, count(*) as n, min(pos) as pos from a group by all),""" + _complete_link_sql("m", 0.8, "scope")


def _scoped_names(v):
    return v.asset.filter("applicationId is not null").withColumn("name", F.concat(F.split_part(F.coalesce("imageName", "assetName"), F.lit(" "), F.lit(1)), F.lit("-"), F.col("pos") % 40))


@query("similar_asset_name_groups", "with recursive " + _SIMILAR_SUGGESTIONS + """
select id as scope_id, type, arg_min(name, pos) as name, cast(sum(n) as bigint) as asset_count, min(pos) as first_pos from u group by id, type, group_no""")
def _(v):
    return suggestions.name_group_sizes(_scoped_names(v), 0.8).select(F.col("applicationId").alias("scope_id"), "type", "name", "asset_count", "first_pos")


@query("similar_component_suggestions", "with recursive " + _SIMILAR_SUGGESTIONS.strip() + """,
g as (select id, type, arg_min(name, pos) as name, cast(sum(n) as bigint) as n, min(pos) as f from u where type in ('CONTAINER', 'CLOUD') group by id, type, group_no having sum(n) > 5),
x as (select g.*, s.name as env, s.tags[1].value as team, s.pos as sp from g join @actual_scope s on s.id = g.id and s.type = 'ENVIRONMENT' where g.name not in (select name from @actual_component)),
r as (select *, row_number() over (partition by type, name order by sp, f) as rn from x)
select type, name as component_name, env as environment_name, team, n as asset_count from r where rn = 1""")
def _(v):
    return suggestions.component_suggestions(suggestions.name_group_sizes(_scoped_names(v), 0.8), v.actual_scope.filter("type = 'ENVIRONMENT'"), v.actual_component)


@query("component_suggestions", """
with g as (select applicationId, type, 'name-' || pos % 40 as name, count(*) as n, min(pos) as f from @asset where type in ('CONTAINER', 'CLOUD') group by 1, 2, 3 having count(*) > 5),
e as (select g.*, s.name as env, s.tags[1].value as team, s.pos as sp from g join @actual_scope s on s.id = g.applicationId and s.type = 'ENVIRONMENT'
  where g.name not in (select name from @actual_component)),
r as (select *, row_number() over (partition by type, name order by sp, f) as rn from e)
select type, name as component_name, env as environment_name, team, n as asset_count from r where rn = 1""")
def _(v):
    a = v.asset.filter("applicationId is not null").withColumn("name", F.concat(F.lit("name-"), F.col("pos") % 40))
    return suggestions.component_suggestions(suggestions.name_group_sizes(a), v.actual_scope.filter("type = 'ENVIRONMENT'"), v.actual_component)


@query("group_teams", "with " + _TAGGED + """,
t as (select *, row_number() over (partition by app order by pos) as rn from g where app <> ''),
s as (select app, arg_max_null(case when pos % 3 = 0 then team end, pos) as given from t group by app),
x as (select distinct t.app, t.team from t join s on s.app = t.app and nullif(s.given, '') is null where rn <= 10 and t.team is not null)
select app as group_key, given as team from s where nullif(given, '') is not null union all select app, team from x""")
def _(v):
    m = grouping.with_tag_group(v.asset, "Application").filter("tag_group is not null")
    second = F.when(F.col("pos") % 3 == 0, F.try_element_at(F.filter("tags", lambda t: t["key"] == "Team"), F.lit(-1))["value"])
    return structure.group_teams(m.select(F.col("tag_group").alias("group_key"), "pos", "tags", second.alias("secondary_value")))


_DEFAULTS = structure.StructureDefaults(environment_types={"INFRA": ("INFRA", "Infra"), "CLOUD": ("CLOUD", "Cloud"), "CONTAINER": ("CLOUD", "Container")}, copy_team=True)


def _keyed_plan(v):
    options = grouping.GroupingOptions("Application", "Team")
    return grouping.grouping_plan(grouping.keyed_groups(v.asset, options), options)


@query("generated_components", "with " + _PLAN + """
select application_name, component_name, 'Autogenerated' as status, 'Release' as component_type, sv as team from p where first_type in ('WEB', 'WEBSITE_API', 'REPOSITORY', 'SOURCE_CODE', 'BUILD', 'FOSS', 'SAST')""")
def _(v):
    return structure.component_rows(_keyed_plan(v), _DEFAULTS, "Application").select("application_name", "component_name", "status", "component_type", "team")


@query("generated_services", "with " + _PLAN + """
select application_name as environment_name, component_name as service_name, case first_type when 'INFRA' then 'INFRA' else 'CLOUD' end as environment_type,
  case first_type when 'INFRA' then 'Infra' when 'CLOUD' then 'Cloud' else 'Container' end as service_type, 5 as tier, sv as team from p where first_type in ('INFRA', 'CLOUD', 'CONTAINER')""")
def _(v):
    return structure.service_rows(_keyed_plan(v), _DEFAULTS, "Application").select("environment_name", "service_name", "environment_type", "service_type", "tier", "team")


_PARENTS = "with " + _PLAN + """
select 'environment' as side, application_name as name, count(*) as children, arg_min(case first_type when 'INFRA' then 'INFRA' else 'CLOUD' end, first_pos) as type from p where first_type in ('INFRA', 'CLOUD', 'CONTAINER') group by 2
union all select 'application', application_name, count(*), null from p where first_type in ('WEB', 'REPOSITORY') group by 2"""


@query("generated_parents", _PARENTS)
def generated_parents(v):
    plan = _keyed_plan(v)
    env = structure.environment_rows(structure.service_rows(plan, _DEFAULTS, "Application"), _DEFAULTS)
    app = structure.application_rows(structure.component_rows(plan, _DEFAULTS, "Application"), _DEFAULTS)
    return env.select(F.lit("environment").alias("side"), F.col("environment_name").alias("name"), F.col("services").alias("children"), F.col("environment_type").alias("type")).unionByName(
        app.select(F.lit("application").alias("side"), F.col("application_name").alias("name"), F.col("components").alias("children"), F.lit(None).cast("string").alias("type")))


@query("generated_structure_files", _PARENTS)
def _(v):
    from tallyline.sources import sinks
    path = scratch_path(v.spark, "structure")
    sinks.write_structure(path, "parquet", parents=generated_parents(v))
    return v.spark.read.parquet(f"{path}/parents")


@query("group_filters", "with " + _PLAN + """
select group_key, case method when 'tag' then 'Tag=Application: ' || pv when 'cidr' then 'Cidr=' || cidr when 'repository' then 'RepositoryName=' || group_key
  when 'cloud_provider' then 'ProviderAccountId=' || account || ';AssetType=' || first_type when 'type' then 'AssetType=' || first_type end as rule from p""")
def _(v):
    rule = structure.group_filter("Application")
    show = lambda n: F.concat(F.lit(n + "="), F.array_join(rule[n], ",") if n in ("Hostnames", "ProviderAccountId") else rule[n])
    return _keyed_plan(v).select("group_key", F.concat_ws(";", *[show(n) for n in (
        "Tag", "Cidr", "Hostnames", "RepositoryName", "ProviderAccountId", "SearchName", "AssetType")]).alias("rule"))


@query("group_tag_rules", "with " + _PLAN + """
select application_name, component_name, 'AUTO-RULE-' || component_name || '-Application' as rule_name, 'Application' as tag_key, pv as tag_value from p where method = 'tag'
union all select application_name, component_name, 'AUTO-RULE-' || component_name || '-Team', 'Team', sv from p where method = 'tag' and sv not in ('', 'NoTeam')""")
def _(v):
    return structure.tag_rules(_keyed_plan(v), "Application", "Team")


@query("structure_teams", "with " + _PLAN + """
select distinct sv as team from p where sv <> '' and first_type in ('INFRA', 'CLOUD', 'CONTAINER', 'WEB', 'REPOSITORY')""")
def _(v):
    plan = _keyed_plan(v)
    return structure.structure_teams(structure.component_rows(plan, _DEFAULTS, "Application"), structure.service_rows(plan, _DEFAULTS, "Application"))
