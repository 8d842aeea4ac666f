"""Queries over sources: JSON text derived from the tables, read with the package's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline import schemas
from tallyline.functions import tags
from tallyline.session import scratch_path
from tallyline.sources import configs, images, readers, sinks

from .registry import query

# One JSON array of two assets per customer.
_ASSET_TEXT = """select c_custkey, '[{"asset_id":"c' || c_custkey || '","pos":' || c_custkey * 2 || ',"type":"INFRA","hostname":"h' || c_nationkey ||
 '","tags":[{"key":"seg","value":"' || c_mktsegment || '"},{"value":"x"}],"extra":1},{"asset_id":"d' || c_custkey || '","pos":' || (c_custkey * 2 + 1) ||
 ',"type":"CLOUD"' || case when c_custkey % 2 = 0 then ',"applicationId":"env-' || c_nationkey || '"' else '' end || '}]' as raw from @customer"""


@query("asset_file_scan", """
select 'c' || c_custkey as asset_id, c_custkey * 2 as pos, 'INFRA' as type, 'h' || c_nationkey as hostname, 'seg=' || c_mktsegment || '|=x' as tags from @customer
union all select 'd' || c_custkey, c_custkey * 2 + 1, 'CLOUD', null, null from @customer""")
def _(v):
    a = readers.assets_from_text(v.sql(_ASSET_TEXT))
    return a.select("asset_id", "pos", "type", "hostname", tags.tags_text("tags").alias("tags"))


@query("asset_page_scan", """
select 'c' || c_custkey as asset_id, 'INFRA' as type from @customer union all select 'd' || c_custkey, 'CLOUD' from @customer where c_custkey % 2 <> 0""")
def _(v):
    pages = v.sql(_ASSET_TEXT).select(F.from_json(F.concat(F.lit('{"last":false,"content":'), "raw", F.lit("}")), schemas.ASSET_PAGE).alias("p")).select("p.*")
    return readers.assets_from_pages(pages, only_unassigned=True).select("asset_id", "type")


@query("asset_names_in_scope", """
select assetName as name from @asset where applicationId = 'env-3' and type = 'CONTAINER'""")
def _(v):
    return readers.asset_names(v.asset, "env-3", "CONTAINER")


def _component_pages(v, kept: str = "true"):
    text = ("select o_orderkey, '\"content\":[{\"id\":\"cmp-' || o_orderkey || '\",\"name\":\"svc-' || o_orderkey % 400 || '\",\"applicationId\":\"app-' || o_custkey || "
            "'\",\"tags\":[{\"id\":\"t\",\"key\":\"pteam\",\"value\":\"T' || o_custkey % 5 || '\"}]}],\"last\":false}' as body from @orders where " + kept)
    total = v.orders.agg(F.count(F.lit(1))).scalar()
    rows = v.sql(text).select(F.concat(F.lit('{"totalElements":'), total, F.lit(","), "body").alias("raw"))
    return readers.pages_from_text(rows, schemas.ACTUAL_COMPONENT)


@query("component_fetch_audit", """
select count(*) filter (where o_orderkey % 10 <> 0) as fetched, count(*) as declared, count(*) filter (where o_orderkey % 10 = 0) as missing,
  count(*) filter (where o_orderkey % 10 = 0) = 0 as complete from @orders""")
def _(v):
    return readers.fetch_audit(_component_pages(v, "o_orderkey % 10 <> 0"))


@query("component_snapshot", """
select 'cmp-' || o_orderkey as id, 'svc-' || o_orderkey % 400 as name, 'app-' || o_custkey as scope_id, 'T' || o_custkey % 5 as team from @orders""")
def _(v):
    rows = readers.page_rows(_component_pages(v))
    return rows.select("id", "name", F.col("applicationId").alias("scope_id"), tags.tag_value("tags", "pteam").alias("team"))


@query("scope_snapshot", """
select 'app-' || p_partkey as id, p_name as name, case when p_size > 25 then 'APPLICATION' else 'ENVIRONMENT' end as type from @part""")
def _(v):
    rows = v.sql("""select '{"content":[{"id":"app-' || p_partkey || '","name":"' || p_name || '","type":"' ||
      case when p_size > 25 then 'APPLICATION' else 'ENVIRONMENT' end || '"}],"totalElements":1}' as raw from @part""")
    return readers.page_rows(readers.pages_from_text(rows, schemas.ACTUAL_SCOPE)).select("id", "name", "type")


@query("components_in_scope", "select id, name from @actual_component where applicationId = 'env-3'")
def _(v):
    return readers.in_scope(v.actual_component, "env-3").select("id", "name")


_CRIT = "case when {t} between 1 and 10 then 11 - {t} else 5 end"


@query("declared_applications", """
with f as (select * from @part)
select 'file-' || p_partkey as file, 'App ' || p_partkey as app_name, 'owner.' || lower(replace(p_brand, '#', '')) || '@x.org' as owner,
  """ + _CRIT.format(t="(p_size % 13)") + """ as criticality, case when p_partkey % 3 = 0 then 'T1,T2' else '' end as teams, true as ticketing
from f where p_partkey % 7 <> 6
union all select 'file-' || p_partkey, 'Builds', 'x@y.z', 6, '', false from f""")
def _(v):
    apps = configs.declared_applications(configs.roots(v.config_file))
    return apps.select("file", "app_name", F.col("Responsable").alias("owner"), F.col("Criticality").alias("criticality"),
                       F.array_join("TeamNames", ",").alias("teams"), F.col("Ticketing").isNotNull().alias("ticketing"))


@query("declared_components", """
select 'file-' || p_partkey as file, 'App ' || p_partkey as app_name, 'a' as component, 's1' as status, case when p_partkey % 3 = 0 then 'T1,T2' else '' end as teams,
  case when p_partkey % 4 = 0 then null else 5 end as tier, 'h/g/' || replace(p_name, ' ', '-') as repositories, 'B' || p_size as backlog from @part where p_partkey % 7 <> 6
union all
select 'file-' || p_partkey, 'App ' || p_partkey, 'b', null, 'Own', 2, null, 'B' || p_size from @part where p_partkey % 7 <> 6""")
def _(v):
    rows = configs.declared_components(configs.declared_applications(configs.roots(v.config_file)))
    return rows.select("file", "app_name", "component", F.col("Status").alias("status"), F.array_join("TeamNames", ",").alias("teams"),
                       F.col("Tier").alias("tier"), F.array_join("RepositoryName", ",").alias("repositories"),
                       F.get("Ticketing", F.lit(0))["Backlog"].alias("backlog"))


@query("declared_environments", """
select 'file-' || p_partkey as file, 'Env ' || p_partkey % 50 as env_name, """ + _CRIT.format(t="(p_size % 12)") + """ as criticality, 'ops@x.org' as owner, 'ops' as team from @part""")
def _(v):
    e = configs.declared_environments(configs.roots(v.config_file))
    return e.select("file", "env_name", F.col("Criticality").alias("criticality"), F.col("Responsable").alias("owner"), F.col("TeamName").alias("team"))


@query("declared_services", """
select 'file-' || p_partkey as file, 'Env ' || p_partkey % 50 as env_name, 'api' as service, p_size % 4 as tier, 'ops' as team, null as deployment_set from @part where p_partkey % 5 <> 4
union all select 'file-' || p_partkey, 'Env ' || p_partkey % 50, 'db', 5, 'dba', p_type from @part where p_partkey % 5 <> 4""")
def _(v):
    s = configs.declared_services(configs.declared_environments(configs.roots(v.config_file)))
    return s.select("file", "env_name", "service", F.col("Tier").alias("tier"), F.col("TeamName").alias("team"), "deployment_set")


_REPOSITORIES = """
select 'file-' || p_partkey as file, p_type || '/r1' as repository, p_type as domain, p_brand as subdomain, 'bd-' || p_partkey as build, 5 as tier from @part
union all select 'file-' || p_partkey, 'r2', p_type, p_brand, 'bd-' || p_partkey, 5 from @part"""


def _repositories(v, only_group):
    r = configs.declared_repositories(configs.roots(v.config_file), only_group)
    return r.select("file", F.col("RepositoryName").alias("repository"), F.col("Domain").alias("domain"), F.col("Subdomain").alias("subdomain"),
                    F.col("BuildDefinitionName").alias("build"), F.col("Tier").alias("tier"))


@query("declared_repositories", _REPOSITORIES)
def _(v):
    return _repositories(v, 1)


# Only the second group of these files has build definitions.
@query("declared_repositories_all", _REPOSITORIES)
def _(v):
    return _repositories(v, None)


def _team_files(v):
    return v.sql("""select 'team-' || c_custkey || '.json' as file, c_custkey as file_pos, '{"TeamName":"T' || c_custkey % 300 || '","TeamMembers":[{"Name":"' || c_name ||
      '","EmailAddress":"c' || c_custkey || '@x.org","EmployeeType":"Employee"},{"Name":"Lead","EmailAddress":"l' || c_nationkey || '@x.org","EmployeeRole":"Manager"}]}' as raw from @customer""")


@query("teams_first_file", """
with f as (select c_custkey % 300 as t, min(c_custkey) as k from @customer group by 1)
select 'T' || t as team, 'team-' || k || '.json' as file, 'c' || k || '@x.org' as email, 'Employee' as kind from f
union all select 'T' || t, 'team-' || k || '.json', 'l' || c_nationkey || '@x.org', 'Manager' from f join @customer on c_custkey = k""")
def _(v):
    teams = configs.declared_teams(_team_files(v))
    m = teams.select(F.col("TeamName").alias("team"), "file", F.explode("TeamMembers").alias("x"))
    return m.select("team", "file", "x.email", F.coalesce("x.employee_role", "x.employee_type").alias("kind"))


@query("hive_rows", """
select c_custkey as file_pos, 'Squad ' || c_nationkey as team, case when c_custkey % 5 = 0 then 'Lead@Own.org' else 'ann.' || lower(c_mktsegment) || '@corp.org' end as lead,
  case c_custkey % 3 when 0 then '' when 1 then case when c_custkey % 5 = 0 then 'Po One' else 'po.one@corp.org' end
    else case when c_custkey % 5 = 0 then 'Po One,Po Two' else 'po.one@corp.org,po.two@corp.org' end end as products from @customer""")
def _(v):
    files = v.sql("""select c_custkey as file_pos, 'h' as file, '{"CustomEmail":' || case when c_custkey % 5 = 0 then 'true' else 'false' end ||
      ',"CompanyEmailDomain":"corp.org","Hives":[{"Name":"H","Teams":[{"Name":"Squad ' || c_nationkey || '","Lead":"' ||
      case when c_custkey % 5 = 0 then 'Lead@Own.org' else 'Ann ' || c_mktsegment end || '"' ||
      case c_custkey % 3 when 0 then '' when 1 then ',"Product":"Po One"' else ',"Product":"Po One and Po Two"' end || '}]}]}' as raw from @customer""")
    return configs.declared_hives(files).select("file_pos", "team", "lead", F.array_join("product", ",").alias("products"))


@query("cluster_images", """
with i as (
  select 'r' || p_size || '.x.org/t/' || replace(p_name, ' ', '-') || ':' || p_partkey as image, 'T' || p_partkey % 7 as team, 'repo-' || p_brand as repo from @part
  union select 'r' || p_size || '.x.org/side:1', 'T' || p_partkey % 7, 'repo-' || p_brand from @part
  union select 'r' || p_size || '.x.org/pod/' || p_type || ':2', null, case when p_partkey % 2 = 0 then 'chart-' || p_type else 'git' end from @part)
select distinct split_part(image, '/', 1) as registry, regexp_extract(split_part(image, ':', 1), '([^/]*)$', 1) as image_name, split_part(image, ':', 1) as container_url,
  team as team_label, repo, 'sub' as subscription_name, 'id-1' as subscription_id from i""")
def _(v):
    jobs = v.sql("""select '{"metadata":{"labels":{"team":"T' || p_partkey % 7 || '","git_repository":"repo-' || p_brand || '"}},"spec":{"jobTemplate":{"spec":{"template":{"spec":{"containers":[{"image":"r' ||
      p_size || '.x.org/t/' || replace(p_name, ' ', '-') || ':' || p_partkey || '"},{"image":"r' || p_size || '.x.org/side:1"}]}}}}}}' as raw from @part""")
    pods = v.sql("""select '{"metadata":{"labels":{' || case when p_partkey % 2 = 0 then '"chart":"chart-' || p_type || '"' else '"git_repository":"git","chart":"c"' end ||
      '}},"spec":{"containers":[{"image":"r' || p_size || '.x.org/pod/' || p_type || ':2"},{"image":"other/x:1"}]}}' as raw from @part""")
    read = lambda rows, schema: rows.select(F.from_json("raw", schema).alias("x")).select("x.*")
    return images.cluster_images(read(jobs, images.CRON_JOB), read(pods, images.POD), "sub", "id-1")


_EXPORT = """
with s as (select p_partkey as pos, 'Env ' || p_size as env, p_name as name, 'T' || p_partkey % 7 as team, p_partkey % 9 as n from @part),
r as (select *, row_number() over (partition by env, name order by pos desc) as rn from s)
select env as application, env as environment, 'auto-' || name as component, name as original_name, team, n as asset_count, 'CLOUD' as asset_type from r where rn = 1"""


def _export(v):
    s = v.part.select(F.col("p_partkey").alias("pos"), F.concat(F.lit("Env "), "p_size").alias("environment_name"), F.col("p_name").alias("component_name"),
                      F.concat(F.lit("T"), F.col("p_partkey") % 7).alias("team"), (F.col("p_partkey") % 9).alias("asset_count"), F.lit("CLOUD").alias("type"))
    return sinks.auto_component_rows(s)


@query("auto_component_export", _EXPORT)
def _(v):
    return _export(v)


@query("auto_component_files", _EXPORT)
def _(v):
    path = scratch_path(v.spark, "auto-components")
    sinks.write_auto_components(_export(v), path)
    return v.spark.read.parquet(path)


@query("config_union", """
select file, 'local' as source, 0 as source_no from @config_file where file_pos % 3 = 0 union all select file, 'remote', 1 from @config_file where file_pos % 3 <> 0""")
def _(v):
    part = lambda keep, name: v.config_file.filter(keep).select("file", F.lit(name).alias("source"), "raw")
    return configs.union_sources(part("file_pos % 3 = 0", "local"), part("file_pos % 3 <> 0", "remote")).select("file", "source", "source_no")


@query("all_access_accounts", """
select 'file-' || p_partkey as file, 'a' || p_size || '@x.org' as email from @part union all select 'file-' || p_partkey, 'boss@x.org' from @part""")
def _(v):
    return configs.all_access_accounts(configs.roots(v.config_file))


@query("create_users_flag", "select 'file-' || p_partkey as file, p_partkey % 3 = 0 as create_users from @part")
def _(v):
    return configs.creates_users(configs.roots(v.config_file))


@query("user_snapshot", "select 'u' || c_custkey || '@x.org' as email, c_name as name from @customer")
def _(v):
    rows = v.sql("""select '{"content":[{"email":"u' || c_custkey || '@x.org","name":"' || c_name || '"}],"last":true}' as raw from @customer""")
    return readers.page_rows(readers.pages_from_text(rows, schemas.USER)).select("email", "name")


@query("team_member_snapshot", "select 'team-' || c_nationkey as team_id, 'u' || c_custkey || '@x.org' as email from @customer")
def _(v):
    rows = v.sql("""select '{"content":[{"team_id":"team-' || c_nationkey || '","email":"u' || c_custkey || '@x.org"}]}' as raw from @customer""")
    return readers.page_rows(readers.pages_from_text(rows, schemas.TEAM_MEMBER)).select("team_id", "email")
