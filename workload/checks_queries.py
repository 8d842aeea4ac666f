"""Queries over the checks of declared items and raw configuration text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import quality, report
from tallyline.plans import check
from tallyline.sources import configs

from .registry import query


@query("component_checks", """
select item_id, case when defect in (0, 1, 8, 10) and defect <> 10 then 'list_fields' when defect in (2, 3, 4, 5, 7, 10) then 'schema' when defect in (6, 9) then 'structure' else 'valid' end as stage,
  case defect when 0 then 'Hostnames: must be a list, not text' when 1 then 'Fqdn: is null, must be a list or left out' when 2 then 'Foo: unknown field' when 3 then 'AssetType: unallowed value'
    when 4 then 'Tier: must be integer' when 5 then 'ComponentName: required field' when 6 then 'RepositoryName: repository and asset type beside rules' when 7 then 'Ticketing.Backlog: required field'
    when 8 then 'MultiConditionRule.Tags: must be a list, not text' when 9 then 'RepositoryName: several repositories without asset type' when 10 then 'TeamNames: list items must be text' else '' end as errors
from @component_item""")
def _(v):
    c = quality.validate(v.component_item, "component")
    text = F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["error"])), "; ")
    return c.select("item_id", "stage", text.alias("errors"))


@query("list_field_errors", """
select item_id, case defect when 0 then 'Hostnames' when 1 then 'Fqdn' else 'MultiConditionRule.Tags' end as field from @component_item where defect in (0, 1, 8)""")
def _(v):
    e = v.component_item.withColumn("m", quality.item_map("raw")).select("item_id", F.explode(quality.list_field_errors(F.col("m"))).alias("e"))
    return e.select("item_id", "e.field")


@query("repository_structure_errors", """
select item_id, case when defect = 6 then 'repository and asset type beside rules' else 'several repositories without asset type' end as error from @component_item where defect in (6, 9)""")
def _(v):
    e = v.component_item.withColumn("m", quality.item_map("raw")).select("item_id", F.explode(quality.repository_structure_errors(F.col("m"))).alias("e"))
    return e.select("item_id", "e.error")


_ITEM = """select p_partkey as item_id, p_partkey % 6 as defect, '{' || {body} || '}' as raw from @part"""


@query("application_checks", """
select p_partkey as item_id, p_partkey % 6 in (0, 5) as valid, case p_partkey % 6 when 1 then 'AppName' when 2 then 'ReleaseDefinitions' when 3 then 'Criticality' when 4 then 'Tag_label' else '' end as fields from @part""")
def _(v):
    rows = v.sql("""select p_partkey as item_id, '{"Responsable":"a@b.c","Tier":' || p_size || case p_partkey % 6 when 1 then '' else ',"AppName":"A"' end || case p_partkey % 6 when 2 then '' else ',"ReleaseDefinitions":[]' end ||
      case p_partkey % 6 when 3 then ',"Criticality":5' when 4 then ',"Tag_label":"x"' when 5 then ',"BU":["a"],"Ticketing":[{"TIntegrationName":"j","Backlog":"b"}]' else '' end || '}' as raw from @part""")
    c = quality.validate(rows, "application")
    return c.select("item_id", "valid", F.array_join(F.transform("errors", lambda e: e["field"]), ",").alias("fields"))


@query("environment_checks", """
select p_partkey as item_id, case p_partkey % 6 when 1 then 'owner' when 2 then 'schema' when 3 then 'list_fields' when 4 then 'owner' else 'valid' end as stage from @part""")
def _(v):
    rows = v.sql("""select p_partkey as item_id, '{"Name":"E","Type":"CLOUD","Status":"up","Tier":' || case p_partkey % 6 when 2 then '"one"' else '1' end ||
      case p_partkey % 6 when 0 then ',"Responsable":"a@b.c"' when 1 then '' when 4 then ',"Responsible":""' else ',"Responsible":"a@b.c"' end || case p_partkey % 6 when 3 then ',"Tags_label":"x"' else '' end || '}' as raw from @part""")
    return quality.validate(rows, "environment").select("item_id", "stage")


@query("service_checks", """
select p_partkey as item_id, case p_partkey % 6 when 0 then 'valid' when 1 then 'Type: required field' when 2 then 'Deployment_tag: must be string' when 3 then 'MultiConditionRules.Oops: unknown field'
  when 4 then 'RepositoryName: repository and asset type need a rule' else 'RepositoryName: several repositories with asset type need one rule each' end as error from @part""")
def _(v):
    rows = v.sql("""select p_partkey as item_id, '{"Service":"s' || p_size || '"' || case p_partkey % 6 when 1 then '' else ',"Type":"Cloud"' end || case p_partkey % 6 when 2 then ',"Deployment_tag":7' when 3 then ',"MultiConditionRules":[{"Oops":1},{"Tag":"a:b"}]'
      when 4 then ',"RepositoryName":["r"],"AssetType":"BUILD"' when 5 then ',"RepositoryName":["r","q"],"AssetType":"BUILD"' else ',"Tag":["a:b"]' end || '}' as raw from @part""")
    c = quality.validate(rows, "service")
    first = F.get("errors", F.lit(0))
    return c.select("item_id", F.coalesce(F.concat(first["field"], F.lit(": "), first["error"]), F.lit("valid")).alias("error"))


@query("rule_checks", """
select component_id as item_id, case when component_id % 4 = 1 then 'AssetType: unallowed value' when component_id % 4 = 2 then 'Cidr: must be string' else '' end as errors from @declared_component""")
def _(v):
    rows = v.sql("""select o_orderkey as item_id, '{"SearchName":"' || o_orderstatus || '"' || case o_orderkey % 4 when 1 then ',"AssetType":"' || o_orderpriority || '"' when 2 then ',"Cidr":["1.0.0.0/8"]' else ',"Tag":"a"' end || '}' as raw from @orders""")
    c = quality.validate(rows, "rule")
    return c.select("item_id", F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["error"])), "; ").alias("errors"))


@query("loaded_rules", """
select 'file-' || p_partkey as file, 'App ' || p_partkey as app_name, 0 as rule_no, 's' as search, null as accounts, null as tag_rule, null as tag_rule_text from @part where p_partkey % 7 <> 6
union all select 'file-' || p_partkey, 'App ' || p_partkey, 1, null, 'acc-' || p_size, 'k:v', true from @part where p_partkey % 7 <> 6""")
def _(v):
    c = configs.declared_components(configs.declared_applications(configs.roots(v.config_file)))
    r = c.select("file", "app_name", F.posexplode("rules").alias("rule_no", "r"))
    return r.select("file", "app_name", "rule_no", F.col("r.SearchName").alias("search"), F.array_join("r.ProviderAccountId", ",").alias("accounts"),
                    F.array_join("r.Tag_rule", ",").alias("tag_rule"), "r.Tag_rule_text").withColumnRenamed("Tag_rule_text", "tag_rule_text")


_REPEATED = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as line from @config_text where text like '%:%'),
m as (select doc_id, line, x, ltrim(x) as b, length(x) - length(ltrim(x)) as indent from l where ltrim(x) <> '' and ltrim(x) not like '#%'),
i as (select doc_id, line, indent from m where b like '- %'),
k as (select doc_id, line, indent, trim(split_part(b, ':', 1)) as key from m where b not like '- %' and b like '%:%' and b not like ':%'),
p as (select k.doc_id, k.line, k.indent, k.key, coalesce(max(i.line), 0) as parent from k left join i on i.doc_id = k.doc_id and i.line < k.line and i.indent < k.indent group by all),
r as (select *, min(line) over (partition by doc_id, indent, parent, key) as first_line from p)
"""


@query("repeated_keys", _REPEATED + """
select doc_id, cast(line as bigint) as line, cast(first_line as bigint) as first_line, key, cast(indent as bigint) as indent from r where line > first_line""")
def _(v):
    return quality.repeated_keys(v.config_text)


@query("repeated_key_advice", _REPEATED + """
select doc_id, key, case when indent = 0 and key in ('DeploymentGroups', 'Deployment Groups') then 'merge applications into the first section'
  when indent = 0 and key in ('Environment Groups', 'EnvironmentGroups') then 'merge environments into the first section'
  when indent = 0 then 'keep the first or merge the contents' else 'remove or rename' end as advice from r where line > first_line""")
def _(v):
    return quality.repeated_keys(v.config_text).select("doc_id", "key", quality.repeat_advice().alias("advice"))


@query("repeated_application_names", """
with a as (select 'f' || p_partkey % 20 as file, p_name as name, p_partkey as pos from @part)
select file, name, pos from (select *, row_number() over (partition by file, name order by pos) as rn from a) where rn > 1""")
def _(v):
    a = v.part.select(F.concat(F.lit("f"), F.col("p_partkey") % 20).alias("file"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    return quality.repeated_names(a, ["file", "name"]).select("file", "name", "pos")


@query("duplicated_components", "select app_name, component, count(*) as copies from @declared_component where component <> '' group by 1, 2 having count(*) > 1")
def _(v):
    return quality.duplicated_children(v.declared_component, "app_name", "component")


@query("section_findings", """
with s as (select p_partkey, 'file-' || p_partkey as file, p_partkey % 6 as k from @part)
select file, 'error' as severity, 'missing DeploymentGroups' as finding, null as subject from s where k in (0, 1)
union all select file, 'error', 'DeploymentGroups is not a list', null from s where k = 2
union all select file, 'warning', 'missing Environment Groups', null from s where k in (1, 3)
union all select file, 'warning', 'no Components key', 'App ' || p_partkey from s where k >= 3
union all select file, 'warning', 'empty Components', 'Application#2' from s where k >= 3
union all select file, 'error', 'Application is not a mapping', 'Application#3' from s where k >= 3
union all select file, 'warning', 'empty Services', 'E1' from s where k not in (1, 3)""")
def _(v):
    files = v.sql("""select 'file-' || p_partkey as file, '{"x":1' || case when p_partkey % 6 = 0 then ',"DeploymentGroups":[]' when p_partkey % 6 = 1 then '' when p_partkey % 6 = 2 then ',"Deployment Groups":{"a":1}'
      else ',"DeploymentGroups":[{"AppName":"App ' || p_partkey || '"},{"Components":[]},7]' end || case when p_partkey % 6 in (1, 3) then '' else ',"EnvironmentGroups":[{"Name":"E1","Services":[]},{"Name":"E2"}]' end || '}' as raw from @part""")
    return quality.section_findings(files)


_CHECKED = """
i as (select p_partkey, 'application' as kind, 'App' as name, p_partkey % 7 <> 99 as valid from @part
  union all select p_partkey, 'application', 'Builds', false from @part
  union all select p_partkey, 'component', 'a', p_partkey % 4 <> 0 from @part where p_partkey % 7 <> 6
  union all select p_partkey, 'component', 'b', false from @part where p_partkey % 7 <> 6
  union all select p_partkey, 'environment', 'Env', true from @part
  union all select p_partkey, 'service', 'api', true from @part where p_partkey % 5 <> 4
  union all select p_partkey, 'service', 'db', true from @part where p_partkey % 5 <> 4)
"""


@query("validity_counts", "with " + _CHECKED + "select kind, count(*) as total, count(*) filter (where valid) as valid, count(*) filter (where not valid) as invalid from i group by 1")
def _(v):
    return report.validity_counts(check.checked_items(v.config_file))


@query("validity_rates", "with " + _CHECKED + """
select kind, count(*) as total, count(*) filter (where valid) as valid, round(count(*) filter (where valid) * 100.0 / count(*), 4) as rate,
  case when count(*) = count(*) filter (where valid) then 'all' when count(*) filter (where valid) * 100.0 / count(*) >= 80 then 'most' else 'low' end as band from i group by rollup(kind)""")
def _(v):
    r = report.validity_rates(check.checked_items(v.config_file))
    return r.select("kind", "total", "valid", F.round("rate", 4).alias("rate"), "band")
