"""Inventory inputs derived from the given tables.

Each input is one SELECT written once and rendered for Spark and for the SQL the
results are checked against; ``@name`` refers to a given table or another input.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


class SparkDialect:
    def arr(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def tag(self, key: str, value: str) -> str:
        return f"named_struct('key', {key}, 'value', {value})"

    def stored_tag(self, tag_id: str, key: str, value: str) -> str:
        return f"named_struct('id', {tag_id}, 'key', {key}, 'value', {value})"

    def setting(self, t: str, m: str, old: str, backlog: str, channel: str) -> str:
        cast = lambda x: f"cast({x} as string)"
        return (f"named_struct('TIntegrationName', {cast(t)}, 'MIntegrationName', {cast(m)}, 'IntegrationName', {cast(old)}, "
                f"'Backlog', {cast(backlog)}, 'Channel', {cast(channel)})")

    text = "string"


class CheckDialect:
    def arr(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def tag(self, key: str, value: str) -> str:
        return f"{{'key': {key}, 'value': {value}}}"

    def stored_tag(self, tag_id: str, key: str, value: str) -> str:
        return f"{{'id': {tag_id}, 'key': {key}, 'value': {value}}}"

    def setting(self, t: str, m: str, old: str, backlog: str, channel: str) -> str:
        cast = lambda x: f"cast({x} as varchar)"
        return (f"{{'TIntegrationName': {cast(t)}, 'MIntegrationName': {cast(m)}, 'IntegrationName': {cast(old)}, "
                f"'Backlog': {cast(backlog)}, 'Channel': {cast(channel)}}}")

    text = "varchar"


def div(a: str, b: int) -> str:
    return f"cast(floor({a} / {b}) as bigint)"


def padded(expr: str) -> str:
    return f"lpad(cast({expr} as {{text}}), 9, '0')"


def _asset(d) -> str:
    nul = f"cast(null as {d.text})"
    empty = f"cast(null as {'array<struct<key:string,value:string>>' if d.text == 'string' else 'STRUCT(key VARCHAR, value VARCHAR)[]'})"
    app, team = d.tag("'Application'", "c_mktsegment"), d.tag("'Team'", "n_name")
    return f"""
select 'c' || c_custkey as asset_id, c_custkey * 8 as pos, 'INFRA' as type,
  case when c_custkey % 4 in (0, 1) then {empty}
       when c_custkey % 10 = 3 then {d.arr(app, team, d.tag("'Application'", "' Retail '"), d.tag("'scanner_name'", "'s1'"))}
       when c_custkey % 10 = 7 then {d.arr(app, d.tag("'blank'", "' '"), d.tag("' '", "'x'"))}
       else {d.arr(app, team)} end as tags,
  case when c_custkey % 2 = 0 then '10.' || {div('c_custkey', 16384)} % 256 || '.' || {div('c_custkey', 64)} % 256 || '.' || c_custkey % 256
       when c_custkey % 20 = 1 then '10.1.1.07' end as ip,
  {nul} as hostname, c_name as assetName, {nul} as repository, {nul} as imageName, {nul} as cloudProvider,
  {nul} as account, {nul} as region, case when c_custkey % 3 = 0 then 'env-' || c_nationkey end as applicationId
from @customer join @nation on c_nationkey = n_nationkey
union all
select 's' || s_suppkey, s_suppkey * 8 + 1, 'CLOUD', {empty}, {nul}, {nul}, s_name, {nul}, {nul}, r_name,
  case when s_suppkey % 10 <> 9 then n_name end, 'r' || s_nationkey, 'env-' || s_nationkey
from @supplier join @nation on s_nationkey = n_nationkey join @region on n_regionkey = r_regionkey
union all
select 'p' || p_partkey, p_partkey * 8 + 2, 'CONTAINER',
  case when p_size > 25 then {d.arr(d.tag("'Application'", "p_brand"), d.tag("'type'", "p_type"))} else {empty} end,
  {nul}, {nul}, 'img-' || p_partkey, {nul}, p_name, {nul}, {nul}, {nul}, 'env-' || p_partkey % 25
from @part
union all
select 'd' || doc_id, doc_id * 8 + 3, 'REPOSITORY', {empty}, {nul}, {nul}, 'doc-' || doc_id,
  case when n_chars % 5 <> 0 then source end, {nul}, {nul}, {nul}, {nul}, {nul}
from @documents
union all
select 'w' || page_id, page_id * 8 + 4, 'WEB', {empty}, {nul}, {nul}, url, {nul}, {nul}, {nul}, {nul}, {nul}, {nul}
from @pages"""


def _shipment_asset(d) -> str:
    return f"""
select l_orderkey || '-' || l_linenumber as asset_id, l_orderkey * 8 + l_linenumber as pos, 'BUILD' as type,
  {d.arr(d.tag("'returnflag'", "l_returnflag"), d.tag("'linestatus'", "l_linestatus"), d.tag("'supplier'", "'s' || l_suppkey"))} as tags
from @lineitem"""


def _actual_scope(d) -> str:
    pteam = lambda i, v: d.stored_tag(i, "'pteam'", v)
    return f"""
select 'env-' || n_nationkey as id, n_name as name, 'ENVIRONMENT' as type,
  {d.arr(pteam("'t' || n_nationkey", "'Team ' || n_nationkey % 7"))} as tags, cast(n_nationkey as bigint) as pos
from @nation where n_nationkey % 5 <> 4
union all
select 'app-' || p_partkey, case when p_partkey % 3 = 1 then 'App ' || p_partkey else upper('App ' || p_partkey) end, 'APPLICATION',
  {d.arr(pteam("'u' || p_partkey", "'Team ' || p_partkey % 7"), pteam("'v' || p_partkey", "'Team ' || p_partkey % 5"),
         d.stored_tag("'w' || p_partkey", "'domain'", "p_type"))}, p_partkey + 100
from @part where p_partkey % 3 <> 0
union all
select 'env-t', 'Thirdparty', 'ENVIRONMENT', {d.arr(pteam("'tt'", "'Thirdparty'"))}, 99"""


def _declared_app(d) -> str:
    nul = f"cast(null as {d.text})"
    empty = "array()" if d.text == "string" else "[]"
    arrtype = "array<string>" if d.text == "string" else "varchar[]"
    ticket = d.setting("case when p_partkey % 4 <> 1 then 'jira' end", "null", "case when p_partkey % 4 = 1 then 'old' end",
                       "case when p_partkey % 6 <> 5 then 'B' || p_partkey end", "null")
    message = d.setting("null", "'slack'", "null", "null", "case when p_partkey % 3 = 0 then 'c' || p_size end")
    return f"""
select p_partkey as app_no, 'App ' || p_partkey as app_name, 'f' || p_partkey % 20 as file, p_partkey as pos, p_size % 13 as Tier,
  'Owner.' || replace(p_brand, '#', '') || '@X.org' as Responsable,
  case when p_partkey % 3 = 0 then ' Retail, ,Bank ' when p_partkey % 3 = 1 then p_type end as BU,
  case when p_partkey % 2 = 0 then {d.arr("'Team ' || p_partkey % 7", "'Team ' || p_partkey % 3")}
       else cast({empty} as {arrtype}) end as TeamNames,
  case when p_partkey % 4 = 0 then {d.arr("'RiskFactor:a:b:' || p_size", "'plain'")} when p_partkey % 4 = 1 then {d.arr("' k : v:w '", "'x:'")} end as Tag_label,
  case when p_partkey % 5 = 0 then {d.arr("'loc:' || p_brand")} end as Tags_label,
  {d.arr(ticket)} as Ticketing, {d.arr(message)} as Messaging,
  case when p_partkey % 5 <> 0 then 'Set-' || p_partkey % 97 end as deployment_set, p_type as Status
from @part"""


def _declared_component(d) -> str:
    nul = f"cast(null as {d.text})"
    arrtype = "array<string>" if d.text == "string" else "varchar[]"
    nula = f"cast(null as {arrtype})"
    return f"""
select o_orderkey as component_id, 'App ' || o_custkey as app_name, 'app-' || o_custkey as target,
  case when o_orderkey % 5 = 0 then 'grp/svc-' || o_orderkey % 400 else 'svc-' || o_orderkey % 400 end as component,
  'f' || o_custkey % 20 as file, o_orderkey as pos,
  o_orderstatus as Status, case when o_orderkey % 2 = 0 then o_orderpriority else '' end as Type, cast(o_orderkey % 12 as int) as Tier,
  case when o_orderkey % 3 = 0 then {d.arr("'Team ' || o_custkey % 7", "''")} when o_orderkey % 3 = 1 then {d.arr("'Team ' || o_custkey % 5")} end as TeamNames,
  case when o_orderkey % 4 = 0 then 'retail' end as Domain, case when o_orderkey % 4 = 1 then '' else 'sub' end as SubDomain,
  case when o_orderkey % 6 = 0 then {d.arr("'RiskFactor:x:' || o_orderstatus")} end as Tag_label, {nula} as Tags_label,
  case when o_orderkey % 7 = 0 then 'Set-' || o_orderkey % 97 when o_orderkey % 7 = 1 then 'nowhere' end as deployment_set,
  case when o_orderkey % 3 = 0 then 'term ' || o_orderkey when o_orderkey % 3 = 1 then 'NULL' end as SearchName,
  case when o_orderkey % 4 = 0 then {d.arr("'ab'", "' abc '", "o_orderpriority")} end as Tags,
  case when o_orderkey % 5 = 0 then {d.arr("'git.x.org/grp/svc-' || o_orderkey % 400", "' '", "'null'", "'a'")} when o_orderkey % 5 = 1 then {d.arr("'a'")} end as RepositoryName,
  case when o_orderkey % 6 = 0 then '10.0.' || o_orderkey % 256 || '.0/24' end as Cidr,
  case when o_orderkey % 7 = 0 then {d.arr("'h' || o_custkey || '.x.org'")} end as Fqdn, {nula} as Netbios,
  case when o_orderkey % 8 = 0 then {d.arr("'linux'", "'bsd'")} end as OsNames,
  case when o_orderkey % 9 = 0 then {d.arr("'h1'", "'h2'", "'h' || o_orderkey")} end as Hostnames,
  case when o_orderkey % 10 = 0 then {d.arr("'acc-' || o_custkey")} end as ProviderAccountId, {nula} as ProviderAccountName, {nula} as ResourceGroup,
  case when o_orderkey % 11 = 0 then 'CONTAINER' end as AssetType
from @orders"""


def _actual_component(d) -> str:
    pteam = lambda i, v: d.stored_tag(i, "'pteam'", v)
    return f"""
select 'cmp-' || o_orderkey as id,
  case when o_orderkey % 2 = 0 then upper(case when o_orderkey % 5 = 0 then 'grp/svc-' else 'svc-' end || o_orderkey % 400)
       else case when o_orderkey % 5 = 0 then 'grp/svc-' else 'svc-' end || o_orderkey % 400 end as name,
  'app-' || o_custkey as applicationId,
  {d.arr(pteam("'a' || o_orderkey", "'Team ' || o_custkey % 7"), pteam("'b' || o_orderkey", "'Team ' || o_orderkey % 5"))} as tags, o_orderkey as pos
from @orders where o_orderkey % 3 <> 0
union all
select 'svc-' || s_suppkey, case when s_suppkey % 3 = 1 then s_name else upper(s_name) end, 'env-' || s_nationkey,
  {d.arr(pteam("'s' || s_suppkey", "'Team ' || s_suppkey % 7"))}, s_suppkey + 1000000000
from @supplier where s_suppkey % 3 <> 0"""


def _declared_service(d) -> str:
    ticket = d.setting("case when s_suppkey % 4 = 0 then 'jira' end", "null", "case when s_suppkey % 4 = 1 then 'old' end", "'B' || s_suppkey", "null")
    message = d.setting("null", "null", "case when s_suppkey % 3 = 1 then 'old' end", "null", "'c' || s_suppkey")
    return f"""
select s_suppkey as service_id, s_name as service, n_name as env_name, 'env-' || s_nationkey as target, 'f' || s_suppkey % 20 as file, s_suppkey as pos,
  case s_suppkey % 3 when 0 then 'Infra' when 1 then 'Cloud' else 'Api' end as Type, cast(1 + s_suppkey % 12 as int) as Tier,
  case when s_suppkey % 6 <> 5 then 'Team ' || s_suppkey % 9 end as TeamName,
  case when s_suppkey % 4 <> 3 then 'SET-' || s_suppkey % 97 end as deployment_set, 'set-' || s_suppkey * 7 % 97 as deployment_tag,
  case when s_suppkey % 5 = 0 then ' 10.0.' || s_suppkey % 256 || '.0/24, ,10.9.9.9 ' end as Cidr,
  case when s_suppkey % 4 = 0 then {d.arr("'env: prod'")} end as Tag,
  case when s_suppkey % 4 = 1 then {d.arr("'a:b:c'", "'plain'", "' k : v '")} end as Tag_rule,
  case when s_suppkey % 4 = 2 then {d.arr("'x:'", "':y'", "'r:' || r_name", "'null'")} end as Tags_rule,
  case when s_suppkey % 3 = 0 then {d.arr("'owner:' || n_name")} end as Tag_label,
  case when s_suppkey % 9 = 0 then {d.arr("'free'")} end as Tags_label,
  case when s_suppkey % 3 = 0 then s_name || ' x' else '' end as SearchName,
  case when s_suppkey % 3 = 1 then {d.arr("'a.x.org'", "'b' || s_suppkey || '.x.org'")} end as Fqdn,
  cast(null as {'array<string>' if d.text == 'string' else 'varchar[]'}) as Netbios,
  case when s_suppkey % 5 = 1 then {d.arr("'linux'")} end as OsNames, case when s_suppkey % 7 = 1 then {d.arr("'h1'", "'h2'")} end as Hostnames,
  case when s_suppkey % 2 = 0 then {d.arr("'acc-' || s_nationkey", "' '")} end as ProviderAccountId,
  case when s_suppkey % 8 = 0 then {d.arr("n_name")} end as ProviderAccountName,
  cast(null as {'array<string>' if d.text == 'string' else 'varchar[]'}) as ResourceGroup,
  case when s_suppkey % 4 = 0 then 'CLOUD' end as AssetType, {d.arr(ticket)} as Ticketing, {d.arr(message)} as Messaging
from @supplier join @nation on s_nationkey = n_nationkey join @region on n_regionkey = r_regionkey"""


def _declared_env(d) -> str:
    ticket = d.setting("case when n_nationkey % 2 = 0 then 'jira' end", "null", "null", "case when n_nationkey % 3 <> 2 then 'B' || n_nationkey end", "null")
    message = d.setting("null", "'slack'", "null", "null", "case when n_nationkey % 4 = 0 then 'ch' end")
    return f"""
select n_nationkey as env_no, n_name as Name, 'CLOUD' as Type, n_nationkey % 12 as Tier, 'Lead.' || r_name || '@X.org' as Responsable,
  case when n_nationkey % 4 = 1 then r_name || ',Shared' end as BU, 'active' as Status, case when n_nationkey % 3 <> 1 then 'Team ' || n_nationkey % 7 end as TeamName,
  case when n_nationkey % 2 = 0 then {d.arr("'zone:' || r_name")} end as Tag_label, case when n_nationkey % 5 = 0 then {d.arr("'free'")} end as Tags_label,
  {d.arr(ticket)} as Ticketing, {d.arr(message)} as Messaging, case when n_nationkey % 3 <> 0 then 'acct-' || n_nationkey else '' end as CloudAccounts,
  'f' || n_nationkey % 20 as file, cast(n_nationkey as bigint) as pos
from @nation join @region on n_regionkey = r_regionkey"""


INPUTS = {
    "asset": _asset,
    "shipment_asset": _shipment_asset,
    "fleet": lambda d: f"""
select 'f' || c_custkey as asset_id, c_custkey * 4 as pos, 'INFRA' as type, cast(null as {d.text}) as assetName,
  lower(replace(n_name, ' ', '.')) || '-' || lower(c_mktsegment) || '-' || lpad(cast(c_custkey % 9973 as {d.text}), 4, '0') as hostname
from @customer join @nation on c_nationkey = n_nationkey""",
    "actual_scope": _actual_scope,
    "declared_app": _declared_app,
    "declared_component": _declared_component,
    "actual_component": _actual_component,
    "declared_service": _declared_service,
    "declared_env": _declared_env,
    "declared_repo": lambda d: """
select 'git.x.org/grp/svc-' || p_partkey % 400 as RepositoryName, p_type as Domain, p_size % 11 as Tier, p_brand as Subdomain,
  'Team ' || p_partkey % 7 as Team, 'build-' || p_partkey as BuildDefinitionName, p_partkey as pos from @part""",
    "repo_override": lambda d: """
select 'git.x.org/grp/svc-' || p_partkey as "Key", 'override-' || p_size as "Value", p_partkey as pos from @part where p_partkey % 10 = 0""".replace('"', "`" if d.text == "string" else '"'),
    "declared_member": lambda d: """
select case when n_nationkey = 7 then 'directors' else n_name end as team, lower(c_name) || '@x.org' as email,
  case c_custkey % 5 when 0 then 'Ann ' || c_mktsegment when 1 then 'Bob' when 2 then 'Cy van ' || c_mktsegment when 3 then '' end as name,
  case when c_custkey % 4 = 0 then 'Security Champion' when c_custkey % 4 = 1 then '' end as employee_role,
  case when c_custkey % 3 = 1 then 'Contractor' else 'Employee' end as employee_type, c_custkey as pos
from @customer join @nation on c_nationkey = n_nationkey where c_custkey % 3 <> 0""",
    "actual_member": lambda d: """
select case when n_nationkey = 7 then 'directors' else n_name end as team, upper(c_name) || '@x.org' as email, c_custkey as pos
from @customer join @nation on c_nationkey = n_nationkey where c_custkey % 5 <> 0""",
    "actual_team": lambda d: """
select 'team-' || n_nationkey as id, n_name as name from @nation where n_nationkey % 6 <> 5""",
    "declared_team": lambda d: """
select case when n_nationkey = 7 then 'directors' else n_name end as TeamName, n_nationkey % 2 = 0 as RecreateTeamAssociations from @nation""",
    "actual_user": lambda d: """
select upper(c_name) || '@x.org' as email from @customer where c_custkey % 2 = 0
union all select lower(c_name) || '@x.org' from @customer where c_custkey % 7 = 0""",
    "hive": lambda d: f"""
select lower(n_name) as team, 'customer#' || lpad(cast(n_nationkey * 6 + 3 as {d.text}), 9, '0') || '@x.org' as lead,
  {d.arr(f"'customer#' || lpad(cast(n_nationkey * 6 + 9 as {d.text}), 9, '0') || '@x.org'", "'po.' || n_nationkey || '@x.org'")} as product, cast(n_nationkey as bigint) as pos
from @nation where n_nationkey % 2 = 0""",
    "configured_access": lambda d: """
select 'Admin.' || r_regionkey || '@x.org' as email, cast(r_regionkey as bigint) as pos from @region
union all select 'noname', 10 from @region where r_regionkey = 0""",
    "op_log": lambda d: """
select event_id as pos, case when event_id % 17 <> 0 then 'f' || user_id % 10 end as file,
  case when event_id % 13 = 0 then null when event_type = 'click' then 'services' else event_type end as category,
  case event_id % 7 when 0 then 'verify_item' when 1 then 'create_item' when 2 then 'update_item' when 3 then 'Skip_item'
    when 4 then 'add_rule' when 5 then 'modify_existing' else 'update_item' end as operation,
  'user-' || user_id as item, event_id % 11 <> 0 as success, case when event_id % 11 = 0 then 'E' || event_id % 5 end as error
from @events""",
    "config_text": lambda d: """
select p_partkey as doc_id, 'DeploymentGroups:\n- AppName: ' || p_name || '\n  Status: a\n  # Status: comment\n  Tier: ' || p_size ||
  case when p_size % 5 = 0 then '\n  Status: b' else '' end || '\n  Components:\n    - ComponentName: x\n      Type: ' || p_type ||
  case when p_size % 7 = 0 then '\n      Type: again' else '' end || '\n    - ComponentName: y\n      Type: z\n- AppName: second\n  Status: c\n' ||
  case when p_size % 3 = 0 then 'DeploymentGroups:\n' else '' end as text
from @part
union all
select doc_id + 1000000000, text from @documents""",
    "component_item": lambda d: """
select o_orderkey as item_id, o_orderkey % 12 as defect, '{' ||
  case when o_orderkey % 12 = 5 then '' else '"ComponentName":"svc-' || o_orderkey || '",' end ||
  case o_orderkey % 12 when 0 then '"Hostnames":"h1",' when 1 then '"Fqdn":null,' when 2 then '"Foo":1,' when 3 then '"AssetType":"WRONG",'
    when 4 then '"Tier":"high",' when 6 then '"RepositoryName":"r/x","AssetType":"BUILD",' when 7 then '"Ticketing":[{"TIntegrationName":"j"}],'
    when 8 then '"MultiConditionRule":{"SearchName":"s","Tags":"t"},' when 9 then '"RepositoryName":["a/b","c/d"],'
    when 10 then '"TeamNames":["t",1],' else '' end ||
  '"Status":"' || o_orderstatus || '","MULTI_MultiConditionRules":[{"SearchName":"' || o_custkey || '"}]}' as raw
from @orders""",
    "config_file": lambda d: """
select 'file-' || p_partkey as file, p_partkey as file_pos, '{"' || case when p_partkey % 2 = 0 then 'DeploymentGroups' else 'Deployment Groups' end ||
  '":[{"AppName":"App ' || p_partkey || '","ReleaseDefinitions":[],"Responsable":"Owner.' || replace(p_brand, '#', '') || '@X.org","Tier":' || p_size % 13 ||
  case when p_partkey % 3 = 0 then ',"TeamNames":["T1","T2"]' else '' end || ',"Ticketing":[{"TIntegrationName":"jira","Backlog":"B' || p_size || '"}]' ||
  case when p_partkey % 7 = 6 then '' else ',"Components":[{"ComponentName":"a","Status":"s1"' || case when p_partkey % 4 = 0 then ',"Tier":null' else '' end ||
    ',"RepositoryName":"h/g/' || replace(p_name, ' ', '-') || '"},{"ComponentName":"b","TeamNames":["Own"],"Tier":2,"Ticketing":[{"Backlog":"x"}],' ||
    '"MultiConditionRule":{"AccountId":["acc-' || p_size || '"],"Tag_rule":"k:v"},"MULTI_MultiConditionRules":[{"SearchName":"s"},{"Bad":1}]}]' end || '},' ||
  '{"AppName":"Builds","ReleaseDefinitions":[],"Responsable":"x@y.z","Components":[],"BuildDefinitions":[{"RepositoryName":["git/' || p_type || '/r1","r2"],"Domain":"' || p_type ||
  '","SubDomain":"' || p_brand || '","TeamName":"T","BuildDefinitionName":"bd-' || p_partkey || '"}]}],' ||
  '"Environment Groups":[{"Name":"Env ' || p_partkey % 50 || '","Type":"CLOUD","Tier":' || p_size % 12 || ',"Status":"up","' ||
  case when p_partkey % 2 = 0 then 'Responsable' else 'Responsible' end || '":"Ops@X.org","TeamName":"ops"' ||
  case when p_partkey % 5 = 4 then '' else ',"Services":[{"Service":"api","Type":"Cloud","Tier":' || p_size % 4 || '},{"Service":"db","Type":"Infra","TeamName":"dba","Deployment_set":"' || p_type || '"}]' end ||
  '}],"AllAccessAccounts":["a' || p_size || '@x.org","boss@x.org"],"CreateUsersForApplications":' || case p_partkey % 3 when 0 then 'true' when 1 then '"True"' else 'false' end ||
  ',"Teams":[{"TeamName":"one"}],"Repositories":[{"Name":"r1"},{"Name":"r2"}]}' as raw
from @part""",
}


def _refs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"@(\w+)", re.sub(r"'[^']*'", "''", sql))))


def _bind(sql: str, form) -> str:
    """Replace ``@name`` outside quoted text."""
    parts = re.split(r"('[^']*')", sql)
    return "".join(p if p.startswith("'") else re.sub(r"@(\w+)", form, p) for p in parts)


class Inputs:
    """Tables and derived inputs as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in INPUTS):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = (self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet") if name in TABLES
                                else self._derive(name))
        return self._made[name]

    def _derive(self, name: str) -> DataFrame:
        sql = INPUTS[name](SparkDialect())
        return self.sql(sql)

    def sql(self, sql: str) -> DataFrame:
        """Spark SQL over ``@name`` references."""
        if "{" in re.sub(r"'[^']*'", "", sql):
            raise ValueError("braces outside text")
        # Text may hold braces and line breaks; they go in as arguments.
        texts: list[str] = []

        def keep(m: re.Match) -> str:
            if not re.search(r"[{}\n\\]", m.group(0)):
                return m.group(0)
            texts.append(m.group(0)[1:-1])
            return f":t{len(texts) - 1}"

        bound = _bind(sql, r"{\1}")
        bound = re.sub(r"'[^']*'", keep, bound)
        return self.spark.sql(bound, args={f"t{i}": t for i, t in enumerate(texts)} or None,
                              **{n: getattr(self, n) for n in _refs(sql)})


def check_sql(body: str) -> str:
    """A check query with the inputs it refers to placed in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for ref in _refs(INPUTS[name](CheckDialect())):
            visit(ref)
        order.append(name)

    for ref in _refs(body):
        visit(ref)
    ctes = [f"{n} as ({_bind(INPUTS[n](CheckDialect()), lambda m: m.group(1))})" for n in order]
    body = _bind(body, lambda m: m.group(1)).strip()
    if not ctes:
        return body
    head = ",\n".join(ctes)
    if body.lower().startswith("with recursive"):
        return f"with recursive {head},\n{body[len('with recursive'):]}"
    if body.lower().startswith("with "):
        return f"with {head},\n{body[len('with'):]}"
    return f"with {head}\n{body}"
