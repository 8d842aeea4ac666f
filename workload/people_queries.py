"""Queries over teams, users and memberships."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import people

from .registry import query

_ACCESS = """
aa as (select email from @declared_member where team in ('staffs', 'principals', 'directors') union all select email from @configured_access)
"""


def _access(v):
    return people.all_access(v.declared_member, v.configured_access)


@query("teams_to_create", """
with t as (select distinct trim(case when c_custkey % 4 = 0 then ' ' || n_name || ' ' when c_custkey % 4 = 1 then ' ' else c_mktsegment end) as team from @customer join @nation on c_nationkey = n_nationkey)
select team from t where team <> '' and team not in (select name from @actual_team)""")
def _(v):
    c = v.customer.join(v.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" "), "n_name", F.lit(" "))).when(F.col("c_custkey") % 4 == 1, " ").otherwise(F.col("c_mktsegment"))
    return people.teams_to_create(c.select(name.alias("TeamName")), v.actual_team)


@query("referenced_teams_absent", """
with r as (select TeamName as team from @declared_env union select TeamName from @declared_service union select unnest(TeamNames) from @declared_app union select unnest(TeamNames) from @declared_component)
select team from r where team is not null and team not in (select name from @actual_team)""")
def _(v):
    return people.referenced_but_absent(people.referenced_teams(v.declared_env, v.declared_service, v.declared_app, v.declared_component), v.actual_team)


@query("team_rules", """
select TeamName as team, a.id as team_id, 'pteam' as tag_key, TeamName as tag_value, case when a.id is null then 'new' else 'recreate' end as reason
from @declared_team d left join @actual_team a on a.name = d.TeamName where a.id is null or RecreateTeamAssociations""")
def _(v):
    return people.team_rules(v.declared_team, v.actual_team)


@query("all_access_users", "with " + _ACCESS + "select email from aa")
def _(v):
    return _access(v)


_USERS = _ACCESS + """,
n as (select email, 0 as source, pos, case when name like '% %' then split_part(name, ' ', 1) else split_part(email, '@', 1) end as f,
    case when name like '% %' then split_part(name, ' ', 2) else split_part(email, '@', 1) end as l,
    case coalesce(nullif(employee_role, ''), employee_type) when 'Security Champion' then 'SECURITY_CHAMPION' when 'Employee' then 'ENGINEERING_USER' else 'ORG_USER' end as role from @declared_member
  union all select email, 1, pos, null, null, 'ORG_USER' from (select lead as email, pos from @hive)
  union all select email, 2, pos, null, null, 'ORG_USER' from (select unnest(product) as email, pos from @hive)
  union all select email, 3, 0, null, null, 'ORG_USER' from aa),
m as (select email, source, pos, role, coalesce(f, case when email like '%@%' then split_part(split_part(email, '@', 1), '.', 1) end) as first_name,
    coalesce(l, case when email like '%@%' then case when split_part(email, '@', 1) like '%.%' then split_part(split_part(email, '@', 1), '.', 2) else split_part(email, '@', 1) end end) as last_name from n
  where lower(email) not in (select lower(email) from @actual_user))
"""


@query("users_to_create", "with " + _USERS + """,
r as (select *, row_number() over (partition by lower(email) order by source, pos) as rn from m where first_name <> '' and last_name <> '')
select email, source, first_name, last_name, role from r where rn = 1""")
def _(v):
    return people.missing_users(v.declared_member, v.hive, _access(v), v.actual_user)[0]


@query("users_rejected", "with " + _USERS + "select email, source, 'no first or last name' as error from m where first_name is null or last_name is null or first_name = '' or last_name = ''")
def _(v):
    return people.missing_users(v.declared_member, v.hive, _access(v), v.actual_user)[1]


@query("usable_members", """
with m as (select pos, case when pos % 6 = 1 then null when pos % 6 = 5 then 'nobody' else email end as email, name from @declared_member),
n as (select *, case when name like '% %' then split_part(name, ' ', 1) when email like '%@%' then split_part(email, '@', 1) end as f from m)
select pos, case when email is null then 'no address' when f is null then 'no first or last name' end as error from n""")
def _(v):
    m = v.declared_member.withColumn("email", F.when(F.col("pos") % 6 == 5, "nobody").when(F.col("pos") % 6 != 1, F.col("email")))
    good, bad = people.split_member_rows(m)
    return good.select("pos", F.lit(None).cast("string").alias("error")).unionByName(bad.select("pos", "error"))


@query("users_from_teams", """
with m as (select *, string_split(trim(name), ' ') as w from @declared_member where name like '% %')
select email, w[1] as first_name, array_to_string(w[2:], ' ') as last_name,
  case coalesce(nullif(employee_role, ''), employee_type) when 'Security Champion' then 'SECURITY_CHAMPION' when 'Employee' then 'ENGINEERING_USER' else 'ORG_USER' end as role
from m where email not in (select email from @actual_user)""")
def _(v):
    return people.users_from_teams(v.declared_member, v.actual_user)[0]


@query("users_from_teams_rejected", """
select email, name, case when coalesce(name, '') = '' then 'missing name' else 'needs first and last name' end as error from @declared_member where name is null or name not like '% %'""")
def _(v):
    return people.users_from_teams(v.declared_member, v.actual_user)[1]


@query("owners_to_create", """
with o as (select distinct lower(c_name) || '@x.org' as email from @customer union select distinct lower(Responsable) from @declared_app)
select email, split_part(split_part(email, '@', 1), '.', 1) as first_name, case when split_part(email, '@', 1) like '%.%' then split_part(split_part(email, '@', 1), '.', 2) else split_part(email, '@', 1) end as last_name
from o where email not in (select email from @actual_user)""")
def _(v):
    owners = v.customer.select(F.concat("c_name", F.lit("@X.org")).alias("email")).unionAll(v.declared_app.select("Responsable"))
    return people.owners_to_create(owners, v.actual_user)


_KEEP = _ACCESS + """,
wide as (select lower(lead) as e from @hive union select unnest(product) from @hive union select lower(email) from aa)
"""


@query("team_membership_changes", "with " + _KEEP + """,
live as (select name as team from @actual_team intersect select TeamName from @declared_team),
w as (select team, email, 'all_access' as reason from live cross join (select distinct email from aa) union all select distinct team, email, 'member' from @declared_member where team in (select team from live)),
h as (select name as team, lead, product from @actual_team join (select lower(team) as t, arg_min(lead, pos) as lead, arg_min(product, pos) as product from @hive group by 1) on t = lower(name))
select team, email, 'add' as action, reason from w where not exists (select 1 from @actual_member c where c.team = w.team and lower(c.email) = lower(w.email))
union all select team, email, 'remove', 'not_declared' from @actual_member c where team in (select team from live) and lower(email) not in (select e from wide)
  and not exists (select 1 from @declared_member m where m.team = c.team and lower(m.email) = lower(c.email))
union all select team, lead, 'add', 'hive_lead' from h
union all select team, unnest(product), 'add', 'hive_product' from h""")
def _(v):
    return people.membership_changes(v.actual_team, v.actual_member, v.declared_team, v.declared_member, v.hive, _access(v))


@query("team_access_gaps", "with " + _ACCESS + """,
live as (select name as team from @actual_team intersect select TeamName from @declared_team),
w as (select team, email, exists (select 1 from @actual_member c where c.team = live.team and lower(c.email) = lower(a.email)) as here
  from live cross join (select distinct email from aa where email is not null) a)
select team, count(*) as wanted, count(*) filter (where here) as present, count(*) filter (where not here) as missing from w group by team""")
def _(v):
    return people.access_gaps(v.actual_team, v.actual_member, v.declared_team, _access(v))[0]


@query("team_access_holders", "with " + _ACCESS + """
select distinct c.team, lower(c.email) as address from @actual_member c where lower(c.email) in (select lower(email) from aa)
  and c.team in (select name from @actual_team intersect select TeamName from @declared_team)""")
def _(v):
    return people.access_gaps(v.actual_team, v.actual_member, v.declared_team, _access(v))[1]


@query("members_kept", "with " + _KEEP + """
select pos, lower(email) in (select e from wide) or exists (select 1 from @declared_member m where m.team = c.team and lower(m.email) = lower(c.email)) as keep from @actual_member c""")
def _(v):
    return people.kept_members(v.actual_member, v.declared_member, v.hive, _access(v)).select("pos", "keep")


@query("members_kept_exact", "with " + _ACCESS + """,
c as (select pos, team, case when pos % 2 = 0 then lower(email) when pos = 1 then 'root@x.org' else email end as email from @actual_member),
wide as (select lead as e from @hive union select unnest(product) from @hive union select email from aa union select 'root@x.org')
select pos, email in (select e from wide) or exists (select 1 from @declared_member m where m.team = c.team and m.email = c.email) as keep from c""")
def _(v):
    current = v.actual_member.withColumn("email", F.when(F.col("pos") % 2 == 0, F.lower("email")).when(F.col("pos") == 1, "root@x.org").otherwise(F.col("email")))
    return people.kept_members(current, v.declared_member, v.hive, _access(v), fold=False, always=("root@x.org",)).select("pos", "keep")
