"""Queries over operation records and file summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import report

from .registry import query

_KIND = """
k as (select *, case when regexp_matches(lower(operation), 'skip|existing|already') then 'skip' when regexp_matches(lower(operation), 'update|modify|change') then 'update'
  when regexp_matches(lower(operation), 'create|add|new') then 'create' when not success then 'error' else 'create' end as t from @op_log)
"""
_COUNTERS = """count(*) as processed, count(*) filter (where success and t = 'create') as created, count(*) filter (where success and t = 'update') as updated,
  count(*) filter (where success and t = 'skip') as already_existing, count(*) filter (where not success) as errored, count(*) filter (where success) as successful,
  round(count(*) filter (where success) * 100.0 / count(*), 4) as success_rate"""


@query("category_statistics", "with " + _KIND + "select category, " + _COUNTERS + " from k group by category")
def _(v):
    return report.category_statistics(v.op_log).withColumn("success_rate", F.round("success_rate", 4))


@query("operation_report", "with " + _KIND + "select category, " + _COUNTERS + """,
  case when count(*) filter (where success) * 100.0 / count(*) >= 80 then 'good' when count(*) filter (where success) * 100.0 / count(*) >= 50 then 'fair' else 'poor' end as band from k group by rollup(category)""")
def _(v):
    return report.overall_statistics(v.op_log).withColumn("success_rate", F.round("success_rate", 4))


@query("operation_breakdown", """
with r as (select *, row_number() over (partition by category, operation, success order by pos) as rn from @op_log)
select category, operation, success, count(*) as records, string_agg(item, ',' order by pos) filter (where rn <= case when category in ('environments', 'applications', 'services', 'components', 'deployments') then 10 else 5 end) as items
from r group by 1, 2, 3""")
def _(v):
    return report.breakdown(v.op_log).withColumn("items", F.array_join("items", ","))


@query("errors_by_file", """
with r as (select *, row_number() over (partition by file order by pos) as rn, count(*) over (partition by file) as errors from @op_log where error is not null)
select file, operation, item, error, pos, cast(rn as integer) as rank, errors from r where rn <= 3""")
def _(v):
    return report.errors_by_file(v.op_log)


@query("operation_sample", """
select pos from (select pos, row_number() over (order by pos) as rn from @op_log) where rn % 10 = 0""")
def _(v):
    return report.systematic_sample(v.op_log, 10).select("pos")


@query("file_summary", """
select 'file-' || p_partkey as file, 2 as applications, case when p_partkey % 7 = 6 then 0 else 2 end as components, 1 as environments,
  case when p_partkey % 5 = 4 then 0 else 2 end as services, 2 as repositories, 1 as teams from @part""")
def _(v):
    from tallyline.sources.configs import APPLICATION_SECTIONS, ENVIRONMENT_SECTIONS, roots, section
    listed = lambda value, ddl: F.try_variant_get(value, "$", ddl)
    files = roots(v.config_file).select(
        "file", listed(section(*APPLICATION_SECTIONS), "array<struct<Components:array<variant>>>").alias("applications"),
        listed(section(*ENVIRONMENT_SECTIONS), "array<struct<Services:array<variant>>>").alias("environments"),
        listed(section("Repositories"), "array<variant>").alias("repositories"), listed(section("Teams"), "array<variant>").alias("teams"))
    return report.file_summary(files)


@query("file_summary_total", """
select 'all' as file, cast(2 * count(*) as bigint) as applications, cast(2 * count(*) filter (where p_partkey % 7 <> 6) as bigint) as components, count(*) as environments,
  cast(2 * count(*) filter (where p_partkey % 5 <> 4) as bigint) as services, cast(2 * count(*) as bigint) as repositories, count(*) as teams from @part""")
def _(v):
    from .registry import queries
    parts = queries()["file_summary"](v.spark, v.sf_dir).withColumn("file", F.lit("all"))
    return report.total_file_summary(parts)
