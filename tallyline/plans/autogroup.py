"""The grouping job end to end: profile, choose tags, group, plan, structure."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..operators.grouping import GroupingOptions, all_groups, grouping_plan
from ..operators.profile import choose_tags, recommend_tags, tag_profile
from ..operators.structure import (StructureDefaults, application_rows, component_rows, environment_rows, service_rows,
                                   structure_teams)


@dataclass(frozen=True)
class AutogroupResult:
    primary_tag: str | None
    secondary_tag: str | None
    plan: DataFrame
    applications: DataFrame
    components: DataFrame
    environments: DataFrame
    services: DataFrame
    teams: DataFrame


def autogroup(assets: DataFrame, options: GroupingOptions = GroupingOptions(),
              defaults: StructureDefaults = StructureDefaults(), primary: tuple[str, ...] = (),
              secondary: tuple[str, ...] = (), min_count: int = 10, strategy: str = "application_first") -> AutogroupResult:
    """Only the choice of at most two tag keys comes to the driver; everything else stays lazy."""
    recommended = recommend_tags(tag_profile(assets), primary, secondary, min_count)
    first, second = choose_tags(recommended, strategy)
    options = replace(options, primary_tag=first, secondary_tag=second)
    plan = grouping_plan(all_groups(assets, options), options)
    components = component_rows(plan, defaults, first)
    services = service_rows(plan, defaults, first)
    return AutogroupResult(first, second, plan, application_rows(components, defaults), components,
                           environment_rows(services, defaults), services, structure_teams(components, services))
