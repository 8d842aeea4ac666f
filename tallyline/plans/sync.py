"""The declared-against-actual job: every step is a function of both and returns an action table.

Ids of things still to be created are unknown, so later steps join on names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.actions import (create_applications, create_components, create_environments, patch_applications, patch_components,
                                 patch_environments)
from ..operators.deployments import (absent_components, auto_links, component_link_groups, component_links, deployment_links,
                                     existing_applications, known_services, link_groups, mismatch_counts, missing_service_errors)
from ..operators.placement import place, service_sync, upsert
from ..operators.people import (access_gaps, membership_changes, missing_users, referenced_but_absent, referenced_teams, team_rules,
                                teams_to_create)
from ..operators.rules import component_rules, service_rules
from ..operators.team_tags import expected_teams, stale_tags, stale_team_tags, team_tag_changes


def environment_actions(environments: DataFrame, scopes: DataFrame) -> dict[str, DataFrame]:
    """Needs the columns of ``create_environments``."""
    split = upsert(environments, "Name", scopes, "ENVIRONMENT")
    return {"create": create_environments(split.filter(F.col("action") == "create")),
            "update": patch_environments(split.filter(F.col("action") == "update"))}


def application_actions(applications: DataFrame, scopes: DataFrame) -> dict[str, DataFrame]:
    split = upsert(applications, "AppName", scopes, "APPLICATION")
    return {"create": create_applications(split.filter(F.col("action") == "create")),
            "update": patch_applications(split.filter(F.col("action") == "update"))}


def component_actions(components: DataFrame, scopes: DataFrame, actual: DataFrame) -> DataFrame:
    """Components (name, app_name) of existing applications with their placement."""
    scoped = upsert(components, "app_name", scopes, "APPLICATION").filter(F.col("scope_id").isNotNull())
    return place(scoped.drop("action").withColumnRenamed("scope_id", "target"), actual)


def service_actions(services: DataFrame, scopes: DataFrame, actual: DataFrame) -> DataFrame:
    return service_sync(services, scopes, actual)


def deployment_actions(applications: DataFrame, components: DataFrame, services: DataFrame, scopes: DataFrame,
                       actual: DataFrame) -> dict[str, DataFrame]:
    """Links of applications and components, one row each and as members and selectors of deployment sets, errors and
    mismatch counts.  Needs app_name, deployment_set and (components) component_id, component; services as in ``known_services``."""
    known = known_services(services, scopes, actual)
    usable = known.filter("usable")
    apps = existing_applications(applications, scopes)
    named = lambda side, tables: dict(zip((f"{side}_sets", f"{side}_members", f"{side}_selectors"), tables))
    return {"application_links": deployment_links(apps, usable), "component_links": component_links(components, usable, scopes, actual),
            **named("application", link_groups(apps, usable)), **named("component", component_link_groups(components, usable, scopes, actual)),
            "component_errors": absent_components(components, scopes, actual),
            "auto_links": auto_links(apps, services), "errors": missing_service_errors(apps, known),
            "mismatches": mismatch_counts(apps, usable)}


def derived_teams(environments: DataFrame, services: DataFrame, applications: DataFrame, components: DataFrame,
                  actual_teams: DataFrame) -> DataFrame:
    return referenced_but_absent(referenced_teams(environments, services, applications, components), actual_teams)


def people_actions(teams: DataFrame, members: DataFrame, hives: DataFrame, access: DataFrame, actual_teams: DataFrame,
                   current: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """Teams, their association rules, users and memberships; inputs as in ``operators.people``."""
    new_users, rejected = missing_users(members, hives, access, users)
    return {"teams": teams_to_create(teams, actual_teams), "team_rules": team_rules(teams, actual_teams),
            "users": new_users, "rejected_users": rejected,
            "memberships": membership_changes(actual_teams, current, teams, members, hives, access),
            **dict(zip(("access_gaps", "access_holders", "access_wanted"), access_gaps(actual_teams, current, teams, access)))}


def tag_actions(applications: DataFrame, scopes: DataFrame, components: DataFrame, repositories: DataFrame,
                overrides: DataFrame) -> dict[str, DataFrame]:
    """Team tags of applications to add and remove, and stale team tags of stored ``components``."""
    stored = scopes.filter(F.col("type") == "APPLICATION").withColumnRenamed("name", "app_name")
    expected = expected_teams(repositories, overrides)
    return {"application_teams": team_tag_changes(applications, stored, ["app_name"]),
            "stale_component_teams": stale_team_tags(components, repositories, overrides),
            "stale_component_tags": stale_tags(components, expected), "expected_teams": expected}


def rule_actions(components: DataFrame, services: DataFrame) -> dict[str, DataFrame]:
    """Single-filter rules of components and rules of services."""
    return {"component_rules": component_rules(components), "service_rules": service_rules(services)}


def component_writes(components: DataFrame, scopes: DataFrame, actual: DataFrame) -> dict[str, DataFrame]:
    """Rows to create and to patch, from declared components (name, component, app_name and the columns of the two)."""
    placed = component_actions(components, scopes, actual)
    return {"create": create_components(placed.filter(~F.col("entity_exists"))), "update": patch_components(placed.filter("entity_exists"))}
