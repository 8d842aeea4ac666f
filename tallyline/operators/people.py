"""Teams, users and memberships: what to create, add and remove."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.people import address_to_names, full_names, member_names, platform_role
from ..functions.text import blank_to_null, strip
from .common import first_by_pos, missing_from, paired

# Teams whose members have access everywhere.
ALL_ACCESS_TEAMS = ["staffs", "principals", "directors"]


def teams_to_create(teams: DataFrame, actual_teams: DataFrame) -> DataFrame:
    """Declared teams (stripped, non-empty) that do not exist by exact name."""
    named = teams.select(strip("TeamName").alias("team")).filter(F.col("team") != "").distinct()
    return missing_from(named, actual_teams, [(F.col("team"), F.col("name"))])


def referenced_teams(environments: DataFrame, services: DataFrame, applications: DataFrame,
                     components: DataFrame) -> DataFrame:
    """Distinct teams named by any declared row (single names on the left, lists on the right)."""
    singles = environments.select(F.col("TeamName").alias("team")).union(services.select("TeamName"))
    lists = applications.select(F.explode("TeamNames").alias("team")).union(components.select(F.explode("TeamNames")))
    return singles.union(lists).filter(F.col("team").isNotNull()).distinct()


def referenced_but_absent(referenced: DataFrame, actual_teams: DataFrame) -> DataFrame:
    return missing_from(referenced, actual_teams, [(F.col("team"), F.col("name"))])


def team_rules(teams: DataFrame, actual_teams: DataFrame) -> DataFrame:
    """Teams that need an association rule: new ones, and existing ones that ask to be rebuilt."""
    known = actual_teams.groupBy("name").agg(F.min("id").alias("team_id"))
    joined = teams.join(known, teams["TeamName"] == known["name"], "left")
    new = F.col("team_id").isNull() & blank_to_null("TeamName").isNotNull()
    again = F.col("team_id").isNotNull() & F.coalesce("RecreateTeamAssociations", F.lit(False))
    return joined.filter(new | again).select(
        F.col("TeamName").alias("team"), "team_id", F.lit("pteam").alias("tag_key"), F.col("TeamName").alias("tag_value"),
        F.when(new, "new").otherwise("recreate").alias("reason"))


def all_access(members: DataFrame, configured: DataFrame) -> DataFrame:
    """Addresses with access everywhere; duplicates are kept."""
    return members.filter(F.col("team").isin(ALL_ACCESS_TEAMS)).select("email").unionAll(configured.select("email"))


def _by_address(df: DataFrame) -> DataFrame:
    return df.select("email").filter(F.col("email").isNotNull())


def missing_users(members: DataFrame, hives: DataFrame, access: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to create, rejected) over all sources of addresses, ignoring case.

    An address named by several sources is created once, from the first of: team member,
    hive lead, hive product, all-access list.
    """
    from_members = members.select(
        F.col("email"), F.lit(0).alias("source"), "pos", member_names("name", "email").alias("n"),
        platform_role("employee_role", "employee_type").alias("role"))
    def other(df: DataFrame, source: int) -> DataFrame:
        return df.select("email", F.lit(source).alias("source"), "pos", address_to_names("email").alias("n"),
                         F.lit("ORG_USER").alias("role"))
    leads = hives.select(F.col("lead").alias("email"), "pos").filter(blank_to_null("email").isNotNull())
    products = hives.select(F.explode("product").alias("email"), "pos")
    extra = access if "pos" in access.columns else access.withColumn("pos", F.lit(0).cast("bigint"))
    rows = (from_members.unionByName(other(leads, 1)).unionByName(other(products, 2)).unionByName(other(extra, 3))
            .select("email", "source", "pos", "n.first_name", "n.last_name", "role"))
    addressed = blank_to_null("email").isNotNull()
    named = blank_to_null("first_name").isNotNull() & blank_to_null("last_name").isNotNull()
    without_user = rows.filter(addressed)
    without_user = missing_from(without_user, users, [(F.lower("email"), F.lower("email"))])
    rejected = (rows.filter(~addressed).withColumn("error", F.lit("no address"))
                .unionByName(without_user.filter(~named).withColumn("error", F.lit("no first or last name"))))
    order = F.struct("source", "pos")
    created = (without_user.filter(named).withColumn("email_key", F.lower("email")).groupBy("email_key")
               .agg(F.min_by(F.struct("email", "source", "first_name", "last_name", "role"), order).alias("u"))
               .select("u.*"))
    return created, rejected.select("email", "source", "error")


def split_member_rows(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): usable rows have an address and names."""
    names = member_names("name", "email")
    ok = blank_to_null("email").isNotNull() & blank_to_null(names["first_name"]).isNotNull() & blank_to_null(names["last_name"]).isNotNull()
    usable = members.filter(ok)
    return usable, members.filter(~F.coalesce(ok, F.lit(False))).withColumn(
        "error", F.when(blank_to_null("email").isNull(), "no address").otherwise("no first or last name"))


def users_from_teams(members: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strict pass over team members: a name of two words or more, addresses compared as written.

    Returns (rows to create, rejected rows).
    """
    named = members.withColumn("n", full_names("name"))
    rejected = named.filter(F.col("n").isNull()).select(
        "email", "name", F.when(blank_to_null("name").isNull(), "missing name").otherwise("needs first and last name").alias("error"))
    rows = named.filter(F.col("n").isNotNull()).select(
        "email", "n.first_name", "n.last_name", platform_role("employee_role", "employee_type").alias("role"), "pos")
    fresh = missing_from(rows, users, [(F.col("email"), F.col("email"))])
    return first_by_pos(fresh, ["email"]).drop("pos"), rejected


def owners_to_create(owners: DataFrame, users: DataFrame) -> DataFrame:
    """Owner addresses, lower-cased, that are no user yet and give a first and last name; each once.

    Users are compared as stored, as the rest of the run does.
    """
    rows = owners.select(F.lower("email").alias("email")).filter(F.col("email").isNotNull()).distinct()
    fresh = missing_from(rows, users, [(F.col("email"), F.col("email"))])
    return (fresh.select("email", address_to_names("email").alias("n")).select("email", "n.*")
            .filter(blank_to_null("first_name").isNotNull() & blank_to_null("last_name").isNotNull()))


def keepers(members: DataFrame, hives: DataFrame, access: DataFrame, fold: bool = True) -> tuple[DataFrame, DataFrame]:
    """(team, email) kept as members, and addresses kept everywhere.

    ``fold`` compares leads, members and the all-access list ignoring case; products are
    compared with the folded address as they are written.
    """
    low = F.lower if fold else (lambda c: F.col(c))
    own = members.select("team", low("email").alias("email")).distinct()
    wide = (hives.select(low("lead").alias("email")).union(hives.select(F.explode("product")))
            .union(access.select(low("email"))).filter(F.col("email").isNotNull()).distinct())
    return own, wide


def kept_members(current: DataFrame, members: DataFrame, hives: DataFrame, access: DataFrame,
                 fold: bool = True, always: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``keep`` to current (team, email) rows.  ``fold=False`` with ``always`` is the case-sensitive form."""
    own, wide = keepers(members, hives, access, fold)
    if always:
        wide = wide.union(current.sparkSession.createDataFrame([(e,) for e in always], "email string")).distinct()
    email = F.lower(F.col("c.email")) if fold else F.col("c.email")
    rows = (current.alias("c")
            .join(own.select("team", F.col("email").alias("_o")).alias("o"),
                  (F.col("c.team") == F.col("o.team")) & (email == F.col("o._o")), "left")
            .join(wide.select(F.col("email").alias("_w")), email == F.col("_w"), "left"))
    return rows.select("c.*", (F.col("_o").isNotNull() | F.col("_w").isNotNull()).alias("keep"))


def access_gaps(actual_teams: DataFrame, current: DataFrame, teams: DataFrame, access: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All-access membership as three tables: (gaps, holders, wanted).

    gaps: live team, wanted and present all-access addresses and how many are missing; holders: the (team, address) that
    are there already; wanted: the addresses, once.  A team lacks ``wanted`` less its ``holders``: the product of teams and
    addresses is counted and never made.  Addresses compare ignoring case.
    """
    live = _live_teams(actual_teams, teams)
    wanted = access.select("email").filter(F.col("email").isNotNull()).distinct()
    folded = wanted.groupBy(F.lower("email").alias("address")).agg(F.count(F.lit(1)).alias("spellings"))
    here = current.select("team", F.lower("email").alias("address")).distinct().join(live, "team", "left_semi")
    holders = here.join(folded, "address")
    present = holders.groupBy("team").agg(F.sum("spellings").alias("present"))
    total = folded.agg(F.coalesce(F.sum("spellings"), F.lit(0))).scalar()
    gaps = live.join(present, "team", "left").select("team", total.alias("wanted"), F.coalesce("present", F.lit(0)).alias("present"))
    return gaps.withColumn("missing", F.col("wanted") - F.col("present")), holders.select("team", "address"), wanted


def _live_teams(actual_teams: DataFrame, teams: DataFrame) -> DataFrame:
    """Stored teams that are declared."""
    exists = actual_teams.select(F.col("name").alias("team")).distinct()
    return exists.join(teams.select(F.col("TeamName").alias("team")).distinct(), "team", "left_semi")


def membership_changes(actual_teams: DataFrame, current: DataFrame, teams: DataFrame, members: DataFrame,
                       hives: DataFrame, access: DataFrame, all_access: bool = True) -> DataFrame:
    """(team, email, action, reason) rows.

    For existing teams that are declared: add all-access users and declared members that
    are absent, remove members nobody keeps.  For every existing team: add lead and
    products of the first hive of that name, whether present or not.
    ``current`` and ``members`` carry team and email, ``hives`` team, lead, product, pos.  ``all_access=False`` leaves
    the all-access rows out, which ``access_gaps`` gives without a row for each team and address.
    """
    exists = actual_teams.select(F.col("name").alias("team")).distinct()
    live = _live_teams(actual_teams, teams)
    by_address = lambda df: df.withColumn("_e", F.lower("email"))
    wanted = members.join(live, "team", "left_semi").select("team", "email", F.lit("member").alias("reason")).distinct()
    if all_access:
        wanted = wanted.unionByName(paired(live, access.select("email").distinct()).select("team", "email", F.lit("all_access").alias("reason")))
    here = current.select("team", F.lower("email").alias("_e")).distinct()
    add = by_address(wanted).join(here, ["team", "_e"], "left_anti").select("team", "email", F.lit("add").alias("action"), "reason")
    judged = kept_members(current.join(live, "team", "left_semi"), members, hives, access)
    remove = judged.filter(~F.col("keep")).select("team", "email", F.lit("remove").alias("action"), F.lit("not_declared").alias("reason"))
    first_hive = hives.withColumn("_t", F.lower("team")).groupBy("_t").agg(F.min_by(F.struct("lead", "product"), "pos").alias("h"))
    hive = exists.join(first_hive, F.lower(exists["team"]) == F.col("_t"))
    lead = hive.select("team", F.col("h.lead").alias("email"), F.lit("add").alias("action"), F.lit("hive_lead").alias("reason"))
    product = hive.select("team", F.explode("h.product").alias("email"), F.lit("add").alias("action"), F.lit("hive_product").alias("reason"))
    return add.unionByName(remove).unionByName(lead.filter(F.col("email").isNotNull())).unionByName(product)
