"""Names, mail addresses, roles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, strip, blank_to_null

# The roles a user may hold.
USER_ROLES = ["ORG_ADMIN", "ORG_APP_ADMIN", "ORG_USER", "ORG_ADMIN_LITE", "ORG_SEC_ADMIN", "ORG_SEC_DEV"]

# Employee role or type to platform role; anything else is ORG_USER.
PLATFORM_ROLES = {
    "Security Champion": "SECURITY_CHAMPION",
    "Manager": "SECURITY_CHAMPION",
    "Engineering User": "ENGINEERING_USER",
    "Employee": "ENGINEERING_USER",
    "Application Admin": "APPLICATION_ADMIN",
    "Contractor": "ORG_USER",
}


def name_to_address(name: Column | str, domain: Column | str) -> Column:
    domain = F.lit(domain) if isinstance(domain, str) else domain
    return F.concat(F.replace(F.lower(strip(name)), F.lit(" "), F.lit(".")), F.lit("@"), domain)


def address_to_names(email: Column | str) -> Column:
    """First and last name from the part before ``@``; a part without a dot is used for both."""
    email = col(email)
    local = F.substring_index(email, "@", 1)
    parts = F.split(local, r"\.")
    dotted = F.size(parts) > 1
    whole = F.contains(email, F.lit("@"))
    return F.struct(
        F.when(whole, F.when(dotted, F.get(parts, F.lit(0))).otherwise(local)).alias("first_name"),
        F.when(whole, F.when(dotted, F.get(parts, F.lit(1))).otherwise(local)).alias("last_name"))


def member_names(name: Column | str, email: Column | str) -> Column:
    """First two space-separated parts of a name, or what the address gives when there are fewer."""
    parts = F.split(col(name), " ")
    usable = blank_to_null(name).isNotNull() & (F.size(parts) >= 2)
    fallback = address_to_names(email)
    return F.struct(
        F.when(usable, F.get(parts, F.lit(0))).otherwise(fallback["first_name"]).alias("first_name"),
        F.when(usable, F.get(parts, F.lit(1))).otherwise(fallback["last_name"]).alias("last_name"))


def full_names(name: Column | str) -> Column:
    """Strict form: at least two words; the first, then all others joined.  Null otherwise."""
    parts = F.filter(F.split(strip(name), r"\s+"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.struct(
        F.get(parts, F.lit(0)).alias("first_name"),
        F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " ").alias("last_name")))


def platform_role(employee_role: Column | str, employee_type: Column | str) -> Column:
    role = F.coalesce(blank_to_null(employee_role), col(employee_type))
    table = F.create_map(*[F.lit(x) for pair in PLATFORM_ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, role), F.lit("ORG_USER"))


def known_role(role: Column | str) -> Column:
    return F.coalesce(col(role).isin(USER_ROLES), F.lit(False))


def strip_user_suffix(name: Column | str) -> Column:
    name = col(name)
    return F.when(F.endswith(name, F.lit(" User")), strip(F.regexp_replace(name, " User$", ""))).otherwise(name)
