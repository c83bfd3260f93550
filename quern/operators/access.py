"""Users, roles and permissions.

No side is broadcast by a hint: Spark broadcasts role and permission tables
when their measured size is under its threshold and otherwise shuffles both
sides, splitting hot roles with its adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import like_any
from quern.functions.keys import keys_of


def _no_codes() -> Column:
    return F.array().cast("array<string>")


def active_users(users: DataFrame) -> DataFrame:
    return users.filter(F.col("is_active") & ~F.col("is_deleted"))


def user_permissions(
    users: DataFrame, user_role: DataFrame, roles: DataFrame, role_permission: DataFrame, permissions: DataFrame
) -> DataFrame:
    """What active users hold through active roles; two roles granting the same give two rows.

    Roles and permissions are joined to each other first, so the user link
    table meets one small relation once.
    """
    grants = (
        role_permission.join(roles.filter("is_active").select("role_id"), "role_id")
        .join(permissions.filter("is_active").drop("is_active"), "permission_id")
        .drop("permission_id")
    )
    return (
        user_role.join(active_users(users).select("user_id", "username"), "user_id")
        .join(grants, "role_id")
        .drop("role_id")
    )


def table_permissions(
    users: DataFrame, user_role: DataFrame, roles: DataFrame, role_permission: DataFrame, permissions: DataFrame, tables: DataFrame
) -> DataFrame:
    """Who may read which active table by a direct table grant; theme grants do not count."""
    direct = permissions.filter(F.col("table_id").isNotNull()).join(
        tables.filter("is_active").select("table_id", "table_name_cn", "table_name_en"), "table_id"
    )
    return user_permissions(users, user_role, roles, role_permission, direct).select(
        "table_id", "table_name_cn", "table_name_en", "user_id", "username"
    )


def user_permission_set(
    users: DataFrame, user_role: DataFrame, role_permission: DataFrame, permissions: DataFrame
) -> DataFrame:
    """Sorted distinct codes per active user, with ``*`` for a superuser.

    Codes are gathered per role first, so each user link carries one list and
    no (user, code) rows are made. A list is as long as the permission table at most.
    """
    role_codes = (
        role_permission.join(permissions.select("permission_id", "permission_code"), "permission_id")
        .groupBy("role_id")
        .agg(F.collect_set("permission_code").alias("codes"))
    )
    held = (
        user_role.join(role_codes, "role_id").groupBy("user_id").agg(F.flatten(F.collect_set("codes")).alias("codes"))
    )
    star = F.when(F.col("is_superuser"), F.array(F.lit("*"))).otherwise(_no_codes())
    codes = F.array_sort(F.array_distinct(F.concat(F.coalesce("codes", _no_codes()), star)))
    return (
        users.filter("is_active")
        .select("user_id", "is_superuser")
        .join(held, "user_id", "left")
        .select("user_id", "is_superuser", codes.alias("permissions"))
    )


def effective_grants(user_role: DataFrame, role_permission: DataFrame, mode: str = "union") -> DataFrame:
    """(user, permission) pairs granted by any role, or by every role the user has."""
    links = user_role.distinct()
    pairs = links.join(role_permission.distinct(), "role_id")
    if mode == "union":
        return pairs.select("user_id", "permission_id").distinct()
    if mode != "intersection":
        raise ValueError(f"unknown mode {mode}")
    needed = links.groupBy("user_id").agg(F.count(F.lit(1)).alias("needed"))
    granted = pairs.groupBy("user_id", "permission_id").agg(F.count(F.lit(1)).alias("granted"))
    return (
        granted.join(needed, "user_id").filter("granted = needed").select("user_id", "permission_id")
    )


def accessible_tables(
    user_id: int,
    user_role: DataFrame,
    role_permission: DataFrame,
    permissions: DataFrame,
    tables: DataFrame,
    links: DataFrame,
    theme: DataFrame,
    theme_id: int | None = None,
    table_ids: Sequence[int] | None = None,
) -> DataFrame:
    """Active tables a user may query: direct grants, granted themes and public themes, cut to a selection."""
    own = keys_of(user_role.filter(F.col("user_id") == user_id), "role_id")
    granted = permissions.filter("is_active").join(
        keys_of(role_permission.join(own, "role_id", "left_semi"), "permission_id"), "permission_id", "left_semi"
    )
    direct = granted.filter("table_id IS NOT NULL").select("table_id")
    themes = (
        granted.filter("data_theme_id IS NOT NULL")
        .select(F.col("data_theme_id").alias("theme_id"))
        .unionByName(theme.filter("is_public").select("theme_id"))
    )
    through = links.join(keys_of(themes, "theme_id"), "theme_id", "left_semi").select("table_id")
    allowed = tables.filter("is_active").join(keys_of(direct.unionByName(through), "table_id"), "table_id", "left_semi")
    if theme_id:
        allowed = allowed.join(keys_of(links.filter(F.col("theme_id") == theme_id), "table_id"), "table_id", "left_semi")
    if table_ids:
        allowed = allowed.filter(F.col("table_id").isin(*table_ids))
    return allowed.select(*tables.columns)


def _parents(code: str) -> list[str]:
    parts = code.split(":")
    return [":".join(parts[:i]) + ":*" for i in range(len(parts) - 1, 0, -1)]


def check_permissions(
    users: DataFrame, user_role: DataFrame, role_permission: DataFrame, permissions: DataFrame, required: Sequence[str]
) -> DataFrame:
    """(user, allowed) of active users: superuser or ``*``, or each code held itself or through a parent ``a:*``.

    Only permissions that can decide are looked at: one flag per role and
    required code, then one per user; no list of codes is built.
    """
    accepted = [[code, *_parents(code), "*"] for code in required]
    flags = [f"f{i}" for i in range(len(required))]
    useful = permissions.filter(F.col("permission_code").isin(*{c for codes in accepted for c in codes})).select(
        "permission_id", *[F.col("permission_code").isin(*codes).alias(f) for f, codes in zip(flags, accepted)]
    )
    either = [F.bool_or(f).alias(f) for f in flags]
    if not flags:
        return users.filter("is_active").select("user_id", F.lit(True).alias("allowed"))
    of_role = role_permission.join(useful, "permission_id").groupBy("role_id").agg(*either)
    of_user = user_role.join(of_role, "role_id").groupBy("user_id").agg(*either)
    every = reduce(lambda a, b: a & b, [F.coalesce(f, F.lit(False)) for f in flags])
    return (
        users.filter("is_active")
        .select("user_id", "is_superuser")
        .join(of_user, "user_id", "left")
        .select("user_id", (F.col("is_superuser") | every).alias("allowed"))
    )


def check_roles(users: DataFrame, user_role: DataFrame, roles: DataFrame, required: Sequence[str]) -> DataFrame:
    """``allowed`` when superuser or when all listed roles are held, by name.

    Only links to the listed roles are counted, so no list of roles is built.
    """
    wanted = roles.filter(F.col("role_name").isin(*required)).select("role_id", "role_name")
    held = user_role.join(wanted, "role_id").groupBy("user_id").agg(F.count_distinct("role_name").alias("held"))
    enough = F.coalesce("held", F.lit(0)) >= len(set(required))
    return (
        users.filter("is_active")
        .join(held, "user_id", "left")
        .select("user_id", (F.col("is_superuser") | enough).alias("allowed"))
    )


def list_users(users: DataFrame, keyword: str | None = None, active: bool | None = None) -> DataFrame:
    """Name, nickname or mail holds the keyword. Password-like columns are never shown."""
    if keyword:
        users = users.filter(like_any(keyword, *[c for c in ("username", "nickname", "email") if c in users.columns]))
    if active is not None:
        users = users.filter(F.col("is_active") == active)
    return users.drop("password", "password_hash", "hashed_password", "salt")


def list_roles(roles: DataFrame, keyword: str | None = None) -> DataFrame:
    names = [c for c in ("role_name", "role_code", "description") if c in roles.columns]
    return roles.filter(like_any(keyword, *names)) if keyword else roles


def role_detail(roles: DataFrame, role_permission: DataFrame, permissions: DataFrame) -> DataFrame:
    """Roles with their permission codes, sorted; an empty list when there are none."""
    codes = (
        role_permission.join(permissions.select("permission_id", "permission_code"), "permission_id")
        .groupBy("role_id")
        .agg(F.array_sort(F.collect_list("permission_code")).alias("permissions"))
    )
    return roles.join(codes, "role_id", "left").withColumn("permissions", F.coalesce("permissions", _no_codes()))


def role_user_counts(roles: DataFrame, user_role: DataFrame) -> DataFrame:
    counts = user_role.groupBy("role_id").agg(F.count("user_id").alias("user_count"))
    return roles.join(counts, "role_id", "left").withColumn("user_count", F.coalesce("user_count", F.lit(0)))


def permission_order() -> list[Column]:
    return [F.asc("permission_type"), F.asc("permission_code"), F.asc("permission_id")]


def list_permissions(permissions: DataFrame) -> DataFrame:
    return permissions.orderBy(*permission_order())


def replace_links(links: DataFrame, owner: str, new: DataFrame) -> DataFrame:
    """Full replacement: every owner named in ``new`` loses the old links and gets the new ones, each once.

    A row with a NULL partner only clears its owner.
    """
    partner = next(c for c in links.columns if c != owner)
    kept = links.join(keys_of(new, owner), owner, "left_anti").select(*links.columns)
    return kept.unionByName(new.select(*links.columns).filter(F.col(partner).isNotNull()).distinct())
