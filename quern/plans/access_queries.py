"""Queries on users, roles and permissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import access as A
from quern.operators.results import page
from quern.plans.registry import query
from quern.plans.views import view

_RBAC = ("sys_user", "user_role", "sys_role", "role_permission", "sys_permission")
_JOIN = """FROM sys_user u JOIN user_role ur ON u.user_id = ur.user_id JOIN sys_role r ON r.role_id = ur.role_id
    JOIN role_permission rp ON rp.role_id = r.role_id JOIN sys_permission p ON p.permission_id = rp.permission_id"""
_LIVE = "u.is_active AND NOT u.is_deleted AND r.is_active AND p.is_active"
_SUPER = "user_id % 97 = 0"


def _views(spark, d, *names):
    return [view(spark, d, n) for n in names]


@query(
    "e01_user_permissions",
    f"SELECT u.user_id, username, permission_code, permission_type, CAST(data_theme_id AS VARCHAR) AS data_theme_id, "
    f"CAST(p.table_id AS VARCHAR) AS table_id {_JOIN} WHERE {_LIVE}",
    views=_RBAC,
)
def _permissions(spark, d):
    return A.user_permissions(*_views(spark, d, *_RBAC)).select(
        "user_id", "username", "permission_code", "permission_type",
        F.col("data_theme_id").cast("string").alias("data_theme_id"), F.col("table_id").cast("string").alias("table_id"),
    )


@query(
    "e02_table_permissions",
    f"""
    SELECT t.table_id, table_name_cn, table_name_en, u.user_id, username {_JOIN} JOIN mtable t ON t.table_id = p.table_id
    WHERE {_LIVE} AND t.is_active
    """,
    views=(*_RBAC, "mtable"),
)
def _table_permissions(spark, d):
    return A.table_permissions(*_views(spark, d, *_RBAC, "mtable"))


def _sets(spark, d):
    users, user_role, role_permission, permissions = _views(
        spark, d, "sys_user", "user_role", "role_permission", "sys_permission"
    )
    return A.user_permission_set(users.withColumn("is_superuser", F.expr(_SUPER)), user_role, role_permission, permissions)


_SET_SQL = f"""
    SELECT user_id, is_superuser, list_sort(list_distinct(list_concat(coalesce(codes, []),
           CASE WHEN is_superuser THEN ['*'] ELSE [] END))) AS permissions
    FROM (SELECT user_id, {_SUPER} AS is_superuser FROM sys_user WHERE is_active)
    LEFT JOIN (SELECT user_id, list(DISTINCT permission_code) AS codes FROM user_role JOIN role_permission USING (role_id)
               JOIN sys_permission USING (permission_id) GROUP BY 1) USING (user_id)
"""


@query(
    "e03_user_permission_set",
    f"SELECT user_id, is_superuser, array_to_string(permissions, ',') AS permissions FROM ({_SET_SQL})",
    views=_RBAC,
)
def _set(spark, d):
    return _sets(spark, d).withColumn("permissions", F.array_join("permissions", ","))


@query(
    "e04_effective_grants_union",
    "SELECT DISTINCT user_id, permission_id FROM user_role JOIN role_permission USING (role_id)",
    views=("user_role", "role_permission"),
)
def _union(spark, d):
    return A.effective_grants(*_views(spark, d, "user_role", "role_permission"), "union")


@query(
    "e04_effective_grants_intersection",
    """
    SELECT user_id, permission_id FROM user_role JOIN role_permission USING (role_id) GROUP BY 1, 2
    HAVING count(DISTINCT role_id) = (SELECT count(DISTINCT role_id) FROM user_role x WHERE x.user_id = user_role.user_id)
    """,
    views=("user_role", "role_permission"),
)
def _intersection(spark, d):
    return A.effective_grants(*_views(spark, d, "user_role", "role_permission"), "intersection")


@query(
    "e05_accessible_tables",
    """
    WITH g AS (SELECT p.* FROM sys_permission p JOIN role_permission USING (permission_id) JOIN user_role USING (role_id)
               WHERE is_active AND user_id = 13)
    SELECT table_id, table_name_en FROM mtable WHERE is_active AND (
      table_id IN (SELECT table_id FROM g WHERE table_id IS NOT NULL) OR table_id IN (
        SELECT table_id FROM table_theme WHERE theme_id IN (SELECT data_theme_id FROM g)
          OR theme_id IN (SELECT theme_id FROM theme WHERE is_public)))
    """,
    views=("sys_permission", "role_permission", "user_role", "mtable", "table_theme", "theme"),
)
def _accessible(spark, d):
    return A.accessible_tables(
        13, *_views(spark, d, "user_role", "role_permission", "sys_permission", "mtable", "table_theme", "theme")
    ).select("table_id", "table_name_en")


@query(
    "e06_check_permissions",
    f"""
    SELECT user_id, is_superuser OR list_contains(permissions, '*') OR (
        (list_contains(permissions, 'res1:read') OR list_contains(permissions, 'res1:*'))
        AND (list_contains(permissions, 'res3:export') OR list_contains(permissions, 'res3:*'))) AS allowed
    FROM ({_SET_SQL})
    """,
    views=_RBAC,
)
def _check(spark, d):
    users, user_role, role_permission, permissions = _views(spark, d, "sys_user", "user_role", "role_permission", "sys_permission")
    users = users.withColumn("is_superuser", F.expr(_SUPER))
    return A.check_permissions(users, user_role, role_permission, permissions, ["res1:read", "res3:export"])


@query(
    "e07_check_roles",
    f"""
    SELECT u.user_id, {_SUPER.replace('user_id', 'u.user_id')} OR (
      SELECT count(DISTINCT role_name) FROM user_role ur JOIN sys_role r ON ur.role_id = r.role_id
      WHERE ur.user_id = u.user_id AND role_name IN ('Role of nation_0', 'Role of nation_4')) = 2 AS allowed
    FROM sys_user u WHERE is_active
    """,
    views=("sys_user", "user_role", "sys_role"),
)
def _roles_check(spark, d):
    users, user_role, roles = _views(spark, d, "sys_user", "user_role", "sys_role")
    return A.check_roles(
        users.withColumn("is_superuser", F.expr(_SUPER)), user_role, roles, ["Role of nation_0", "Role of nation_4"]
    )


@query(
    "e08_list_users",
    """
    SELECT user_id, username, email FROM sys_user
    WHERE is_active AND (username ILIKE '%r#0_0000%7%' OR email ILIKE '%r#0_0000%7%') ORDER BY user_id DESC LIMIT 20
    """,
    views=("sys_user",),
)
def _users(spark, d):
    found = A.list_users(view(spark, d, "sys_user"), "R#0_0000%7", True)
    return page(found, [F.desc("user_id")], 1, 20).select("user_id", "username", "email")


@query("e09_list_roles", "SELECT role_id, role_code FROM many_roles WHERE role_code ILIKE '%r#_0%3%' ORDER BY role_id LIMIT 20", views=("many_roles",))
def _roles(spark, d):
    return page(A.list_roles(view(spark, d, "many_roles"), "R#_0%3"), ["role_id"], 1, 20).select("role_id", "role_code")


@query(
    "e10_role_detail",
    """
    SELECT role_id, role_code, coalesce(string_agg(permission_code, ',' ORDER BY permission_code), '') AS permissions
    FROM every_role LEFT JOIN (SELECT theme_id AS role_id, permission_code FROM table_theme
                               JOIN many_permissions ON permission_id = table_id) USING (role_id) GROUP BY 1, 2
    """,
    views=("every_role", "table_theme", "many_permissions"),
)
def _detail(spark, d):
    roles, links, permissions = _views(spark, d, "every_role", "table_theme", "many_permissions")
    out = A.role_detail(roles, links.toDF("permission_id", "role_id"), permissions)
    return out.select("role_id", "role_code", F.array_join("permissions", ",").alias("permissions"))


@query(
    "e11_role_user_counts",
    """
    SELECT role_id, role_code, count(user_id) AS user_count FROM many_roles LEFT JOIN user_role USING (role_id) GROUP BY 1, 2
    """,
    views=("many_roles", "user_role"),
)
def _role_counts(spark, d):
    return A.role_user_counts(*_views(spark, d, "many_roles", "user_role")).select("role_id", "role_code", "user_count")


@query(
    "e12_list_permissions",
    """
    SELECT permission_id, permission_type, permission_code FROM many_permissions
    ORDER BY permission_type, permission_code, permission_id
    """,
    views=("many_permissions",),
)
def _list_permissions(spark, d):
    return A.list_permissions(view(spark, d, "many_permissions")).select(
        "permission_id", "permission_type", "permission_code"
    )


@query(
    "e13_replace_links",
    """
    SELECT * FROM user_role WHERE user_id IN (SELECT user_id FROM sys_user WHERE is_active)
    UNION ALL SELECT user_id, (user_id + 1) % 8 AS role_id FROM sys_user WHERE NOT is_active AND NOT is_deleted
    """,
    views=("user_role", "sys_user"),
)
def _replace(spark, d):
    """Inactive users get one new role; deleted ones lose theirs."""
    links, users = _views(spark, d, "user_role", "sys_user")
    new = users.filter("NOT is_active").selectExpr("user_id", "IF(is_deleted, NULL, (user_id + 1) % 8) AS role_id")
    return A.replace_links(links, "user_id", new)
