"""Row visibility: which rows a principal may read or change.

Rules are permissive: any one of them is enough. Grants are kept as narrow as they are stated:

* a row grant names a principal and a row,
* a public grant names a row that everybody may read,
* a table grant names an administrator who sees the whole table. It is never spelled out as
  (administrator, row) pairs, whose number is a product.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .outreach import live


@dataclass(frozen=True)
class Rule:
    """One policy: ``shape`` is own, public, shop, parent_shop, parent_user or admin."""

    table: str
    command: str
    shape: str
    column: str = ""
    parent: str = ""


# The declared policies. ``all`` covers reading and changing.
RULES: tuple[Rule, ...] = (
    Rule("users", "select", "own", "id"),
    Rule("users", "update", "own", "id"),
    Rule("user_settings", "all", "own", "user_id"),
    Rule("shops", "select", "public"),
    Rule("shops", "all", "own", "owner_id"),
    Rule("reservations", "select", "own", "user_id"),
    Rule("reservations", "select", "shop", "shop_id"),
    Rule("point_transactions", "select", "own", "user_id"),
    Rule("notifications", "select", "own", "user_id"),
    Rule("shop_settlement_configs", "all", "shop", "shop_id"),
    Rule("shop_settlements", "select", "shop", "shop_id"),
    Rule("settlement_transfers", "select", "parent_shop", "settlement_id", "shop_settlements"),
    Rule("settlement_schedules", "all", "admin"),
    Rule("shop_services", "all", "shop", "shop_id"),
    Rule("shop_images", "all", "shop", "shop_id"),
    Rule("service_images", "all", "parent_shop", "service_id", "shop_services"),
    Rule("shop_applications", "insert", "own", "applicant_id"),
    Rule("shop_applications", "select", "own", "applicant_id"),
    Rule("shop_applications", "select", "admin"),
    Rule("shop_operating_hours", "all", "shop", "shop_id"),
    Rule("reservation_actions", "select", "parent_shop", "reservation_id", "reservations"),
    Rule("users", "select", "admin"),
    Rule("users", "update", "admin"),
    Rule("shops", "select", "admin"),
    Rule("shops", "update", "admin"),
    Rule("reservations", "select", "admin"),
    Rule("reservations", "update", "admin"),
    Rule("reservations", "update", "shop", "shop_id"),
    Rule("payments", "select", "parent_user", "reservation_id", "reservations"),
    Rule("payments", "select", "parent_shop", "reservation_id", "reservations"),
    Rule("payments", "select", "admin"),
    Rule("point_transactions", "select", "admin"),
    Rule("point_transactions", "update", "admin"),
    Rule("system_settings", "all", "admin"),
    Rule("service_category_configs", "all", "admin"),
    Rule("app_configs", "all", "admin"),
    Rule("promotions", "all", "admin"),
    Rule("promotions", "select", "public"),
    Rule("shop_settlements", "all", "admin"),
    Rule("settlement_transfers", "all", "admin"),
    Rule("shop_applications", "update", "admin"),
)

# Column that names a row, where it is not ``id``.
ROW_KEYS = {
    "user_settings": ("user_id",),
    "shop_settlement_configs": ("shop_id",),
    "settlement_transfers": ("settlement_id",),
    "shop_operating_hours": ("shop_id", "day_of_week"),
}


def row_key(table: str) -> Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in ROW_KEYS.get(table, ("id",))])


def rules_for(table: str, command: str) -> list[Rule]:
    return [r for r in RULES if r.table == table and r.command in (command, "all")]


def _owners(tables) -> DataFrame:
    return tables["shops"].filter(F.col("owner_id").isNotNull()).select(
        F.col("id").alias("shop_id"), F.col("owner_id").alias("principal_id")
    )


def _public(table: str, as_of: dt.datetime) -> Column:
    return F.col("shop_status") == "active" if table == "shops" else live(as_of)


def _with_principal(tables, rule: Rule) -> DataFrame:
    """Rows of the table with the principal that a row rule gives them to."""
    rows = tables[rule.table]
    if rule.shape == "own":
        return rows.filter(F.col(rule.column).isNotNull()).withColumn("principal_id", F.col(rule.column))
    if rule.shape == "shop":
        return rows.join(_owners(tables), "shop_id")
    parent = tables[rule.parent]
    if rule.shape == "parent_user":
        link = parent.select(F.col("id").alias("__parent"), F.col("user_id").alias("principal_id"))
    else:
        link = parent.select(F.col("id").alias("__parent"), "shop_id").join(_owners(tables), "shop_id").drop("shop_id")
    child = rows.drop("principal_id", "__parent")
    return child.join(link, child[rule.column] == F.col("__parent")).drop("__parent")


def row_grants(tables, rules: list[Rule], principals: DataFrame | None = None) -> DataFrame:
    """(table, command, principal, row) for every row rule, optionally for some principals only."""
    parts = []
    for rule in rules:
        given = _with_principal(tables, rule).select(
            F.lit(rule.table).alias("table_name"), F.lit(rule.command).alias("command"), "principal_id",
            row_key(rule.table).alias("row_id"),
        )
        parts.append(given)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    if principals is not None:
        result = result.join(principals.select("principal_id").distinct(), "principal_id", "left_semi")
    return result


def by_shape(*shapes: str) -> list[Rule]:
    return [r for r in RULES if r.shape in shapes]


def public_rows(tables, as_of: dt.datetime) -> DataFrame:
    """Rows everybody may read: active shops and live promotions."""
    parts = [
        tables[r.table].filter(_public(r.table, as_of)).select(
            F.lit(r.table).alias("table_name"), row_key(r.table).alias("row_id")
        )
        for r in by_shape("public")
    ]
    return parts[0].unionByName(parts[1])


def admins(tables) -> DataFrame:
    return tables["users"].filter(F.col("user_role") == "admin").select(F.col("id").alias("principal_id"))


def table_grants(tables, skip: tuple[str, ...] = ()) -> DataFrame:
    """(table, command, administrator, rows in the table) for every administrator rule."""
    parts = []
    for rule in by_shape("admin"):
        if rule.table in skip:
            continue
        size = tables[rule.table].agg(F.count(F.lit(1)).alias("n")).scalar()
        parts.append(F.struct(F.lit(rule.table).alias("table_name"), F.lit(rule.command).alias("command"), size.alias("visible_rows")))
    return admins(tables).select("principal_id", F.inline(F.array(*parts)))


def visible_reservations(tables, principals: DataFrame | None = None) -> DataFrame:
    """All that principals may read of the bookings: their own, those of their shops, and for
    administrators the whole table (``reservation_id`` NULL, scope ``table``)."""
    rules = [r for r in rules_for("reservations", "select") if r.shape in ("own", "shop")]
    key = tables["reservations"].schema["id"].dataType
    rows = row_grants(tables, rules, principals).select(
        "principal_id", F.col("row_id").cast(key).alias("reservation_id"), F.lit("row").alias("scope")
    ).distinct()
    whole = admins(tables)
    if principals is not None:
        whole = whole.join(principals.select("principal_id").distinct(), "principal_id", "left_semi")
    whole = whole.select("principal_id", F.lit(None).cast(key).alias("reservation_id"), F.lit("table").alias("scope"))
    # An administrator's single rows are part of the whole table.
    return rows.join(whole.select("principal_id"), "principal_id", "left_anti").unionByName(whole)


def rows_for(tables, table: str, command: str, principal, as_of: dt.datetime) -> DataFrame:
    """The rows of a table that one principal may read or change, as a session would see them."""
    me = F.lit(principal)
    rules = rules_for(table, command)
    rows = tables[table].withColumn("__key", row_key(table))
    whole = F.lit(False)
    if any(r.shape == "admin" for r in rules):
        is_admin = admins(tables).filter(F.col("principal_id") == me).agg(F.count(F.lit(1)).alias("n")).scalar()
        whole = is_admin > 0
    allowed = whole
    for rule in rules:
        if rule.shape == "own":
            allowed = allowed | F.coalesce(F.col(rule.column) == me, F.lit(False))
        elif rule.shape == "public":
            allowed = allowed | F.coalesce(_public(table, as_of), F.lit(False))
    shared = [r for r in rules if r.shape in ("shop", "parent_shop", "parent_user")]
    if not shared:
        return rows.filter(allowed).drop("__key")
    # Keys of the rows the remaining rules give to this one principal.
    keys = row_grants(tables, shared).filter(F.col("principal_id") == me).select(
        F.col("row_id").alias("__given")
    ).distinct()
    return (
        rows.join(keys, F.col("__key") == F.col("__given"), "left")
        .filter(allowed | F.col("__given").isNotNull())
        .drop("__key", "__given")
    )
