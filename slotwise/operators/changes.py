"""Changing keyed tables: upserts, defaults, modification times, account erasure."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import at
from ..sources import model
from .durable import cut_lineage
from .spread import join_per_key


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], seq: str, as_of: dt.datetime | None = None) -> DataFrame:
    """Base rows with the last change of each key written over them, new keys added.

    The last change is found with an aggregate, so many changes of one key are combined on the
    map side. With ``as_of``, ``updated_at`` is set on rows of changed content.
    """
    values = [c for c in base.columns if c not in keys and c != "updated_at"]
    latest = changes.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c).alias(c) for c in values]), F.col(seq)).alias("new")
    )
    old = base.select(*keys, F.struct(*values).alias("old"), *([F.col("updated_at")] if "updated_at" in base.columns else []))
    joined = old.join(latest, keys, "full_outer")
    kept = [F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in values]
    if as_of is None:
        return joined.select(*keys, *kept)
    changed = F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))
    before = F.col("updated_at") if "updated_at" in base.columns else F.lit(None).cast("timestamp_ntz")
    return joined.select(*keys, *kept, touched(changed, before, as_of))


def touched(changed: Column, before: Column, as_of: dt.datetime) -> Column:
    """Modification time: ``as_of`` where something changed, else what it was."""
    return F.when(changed, at(as_of)).otherwise(before).alias("updated_at")


def insert_absent(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows plus those of ``rows`` whose key is new. One row per new key."""
    fresh = rows.join(base.select(*keys), keys, "left_anti")
    values = [c for c in base.columns if c not in keys]
    once = fresh.groupBy(*keys).agg(F.min(F.struct(*values)).alias("v")).select(*keys, "v.*")
    return base.unionByName(once)


def apply_defaults(df: DataFrame, table: str) -> DataFrame:
    """Fill the table's defaults where a value is missing; adds columns that are not there."""
    for column, value in model.DEFAULTS.get(table, {}).items():
        have = F.col(column) if column in df.columns else F.lit(None)
        df = df.withColumn(column, F.coalesce(have, F.lit(value)))
    return df


def _references(tables, table: str, action: str) -> list[tuple[str, str]]:
    """(column, parent) of a table's declared references with that action, of the columns that are there."""
    return [
        (column, parent)
        for (child, column), (parent, what) in model.REFERENCES.items()
        if child == table and what == action and child in tables and column in tables[child].columns
    ]


def _owned(tables, table: str, extra: list[str]) -> DataFrame | None:
    """Rows of a table with the account they go with (``owner``, found along cascades), or None if with no account."""
    found = None
    for column, parent in _references(tables, table, "cascade"):
        if parent == "users":
            own = tables[table].select(F.col(column).alias("owner"), *extra)
        else:
            above = _owned(tables, parent, ["id"]) if parent in tables else None
            if above is None:
                continue
            above = above.withColumnRenamed("id", "__parent")
            own = tables[table].join(above, F.col(column) == F.col("__parent"), "left").select("owner", *extra)
        if found is not None:
            raise ValueError(f"{table} goes with accounts in more than one way")
        found = own
    return found


def _holds(tables, wanted: DataFrame) -> DataFrame:
    """(owner, id): a row that goes with ``owner`` names the account ``id``; owner is null where the row stays for certain."""
    links = None
    for table, column in model.HOLDERS:
        if table not in tables or column not in tables[table].columns:
            continue
        owned = _owned(tables, table, [column])
        if owned is None:
            owned = tables[table].select(F.lit(None).alias("owner"), column)
        own = owned.select(F.col("owner").cast(wanted.schema["id"].dataType).alias("owner"), F.col(column).alias("id"))
        own = own.filter(F.col("id").isNotNull() & ~F.col("owner").eqNullSafe(F.col("id"))).distinct()
        links = own if links is None else links.unionByName(own)
    asked = wanted.select(F.col("id").alias("owner"), F.lit(True).alias("asked"))
    # Whoever did not ask to go stays, and so do the rows.
    return links.join(wanted, "id", "left_semi").join(asked, "owner", "left").select(
        F.when(F.col("asked"), F.col("owner")).alias("owner"), "id"
    ).distinct()


def held_accounts(holds: DataFrame) -> DataFrame:
    """Ids that a row without an owner holds, or one whose owner is held.

    Links are shortened at both ends: one whose owner is held itself holds for certain, and one whose owner has a
    single holder is handed to that one, so a chain of accounts is halved in every round. A link whose owner nobody
    holds is dropped. It ends when a round holds nobody new. Links get fewer, never more; each round is written.
    """
    links, before = cut_lineage(holds), -1
    while True:
        held = links.filter(F.col("owner").isNull()).select("id").distinct()
        now = held.count()
        if now == before:
            return held
        before = now
        into = links.groupBy(F.col("id").alias("over")).agg(
            F.count(F.lit(1)).alias("n"), F.max(F.col("owner").isNull()).alias("certain"), F.min("owner").alias("single")
        )
        followed = join_per_key(links.withColumnRenamed("owner", "over"), into, "over", "id", "left").select(
            "id",
            F.when(~F.col("certain"), F.when(F.col("n") == 1, F.col("single")).otherwise(F.col("over"))).alias("owner"),
            (F.col("over").isNull() | F.col("n").isNotNull()).alias("goes_on"),
        )
        links = cut_lineage(
            followed.filter(F.col("goes_on") & ~F.col("owner").eqNullSafe(F.col("id"))).select("owner", "id").distinct()
        )


def _without(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select(F.col("id").alias(column)), column, "left_anti").select(*rows.columns)


def erase_users(tables, requested: DataFrame) -> dict[str, DataFrame]:
    """Delete accounts, as one statement over all of them, along the declared references.

    Rows go with the account or row that they cascade from, columns that are set to NULL lose what is gone, and an
    account stays if a row that stays names it in one of ``model.HOLDERS``. Whoever stays may hold others back. Tables
    and columns that are not there are left out. Returns ``erased``, ``blocked``, and every table that loses something.
    """
    wanted = requested.select("id").filter(F.col("id").isNotNull()).distinct()
    erased = cut_lineage(wanted.join(held_accounts(_holds(tables, wanted)), "id", "left_anti"))
    gone: dict[str, DataFrame | None] = {"users": erased}

    def gone_from(table: str) -> DataFrame | None:
        """Ids of the rows of a table that go, None if none can."""
        if table not in gone:
            parts = [
                tables[table].join(gone_from(parent).select(F.col("id").alias(column)), column, "left_semi").select("id")
                for column, parent in _references(tables, table, "cascade")
                if gone_from(parent) is not None
            ]
            gone[table] = reduce(DataFrame.unionByName, parts).distinct() if parts else None
        return gone[table]

    result = {
        "erased": erased,
        "blocked": wanted.join(erased, "id", "left_anti"),
        "users": _without(tables["users"], "id", erased),
    }
    for table in {child: None for child, _ in model.REFERENCES if child in tables}:
        left, touched = tables[table], False
        for column, parent in _references(tables, table, "cascade"):
            if gone_from(parent) is not None:
                left, touched = _without(left, column, gone_from(parent)), True
        for column, parent in _references(tables, table, "set_null"):
            if gone_from(parent) is not None:
                lost = gone_from(parent).select(F.col("id").alias(column), F.lit(True).alias("__lost"))
                columns = left.columns
                left, touched = left.join(lost, column, "left").withColumn(
                    column, F.when(F.col("__lost").isNull(), F.col(column))
                ).select(*columns), True
        if touched:
            result[table] = left
    return result
