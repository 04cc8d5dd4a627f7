"""Checks of stored rows against the declared model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.masking import is_mobile, mask_email, mask_name, mask_phone
from ..sources import model


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def enum_violations(tables, names: list[str]) -> DataFrame:
    """Values outside their domain, counted per table, column and value, in one scan a table.

    ``drifted`` marks values that are documented but not declared.
    """
    frames = []
    for name in names:
        df = tables[name]
        checks = []
        for column, domain in model.ENUM_COLUMNS[name].items():
            if column not in df.columns:
                continue
            value = F.col(column)
            checks.append(
                F.when(
                    value.isNotNull() & ~value.isin(*model.DOMAINS[domain]),
                    F.struct(
                        F.lit(column).alias("column_name"), value.alias("value"),
                        value.isin(*model.DRIFTED_VALUES.get(domain, ("",))).alias("drifted"),
                    ),
                )
            )
        bad = df.select(F.explode(F.array_compact(F.array(*checks))).alias("x"))
        frames.append(
            bad.groupBy("x.column_name", "x.value", "x.drifted").agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("table_name", F.lit(name))
        )
    return _union(frames)


def key_violations(tables, names: list[str]) -> DataFrame:
    """Per table and check: missing values, overlong texts, repeated keys, references to nothing."""
    frames = []

    def add(df: DataFrame, table: str, check: str, columns: str) -> None:
        frames.append(
            df.select(
                F.lit(table).alias("table_name"), F.lit(check).alias("check_name"), F.lit(columns).alias("columns"),
                F.col("violations"),
            )
        )

    for name in names:
        df = tables[name]
        row_checks = [
            F.struct(F.lit("not_null").alias("check_name"), F.lit(c).alias("columns"), F.count_if(F.col(c).isNull()).alias("violations"))
            for c in model.REQUIRED.get(name, ()) if c in df.columns
        ] + [
            F.struct(F.lit("max_length").alias("check_name"), F.lit(c).alias("columns"), F.count_if(F.length(c) > n).alias("violations"))
            for c, n in model.MAX_LENGTH.get(name, {}).items() if c in df.columns
        ]
        if row_checks:
            frames.append(
                df.agg(F.array(*row_checks).alias("x")).select(F.inline("x"))
                .select(F.lit(name).alias("table_name"), "check_name", "columns", "violations")
            )
        for key in model.UNIQUE_KEYS.get(name, ()):
            if all(c in df.columns for c in key):
                present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
                repeated = df.filter(present).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
                add(repeated.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")), name, "unique", ",".join(key))
        for (child, column), (parent, _action) in model.REFERENCES.items():
            if child == name and column in df.columns and parent in tables:
                # Keys are deduplicated before the join, so a hot key is one row there.
                held = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).agg(F.count(F.lit(1)).alias("n"))
                orphans = held.join(tables[parent].select("id"), "id", "left_anti")
                add(orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")), name, "reference", column)
    return _union(frames)


def pii_masked(users: DataFrame) -> DataFrame:
    return users.select(
        "id", mask_name(F.col("name")).alias("name"), mask_phone(F.col("phone_number")).alias("phone_number"),
        mask_email(F.col("email")).alias("email"),
    )


def phone_valid(users: DataFrame, column: str = "phone_number") -> DataFrame:
    return users.select("id", column, is_mobile(F.col(column)).alias("valid"))
