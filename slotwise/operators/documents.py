"""JSON columns whose shape is not declared: payment metadata, opening hours, app configurations.

A column is parsed once into a VARIANT, which keeps the shape of each document. Fields are taken out by path and cast
where they can be; what a document does not have, or has in a form that cannot be cast, is NULL. A text that is no
JSON is reported by ``readable`` and never stops a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Names of days in opening hours, from Sunday.
DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
#: Levels of objects that are taken apart into paths.
DEPTH = 4


def parsed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``document`` (VARIANT) instead of the JSON text, and whether it could be read; NULL can."""
    document = F.try_parse_json(column)
    return df.withColumns({"document": document, "readable": F.col(column).isNull() | document.isNotNull()}).drop(column)


def payment_details(payments: DataFrame) -> DataFrame:
    """Provider, card and fees of each payment from its metadata. Numbers may come as texts."""
    get = lambda path, kind: F.try_variant_get("document", path, kind)
    fees = get("$.fees", "array<bigint>")
    return parsed(payments, "metadata").select(
        "id", get("$.provider", "string").alias("provider"), get("$.card.brand", "string").alias("card_brand"),
        get("$.card.installments", "int").alias("installments"), get("$.point.used", "bigint").alias("points_used"),
        F.aggregate(fees, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("fee_total"), "readable",
    )


def _entries(value: Column) -> Column:
    """The fields of an object, NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _minute(text: Column) -> Column:
    """Minute of the day of ``HH:MM``, NULL for any other text."""
    hour, minute = (F.regexp_extract(text, "^([0-9]{1,2}):([0-9]{2})$", i).try_cast("int") for i in (1, 2))
    return F.when((hour < 25) & (minute < 60), hour * 60 + minute)


def opening_hours(shops: DataFrame) -> DataFrame:
    """One row per shop and day named in ``operating_hours``.

    A day is an object with ``open``, ``close`` and maybe ``break`` (two times), a text ``HH:MM-HH:MM``, or something
    else, such as null, for a closed one. Names that are no day are left out, as are documents that cannot be read.
    """
    days = F.create_map(*[x for i, name in enumerate(DAYS) for x in (F.lit(name), F.lit(i))])
    each = parsed(shops, "operating_hours").select("id", F.explode(_entries(F.col("document"))).alias("name", "hours"))
    field = lambda path: F.try_variant_get("hours", path, "string")
    # An object has no text of its own; only a plain text is split.
    plain = F.when(F.schema_of_variant("hours") == "STRING", field("$"))
    part = lambda i: F.get(F.split(plain, "-"), F.lit(i))
    found = each.select(
        F.col("id").alias("shop_id"), days[F.lower("name")].alias("day_of_week"),
        _minute(F.coalesce(field("$.open"), part(0))).alias("open_minute"),
        _minute(F.coalesce(field("$.close"), part(1))).alias("close_minute"),
        _minute(field("$.break[0]")).alias("break_start_minute"), _minute(field("$.break[1]")).alias("break_end_minute"),
    ).filter(F.col("day_of_week").isNotNull())
    return found.withColumn("is_open", F.col("open_minute").isNotNull() & F.col("close_minute").isNotNull())


def _leaves(value: Column, path: Column, depth: int) -> Column:
    """array<struct<path, value>> of what lies below ``value``; arrays and empty objects are leaves."""
    own = F.array(F.struct(path.alias("path"), value.alias("value")))
    if depth == 0:
        return own
    below = F.flatten(
        F.transform(
            F.map_entries(_entries(value)),
            lambda e: _leaves(e["value"], F.concat_ws(".", F.nullif(path, F.lit("")), e["key"]), depth - 1),
        )
    )
    return F.when(F.size(below) > 0, below).otherwise(own)


def leaves(df: DataFrame, column: str, *keep: str, depth: int = DEPTH) -> DataFrame:
    """``keep`` and one row per leaf of each readable document: path, kind (its type) and value as text.

    What lies deeper than ``depth`` objects is one leaf of kind ``OBJECT<...>``.
    """
    each = parsed(df, column).filter(F.col("document").isNotNull()).select(
        *keep, F.inline(_leaves(F.col("document"), F.lit(""), depth))
    )
    return each.select(
        *keep, "path", F.schema_of_variant("value").alias("kind"), F.try_variant_get("value", "$", "string").alias("value")
    )


def field_kinds(df: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """Documents per path and kind: where a path has several kinds, the documents have drifted."""
    return leaves(df, column, depth=depth).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("documents"))


def merged_schema(df: DataFrame, column: str) -> DataFrame:
    """One row: the type that all readable documents fit, VARIANT where they do not agree."""
    return parsed(df, column).agg(F.schema_of_variant_agg("document").alias("schema"))
