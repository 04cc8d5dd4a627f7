"""Typed scans of domain tables, and the writes that lay them out for those scans."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import model

MONTH = "stored_month"
BATCH = "stored_batch"
# The batch of rows that were there before a log was first added to.
FIRST = -1


class Tables(Mapping[str, DataFrame]):
    """Tables by name, each built on first use and then reused."""

    def __init__(self, builders):
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name](self)
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def replaced(self, **frames: DataFrame) -> "Tables":
        """The same tables with some of them exchanged."""
        builders = dict(self._builders)
        builders.update({name: (lambda _t, f=frame: f) for name, frame in frames.items()})
        return Tables(builders)


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL((model.COLUMNS | model.OWN_COLUMNS)[table])


def load(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Typed scan; never infers. Month folders, where present, prune like any partition."""
    columns = schema(table)
    if table in model.PARTITION_DATE:
        columns = T.StructType([*columns.fields, T.StructField(MONTH, T.DateType())])
    if table in model.LOGS:
        columns = T.StructType([*columns.fields, T.StructField(BATCH, T.LongType())])
    return spark.read.schema(columns).parquet(f"{root}/{table}")


def open_store(spark: SparkSession, root: str) -> Tables:
    return Tables({name: (lambda _t, n=name: load(spark, root, n)) for name in model.COLUMNS | model.OWN_COLUMNS})


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the stored layout and fill columns the source does not have with NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema(table).fields
        ]
    )


def save(df: DataFrame, root: str, table: str, mode: str = "errorifexists") -> None:
    """Write a table. Dated tables get one folder per month, sorted by date inside, so
    that both the folder and the row-group statistics prune a date range."""
    _write(conform(df, table), root, table, mode, FIRST)


def _write(rows: DataFrame, root: str, table: str, mode: str, batch: int) -> None:
    dated = model.PARTITION_DATE.get(table)
    if dated is None:
        rows.write.mode(mode).parquet(f"{root}/{table}")
        return
    folders = [MONTH]
    rows = rows.withColumn(MONTH, F.trunc(F.col(dated).cast("date"), "month"))
    if table in model.LOGS:
        folders, rows = [MONTH, BATCH], rows.withColumn(BATCH, F.lit(batch).cast("long"))
    # "rebalance" joins small months into one writer and splits a busy month over many.
    (
        rows.hint("rebalance", MONTH)
        .sortWithinPartitions(MONTH, dated)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic" if table in model.LOGS else "static")
        .partitionBy(*folders)
        .parquet(f"{root}/{table}")
    )


def append_log(df: DataFrame, root: str, table: str, batch: int) -> None:
    """Add the audit rows of batch ``batch`` (0 or more); rows of other batches are never touched.

    A batch that is added again, after a failure or by mistake, replaces itself: its folders are
    written anew and no others, so its rows are there once. The same batch must have the same rows.
    """
    if table not in model.LOGS or batch < 0:
        raise ValueError(f"{table} is no log, or {batch} no batch")
    _write(conform(df, table), root, table, "overwrite", batch)
